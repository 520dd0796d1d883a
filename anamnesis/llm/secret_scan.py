"""Secret scans by one combined deterministic automaton.

All rules are compiled together (see ``dfa``) and a text's UTF-8 bytes are read in
one pass. Where the automaton accepts, the rule's mirrored automaton finds the
leftmost start and its anchored automaton the end; where the match ends, the
rule's reset letter makes the pass forget what it has read of the rule, so that
every acceptance is of a match that begins there or later. Looking back ends at
the rule's last match, so that the time grows with the text alone. Matches of a
rule do not overlap; one that is too short uses up its characters and is dropped.

Defined cases: null or empty text has no spans; offsets are code points, end
exclusive; texts of any length are read whole; spans that begin alike are in the
order of the rules; repeated rows each give their row; an empty table gives none;
columns other than the key and the text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from anamnesis.llm.common import map_texts, table
from anamnesis.llm.dfa import Dfa, compile_rules, earliest, longest


@dataclass(frozen=True)
class Rule:
    """kind; pattern; least length of the whole match, or of what follows ``lead``."""

    kind: str
    pattern: str
    least: int = 1
    lead: str = ""


def _either(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_WORDS = "(" + "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")]) + ")"
_LEAD = _WORDS + "[\"']?\\x20*[:=]\\x20*[\"']?"

#: The base rules first, then those that this scan adds. Least lengths stand
#: beside the patterns: counters of several rules would multiply the states.
RULES = (
    Rule("assign", _LEAD + "[A-Za-z0-9+/_.=-]+", 12, _LEAD),
    Rule("access", "AKIA[A-Z0-9]+", 18),
    Rule("hex", "[0-9a-f]{16,}", 16),
    Rule("pem", "-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 25),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 40),
)
BASE = ("assign", "access", "hex")


class Scanner:
    """The compiled rules; small enough to travel with the task."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.all = compile_rules([r.pattern for r in rules], resets=True)
        self.ahead: list[Dfa] = [compile_rules([r.pattern], anchored=True) for r in rules]
        self.back: list[Dfa] = [compile_rules([r.pattern], anchored=True, mirrored=True) for r in rules]
        self.lead: list[Dfa | None] = [compile_rules([r.lead], anchored=True) if r.lead else None for r in rules]

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        """(start, rule's number, end) in code points, in that order."""
        data = text.encode("utf-8", "surrogatepass")
        trans, state, first, resets = self.all.table, self.all.start, self.all.first, self.all.resets
        taken, found, due = [0] * len(self.rules), [], []
        view, at, size = memoryview(data), 0, len(data)
        while at < size:
            # Up to the next end of a match, where a rule is forgotten.
            stop = min([taken[k] for k in due], default=size)
            i = at - 1
            for i, b in enumerate(view[at:stop], at):
                state = trans[state + b]
                if state >= first and (new := [k for k in self.all.accepts[state] if i >= taken[k]]):
                    for k in new:
                        start = earliest(self.back[k], data, i + 1, taken[k])
                        end = taken[k] = longest(self.ahead[k], data, start)
                        after = longest(self.lead[k], data, start) if self.lead[k] else start
                        if end - after >= self.rules[k].least:
                            found.append((start, k, end))
                        due.append(k)
                    break
            at = i + 1
            for k in due:
                if taken[k] == at:
                    state = resets[k][state >> 8]
            due = [k for k in due if taken[k] > at]
        if len(data) == len(text):
            return sorted(found)
        place, at, chars = {}, 0, 0
        for p in sorted({x for s, _, e in found for x in (s, e)}):
            chars += len(data[at:p].decode("utf-8", "surrogatepass"))
            at, place[p] = p, chars
        return sorted((place[s], k, place[e]) for s, k, e in found)


def _row(scanner: Scanner) -> Callable[[str], tuple]:
    kinds = [r.kind for r in scanner.rules]
    base = [k for k, kind in enumerate(kinds) if kind in BASE]

    def row(text: str) -> tuple:
        found = scanner.scan(text)
        say = lambda spans: ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)
        digest = hashlib.sha256(say([x for x in found if x[1] in base]).encode()).hexdigest()
        return (*(sum(k == b for _, k, _ in found) for b in base), digest, say(found))

    return row


def find_secrets(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """A row for each document with its spans; one narrow pass, no shuffle."""
    scanner = scanner or Scanner()
    return map_texts(docs, lambda: _row(scanner), "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
