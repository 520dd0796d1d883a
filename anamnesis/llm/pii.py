"""Personal data by a semi-Markov conditional random field.

A text's lines are cut into words (runs without ASCII white space). A word is
active if it holds a digit, an at sign or a spoken sign such as ``[at]``; the
neighbours of a spoken sign are active too. A candidate entity is a segment of up
to ``LONGEST`` words of one line that begins and ends with active ones, stripped of
surrounding punctuation. Whole-span features (digit count, checksum, separators,
shape, the word before) score it for every type, a transition weight scores each
two neighbouring segments' types, and any other word is an outside segment. The
dynamic programme over boundaries and types is exact: candidates cannot reach over
a line end or over more than ``LONGEST - 2`` inactive words, and outside words in a
row score nothing, so it falls apart into islands. Weights are fitted here by
gradient ascent on the segmentation likelihood of generated sentences.

Plain patterns give the base spans, which always stay; the field's spans that
touch no base span are added.

Defined cases: null or empty text has no spans; offsets are code points, end
exclusive; a text of any length is read whole, in time that grows with it, long
words and numbers included; of segmentations that score alike the one with more
outside words is taken; repeated rows each give their row; an empty table gives
none; no columns other than the key and the text are read by ``detect``, and extra
columns pass through ``redact_documents`` whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.llm.common import map_texts, table

KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
BASE = KINDS[:4]
#: Words that an entity may span; the bound of the dynamic programme.
LONGEST = 6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SPOKEN = re.compile(r"(?i)[(\[{](?:at|dot)[)\]}]")
# Begins with a class, for which the engine skips ahead.
_MARK = re.compile(r"[0-9@(\[{](?:(?<=[0-9@])|(?i:at|dot)[)\]}])")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BLANK = re.compile(r"[\x20\x09\x0B-\x0D]*")
_SPACES = " \t\n\v\f\r"


def _byte(digits: str) -> bool:
    """Whether a number, however long it is written, is at most 255."""
    plain = digits.lstrip("0")
    return len(plain) < 3 or len(plain) == 3 and plain <= "255"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, from each at sign outwards: linear in the text."""
    taken, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            taken = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the plain patterns, sorted."""
    found = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(map(_byte, m[0].split("."))):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if 14 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


_SHAPES = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")),
    ("spoken_email", re.compile(r"(?i)[a-z0-9._-]+ ?[(\[]at[)\]] ?[a-z0-9-]+(?: ?[(\[]dot[)\]] ?[a-z0-9]+|\.[a-z]+)+")),
    ("quad", re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")),
    ("plus", re.compile(r"\+[0-9][0-9 ().-]+")),
    ("area", re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}")),
    ("three_two_four", re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")),
    ("iban", re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")),
    ("digits_only", re.compile(r"[0-9]+")),
    ("digit_groups", re.compile(r"[0-9]+(?:[ -][0-9]+)+")),
    ("decimal", re.compile(r"[0-9]+[.,:/][0-9]+")),
)
_HINTS = {
    "phone": frozenset("phone tel telephone call fax mobile".split()),
    "ssn": frozenset("ssn social".split()),
    "card": frozenset("card visa mastercard amex".split()),
    "iban": frozenset("iban account".split()),
    "ip": frozenset("ip host address server".split()),
    "email": frozenset("email mail contact".split()),
}
_HINT_WORDS = frozenset().union(*_HINTS.values())


def _iban_valid(text: str) -> bool:
    plain = text.replace(" ", "")
    moved = "".join(str(int(c, 36)) for c in plain[4:] + plain[:4])
    return int(moved) % 97 == 1


def span_features(span: str, before: str, words: int) -> list[str]:
    """Features of a whole candidate span and the word before it."""
    digits = re.sub("[^0-9]", "", span)
    found = ["bias", f"words{words}", f"digits{min(len(digits), 20)}"]
    shapes = [name for name, p in _SHAPES if p.fullmatch(span)]
    found += [f"shape:{name}" for name in shapes] or ["shape:none"]
    if 14 <= len(digits) <= 19 and not re.search("[^0-9 -]", span):
        found.append(f"luhn:{luhn(digits)}")
    if "quad" in shapes:
        found.append(f"bytes:{all(map(_byte, span.split('.')))}")
    if "iban" in shapes:
        found.append(f"mod97:{_iban_valid(span)}")
    if re.search("[^0-9A-Za-z @.+()_%-]", span):
        found.append("odd")
    word = _hint_word(before)
    found += [f"hint:{kind}" for kind, hints in _HINTS.items() if word in hints]
    return found


def _hint_word(before: str) -> str:
    """The word before as it stands in a list of hints, or nothing."""
    word = before[-20:].lower().strip(":.,;()#")
    return word if word in _HINT_WORDS else ""


#: Spans of up to 64 characters whose scores a task remembers.
REMEMBERED = 20_000
_EDGE = ".,;:!?\"'<>[]{}|*#$%&"


Words = list[tuple[int, int, bool]]


def _active_words(text: str) -> Iterator[tuple[int, int]]:
    """Words with a mark, and those beside a spoken sign; each once, in order."""
    done, forced = 0, False
    while True:
        if forced:
            left = _BLANK.match(text, done).end()
            if left == len(text) or text[left] == "\n":
                forced = False
                continue
        else:
            m = _MARK.search(text, done)
            if not m:
                return
            left = m.start()
            while left > done and text[left - 1] not in _SPACES:
                left -= 1
        right = _WORD.match(text, left).end()
        forced = _SPOKEN.search(text, left, right) is not None
        if forced:
            end = left
            while end > done and text[end - 1] in _SPACES and text[end - 1] != "\n":
                end -= 1
            start = end
            while start > done and text[start - 1] not in _SPACES:
                start -= 1
            if start < end:
                yield start, end
        yield left, right
        done = right


def islands(text: str) -> Iterator[Words]:
    """Runs of words (start, end, active) that candidates can touch."""
    run: Words = []
    for left, right in _active_words(text):
        if run:
            last = run[-1][1]
            between = [] if text.find("\n", last, left) >= 0 else [m.span() for m in _WORD.finditer(text, last, left)]
            if text.find("\n", last, left) >= 0 or len(between) > LONGEST - 2:
                yield run
                run = []
            else:
                run += [(a, b, False) for a, b in between]
        run.append((left, right, True))
    if run:
        yield run


Candidate = tuple[int, int, int, int, list[str]]


def _word_before(text: str, at: int) -> str:
    """The word of the same line that ends before a place, or nothing."""
    while at and text[at - 1] in _SPACES:
        at -= 1
        if text[at] == "\n":
            return ""
    start = at
    while start and text[start - 1] not in _SPACES:
        start -= 1
    return text[start:at]


def segments(text: str, run: Words) -> Iterator[tuple[int, int, int, int, str]]:
    """(first word, word after, start, end, word before) of an island's segments."""
    for i, (left, _, active) in enumerate(run):
        if not active:
            continue
        before = text[run[i - 1][0] : run[i - 1][1]] if i else _word_before(text, left)
        for j in range(i + 1, min(i + LONGEST, len(run)) + 1):
            if not run[j - 1][2]:
                continue
            span = text[left : run[j - 1][1]]
            start = left + len(span) - len(span.lstrip(_EDGE))
            end = left + len(span.rstrip(_EDGE))
            if start < end and _MARK.search(text, start, end):
                yield i, j, start, end, before


def candidates(text: str, run: Words) -> list[Candidate]:
    """(first word, word after, start, end, features) of an island's segments."""
    return [(i, j, s, e, span_features(text[s:e], before, j - i)) for i, j, s, e, before in segments(text, run)]


#: A kind and a feature, or two neighbouring segments' kinds.
Weights = dict[tuple[str, str], float]
OUT = "out"


def _scores(cands: list[Candidate], weights: Weights) -> list[list[float]]:
    return [[sum(weights.get((kind, f), 0.0) for f in c[4]) for kind in KINDS] for c in cands]


def step_weight(weights: Weights, left: str, right: str) -> float:
    """The score of two neighbouring segments' kinds; outside words in a row have none."""
    return weights.get((left, "then " + right), 0.0)


class Field:
    """The weights ready for decoding."""

    def __init__(self, weights: Weights) -> None:
        self.weights = weights
        every = (*KINDS, OUT)
        self.step = {(a, b): step_weight(weights, a, b) for a in every for b in every}
        # The most that a segment's steps can add over outside words in its place.
        self.most = [
            max(self.step[a, k] - self.step[a, OUT] for a in every) + max(self.step[k, b] - self.step[OUT, b] for b in every)
            for k in KINDS
        ]
        self.known: dict[tuple[str, str, int], list[tuple[str, float]]] = {}

    def scores(self, span: str, before: str, words: int) -> list[tuple[str, float]]:
        """The kinds that can beat outside words, with the span's score; the others
        are in no best segmentation."""
        before = _hint_word(before)
        key = span, before, words
        found = self.known.get(key)
        if found is None:
            feats = span_features(span, before, words)
            own = [sum(self.weights.get((kind, f), 0.0) for f in feats) for kind in KINDS]
            found = [(kind, x) for kind, x, most in zip(KINDS, own, self.most, strict=True) if x + most > 0]
            if len(span) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[key] = found
        return found

    def decode(self, text: str, run: Words) -> list[tuple[int, int, int]]:
        """The best segmentation of an island: (start, kind's number, end)."""
        ends: dict[int, list[tuple[int, int, int, list[tuple[str, float]]]]] = defaultdict(list)
        for i, j, s, e, before in segments(text, run):
            if own := self.scores(text[s:e], before, j - i):
                ends[j].append((i, s, e, own))
        if not ends:
            return []
        step = self.step
        # best[j]: for the kind of the segment that ends at j, score, segment and kind before.
        best: list[dict[str, tuple[float, tuple[int, int, int] | None, str]]] = [{OUT: (0.0, None, "")}]
        # leads[i]: for a segment's kind, the best way to its first word.
        leads: list[dict[str, tuple[float, str]]] = [{} for _ in run]
        for j in range(1, len(run) + 1):
            before = best[-1]
            if len(before) == 1:
                now = {OUT: (before[OUT][0] + step[OUT, OUT], None, OUT)}
            else:
                score, kind = max((v[0] + step[k, OUT], k) for k, v in before.items())
                now = {OUT: (score, None, kind)}
            for i, s, e, own in ends.get(j, ()):
                lead = leads[i]
                for kind, x in own:
                    if kind not in lead:
                        lead[kind] = max((v[0] + step[k, kind], k) for k, v in best[i].items())
                    score, last = lead[kind]
                    if kind not in now or score + x > now[kind][0]:
                        now[kind] = (score + x, (i, s, e), last)
            best.append(now)
        found, j = [], len(run)
        kind = max(best[j], key=lambda k: (best[j][k][0] + step[k, OUT], k == OUT))
        while j:
            _, c, last = best[j][kind]
            if c:
                found.append((c[1], KINDS.index(kind), c[2]))
            j, kind = (c[0] if c else j - 1), last
        return found[::-1]


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _card(r: random.Random) -> str:
    body = "4" + _digits(r, 14)
    full = next(body + c for c in "0123456789" if luhn(body + c))
    sep = r.choice(["", " ", "-"])
    return sep.join(full[i : i + 4] for i in range(0, 16, 4))


def _iban(r: random.Random) -> str:
    body = _digits(r, 18)
    code = 98 - int(body + "131400") % 97
    plain = f"DE{code:02d}{body}"
    return r.choice([plain, " ".join(plain[i : i + 4] for i in range(0, len(plain), 4))])


def examples(count: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated sentences with the spans planted in them, and numbers that are no one's."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abdeinorstuhlm") for _ in range(r.randint(2, 9)))
    make = {
        "email": lambda: r.choice([f"{word()}.{_digits(r, 2)}@{word()}{r.choice(['', '3'])}.{r.choice(['com', 'org', 'example.net'])}", f"{word()} [at] {word()}{_digits(r, 1)}.org", f"{word()}.{word()} [at] {word()}.com", f"{word()} (at) {word()} (dot) org", f"{word()}{_digits(r, 2)}(at){word()}(dot)com"]),
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": lambda: _card(r),
        "phone": lambda: r.choice([f"+1 ({_digits(r, 3)}) 555-{_digits(r, 4)}", f"+{_digits(r, 2)} {_digits(r, 3)} {_digits(r, 7)}", f"({_digits(r, 3)}) {_digits(r, 3)}-{_digits(r, 4)}", f"{_digits(r, 3)}-{_digits(r, 3)}-{_digits(r, 4)}", f"{_digits(r, 3)}.{_digits(r, 3)}.{_digits(r, 4)}"]),
        "ssn": lambda: f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}",
        "iban": lambda: _iban(r),
    }
    plain = [
        lambda: _digits(r, r.randint(1, 13)), lambda: f"{_digits(r, 2)}.{_digits(r, 2)}", lambda: f"{r.randint(1900, 2099)}-{_digits(r, 2)}-{_digits(r, 2)}", lambda: f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}",
        lambda: f"{_digits(r, 2)}:{_digits(r, 2)}", lambda: f"${_digits(r, 4)}", lambda: f"{_digits(r, 16)[:15]}x", lambda: f"{r.randint(256, 999)}.{_digits(r, 3)}.{_digits(r, 3)}.{_digits(r, 3)}", lambda: f"@{word()}", lambda: f"{word()}{_digits(r, 3)}",
        lambda: f"{_digits(r, 3)} {_digits(r, 3)}", lambda: f"{_digits(r, 2)} {_digits(r, 3)} {_digits(r, 4)}", lambda: f"{_digits(r, 4)}/{_digits(r, 2)}", lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)),
    ]
    hints = {k: sorted(v) for k, v in _HINTS.items()}
    out = []
    for _ in range(count):
        text, spans = " ".join(word() for _ in range(r.randint(1, 4))), []
        for _ in range(r.randint(1, 2)):
            if r.random() < 0.55:
                kind = r.choice(KINDS)
                if kind == "ssn" or r.random() < 0.3:
                    text += " " + r.choice(hints[kind]) + r.choice(["", ":"])
                value = make[kind]()
                spans.append((len(text) + 1, KINDS.index(kind), len(text) + 1 + len(value)))
            else:
                value = r.choice(plain)()
            text += " " + value + r.choice(["", ".", ",", "###"]) + "".join(" " + word() for _ in range(r.randint(0, 4)))
        out.append((text, spans))
    return out


def _sums(n: int, cands: list[Candidate], scores: list[list[float]], step: dict[tuple[str, str], float]) -> tuple[list[list[float]], dict[tuple[str, str], float], float]:
    """Each candidate's probability of each kind and the expected number of each step,
    by forward and backward sums over all segmentations; and their sum's logarithm."""
    starting: dict[int, list[int]] = defaultdict(list)
    ending: dict[int, list[int]] = defaultdict(list)
    for x, c in enumerate(cands):
        starting[c[0]].append(x)
        ending[c[1]].append(x)
    ahead: list[dict[str, float]] = [{OUT: 1.0}]
    for j in range(1, n + 1):
        now = {OUT: sum(v * step[k, OUT] for k, v in ahead[j - 1].items())}
        for x in ending[j]:
            for t, kind in enumerate(KINDS):
                way = sum(v * step[k, kind] for k, v in ahead[cands[x][0]].items())
                now[kind] = now.get(kind, 0.0) + way * scores[x][t]
        ahead.append(now)
    back: list[dict[str, float]] = [{} for _ in range(n)] + [{k: step[k, OUT] for k in (*KINDS, OUT)}]
    for i in range(n - 1, -1, -1):
        for k in ahead[i]:
            back[i][k] = step[k, OUT] * back[i + 1][OUT] + sum(step[k, kind] * scores[x][t] * back[cands[x][1]][kind] for x in starting[i] for t, kind in enumerate(KINDS))
    total = back[0][OUT]
    inside = [[scores[x][t] * back[c[1]][kind] / total * sum(v * step[k, kind] for k, v in ahead[c[0]].items()) for t, kind in enumerate(KINDS)] for x, c in enumerate(cands)]
    steps: dict[tuple[str, str], float] = defaultdict(float)
    for j in range(n + 1):
        for k, v in ahead[j].items():
            steps[k, OUT] += v * step[k, OUT] * (back[j + 1][OUT] if j < n else 1.0) / total
            for x in starting[j]:
                for t, kind in enumerate(KINDS):
                    steps[k, kind] += v * step[k, kind] * scores[x][t] * back[cands[x][1]][kind] / total
    return inside, steps, math.log(total)


@lru_cache(maxsize=4)
def fit(count: int = 500, rounds: int = 10, rate: float = 0.4, decay: float = 1e-3, seed: int = 7) -> Weights:
    """Weights by stochastic ascent on the log likelihood of whole segmentations.

    The gradient is seen minus expected, of features and of steps between kinds.
    """
    data = []
    for text, spans in examples(count, seed):
        planted = {(s, e): k for s, k, e in spans}
        for run in islands(text):
            cands = candidates(text, run)
            truth = [planted.get((c[2], c[3])) for c in cands]
            at = {c[0]: (c[1], KINDS[k]) for c, k in zip(cands, truth, strict=True) if k is not None}
            seen: dict[tuple[str, str], float] = defaultdict(float)
            i, last = 0, OUT
            while i < len(run):
                i, kind = at.get(i, (i + 1, OUT))
                seen[last, kind] += 1
                last = kind
            seen[last, OUT] += 1
            data.append((len(run), cands, truth, seen))
    weights: Weights = defaultdict(float)
    pairs = [(a, b) for a in (*KINDS, OUT) for b in (*KINDS, OUT)]
    for turn in range(rounds):
        pace = rate / (1 + 0.3 * turn)
        for n, cands, truth, seen in data:
            scores = [[math.exp(min(s, 30.0)) for s in row] for row in _scores(cands, weights)]
            step = {p: math.exp(step_weight(weights, *p)) for p in pairs}
            inside, steps, _ = _sums(n, cands, scores, step)
            for c, p, k in zip(cands, inside, truth, strict=True):
                for t, kind in enumerate(KINDS):
                    pull = pace * ((t == k) - p[t])
                    if abs(pull) > 1e-6:
                        for f in c[4]:
                            weights[kind, f] += pull - pace * decay * weights[kind, f]
            for a, b in pairs:
                pull = pace * (seen.get((a, b), 0.0) - steps.get((a, b), 0.0))
                if (a, b) != (OUT, OUT) and abs(pull) > 1e-6:
                    weights[a, "then " + b] += pull - pace * decay * weights[a, "then " + b]
    return dict(weights)


def find_spans(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and the field's spans that touch none of them."""
    base = base_spans(text)
    starts = [s for s, _, _ in base]
    reach = [0]
    for _, _, e in base:
        reach.append(max(reach[-1], e))
    added = []
    for run in islands(text):
        # Touching nothing: every base span that begins before its end has ended.
        added += [x for x in field.decode(text, run) if reach[bisect_left(starts, x[2])] <= x[0]]
    return base, added


def redact(text: str, field: Field) -> str:
    """The text with every span, overlapping ones joined, replaced by its kind."""
    base, added = find_spans(text, field)
    out, at = [], 0
    for s, k, e in sorted(base + added):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def detect(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """A row for each document with its spans; one narrow pass, no shuffle."""
    weights = weights or fit()

    def start() -> Callable[[str], tuple]:
        field = Field(weights)
        say = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)

        def row(text: str) -> tuple:
            base, added = find_spans(text, field)
            counts = [sum(k == b for _, k, _ in base) for b in range(len(BASE))]
            return (*counts, hashlib.sha256(say(base).encode()).hexdigest(), say(sorted(base + added)))

        return row

    return map_texts(docs, start, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_documents(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """The documents with spans masked in ``text`` and ``n_chars`` to match.

    Texts without spans, and null texts, stay as they are.
    """
    weights = weights or fit()
    keep = tuple(c for c in docs.columns if c != "text")
    null = "__text_is_null"
    marked = docs.withColumn(null, F.col("text").isNull())

    def start() -> Callable[[str], tuple]:
        field = Field(weights)
        return lambda text: (redact(text, field),)

    masked = map_texts(marked, start, "text string", (*keep, null))
    masked = masked.withColumn("text", F.when(~F.col(null), F.col("text")))
    changed = {"n_chars": F.coalesce(F.length("text").cast("long"), F.col("n_chars"))} if "n_chars" in keep else {}
    return masked.withColumns(changed).select(*docs.columns)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
