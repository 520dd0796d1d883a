"""Text scalars as column expressions: tokens, keys, redaction, dates, spans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of structured personal data and what replaces them, in order.
REDACTIONS = (
    (r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "[REDACTED_EMAIL]"),
    (r"(?U)\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]"),
    (r"(?U)\b(?:\d[ -]?){13,16}\b", "[REDACTED_CARD]"),
    (r"(?U)\bsk-[A-Za-z0-9]{16,}\b", "[REDACTED_KEY]"),
    (r"(?U)\b(?:AKIA|ghp_|gho_|xoxb-)[A-Za-z0-9-]{10,}\b", "[REDACTED_KEY]"),
    (r"(?iU)\bbearer\s+[A-Za-z0-9._-]{12,}\b", "[REDACTED_TOKEN]"),
)
# The relation labels that are kept; others become the last.
RELATIONS = ("caused_by", "occurred_during", "subtopic_of", "associated_with")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_NAMES = "|".join([*MONTHS, "sept", *[m[:3] for m in MONTHS]])
CAPS = r"(?U)\b[A-Z][a-zA-Z0-9]*(?:\s+[A-Z][a-zA-Z0-9]*)*\b"
UNIT = "\x1f"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), "")


def normalized(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def idempotency_key(tenant: Column, agent: Column, session: Column, turn: Column, content: Column) -> Column:
    """Digest of what identifies a turn; a missing session counts as ''."""
    parts = [tenant, agent, F.coalesce(session.cast("string"), F.lit("")), turn.cast("string"), content]
    return F.sha2(F.concat_ws(UNIT, *parts), 256)


def step_key(tenant: Column, agent: Column, tool: Column, outcome: Column) -> Column:
    return F.sha2(F.concat_ws(UNIT, tenant, agent, tool, outcome), 256)


def redacted(text: Column) -> Column:
    return reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), REDACTIONS, text)


def caps_spans(text: Column) -> Column:
    """Distinct runs of capitalised words of two characters or more, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CAPS), F.lit(0))
    return F.array_distinct(F.filter(found, lambda x: F.length(x) > 1))


def relation(label: Column) -> Column:
    norm = F.translate(F.lower(F.trim(label)), " -", "__")
    return F.when(norm.isin(*RELATIONS), norm).otherwise(RELATIONS[-1])


def _month(name: Column) -> Column:
    short = F.substr(F.lower(name), F.lit(1), F.lit(3))
    return F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), short)


def valid_time(text: Column) -> Column:
    """The first explicit date, by the first form that occurs at all: ISO, month
    day year, month year, year; an impossible date is null."""
    forms = [
        (r"(?U)\b(\d{4})-(\d{2})-(\d{2})\b", lambda g: (g(1), g(2), g(3))),
        (rf"(?iU)\b({_NAMES})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b", lambda g: (g(3), _month(g(1)), g(2))),
        (rf"(?iU)\b({_NAMES})\.?\s+(\d{{4}})\b", lambda g: (g(2), _month(g(1)), F.lit("1"))),
        (r"(?U)\b(1[89]\d{2}|20\d{2})\b", lambda g: (g(1), F.lit("1"), F.lit("1"))),
    ]
    out = F.lit(None).cast("timestamp")
    for pattern, parts in reversed(forms):
        group = lambda i, p=pattern: F.regexp_extract(text, p, i)
        year, month, day = (F.lpad(x.cast("string"), n, "0") for x, n in zip(parts(group), (4, 2, 2), strict=True))
        date = F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-MM-dd"))
        out = F.when(text.rlike(pattern), date).otherwise(out)
    return out


def snake_case(text: Column) -> Column:
    """First line as a relation name; none, blank and the generic label are ''."""
    line = F.lower(F.trim(F.split(F.coalesce(text, F.lit("")), "\n")[0]))
    slug = F.regexp_replace(F.regexp_replace(line, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(slug.isin("none", "", "associated_with"), "").otherwise(slug)


def list_lines(text: Column, most: int) -> Column:
    """Lines without bullets or numbers, first of equal ones kept, at most ``most``."""
    plain = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]+|\d+[.)])\s*", "")))
    some = F.filter(plain, lambda x: x != "")
    first = F.filter(some, lambda x, i: F.array_position(F.transform(some, lambda y: F.lower(y)), F.lower(x)) == i + 1)
    return F.slice(first, 1, most)


def agent_allowed(agent: Column, allowed: Column) -> Column:
    """Exact names, or prefixes that end in an asterisk."""
    return F.exists(allowed, lambda p: F.when(p.endswith("*"), agent.startswith(F.regexp_replace(p, r"\*$", ""))).otherwise(agent == p))


def scope_rank(scope: Column) -> Column:
    return F.when(scope == "read", 0).when(scope == "write", 1).when(scope == "consolidate", 2)


def token_cost(text: Column) -> Column:
    """Tokens of a text for budgets: its words; a tokenizer's count may take its place."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != ""))
