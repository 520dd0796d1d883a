"""Mixing to target weights with soft membership.

A classifier fitted on the labels table gives each document a posterior over
domains. Nonnegative document rates are then fitted so that the expected tokens
of each domain, the sum of tokens * rate * posterior, meet targets: least
squares by projected gradient steps. A step's gradient for a document needs only
its own row and the domains' residuals, so a step is one aggregation over a
narrow table; the residuals and second moments (a few numbers a step) are all
that reaches the driver, and a document's rate is the fold of its row over them.
Steps go on until the targets are met or the residual no longer falls; what then
is left is a column of the result, and ``totals`` lists targets beside what was
reached. Where documents of one kind only cannot give the target shares, it is
not zero.

No document is drawn twice, so where a rate is over one all are drawn at their
rate divided by the greatest: the drawn tokens are that part of the fitted totals,
in the same shares.

The classifier is fitted on at most ``SAMPLE`` labelled documents, drawn by hash of
the id. One half of them counts in how many documents of each domain a hashed word
stem or a step of a text's shape stands; those that are surely more frequent in a
domain, by a number of deviations that shrinks small counts, weigh by their log
odds (naive Bayes). On the other half a multinomial logistic regression by Newton
steps turns the sums of weights into posteriors. Only DataFrame functions run.

Defined cases: null or empty text has no tokens and the posterior of its shape;
without labelled rows every domain is equally likely for every text; a document of
no tokens has the rate of its posterior; a null id is treated like any other; texts
of any length are read whole; equal texts have equal posteriors and rates, but are
drawn by their own ids; repeated rows each give their row and are drawn alike; an
empty table gives none; clashing columns pass through ``mixed_documents``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.llm.common import settle, table

DOMAINS = ("good", "low", "toxic")
#: Target shares of the tokens; the first domain keeps its expected total.
WEIGHTS = {"good": 0.92, "low": 0.04, "toxic": 0.04}
#: Upper shares of what is drawn.
DRAWN = {"good": 0.95, "low": 0.03, "toxic": 0.02}
SAMPLE, VOCABULARY = 6000, 256
#: Characters of a word that count: word families share their beginning.
STEM = 5
BUCKETS = 1 << 16
#: Deviations over chance from which a feature weighs.
SURE = 2.5
ENOUGH, MOST_STEPS = 1e-5, 200
_CUT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _numbers(values: Sequence[float], kind: str) -> Column:
    """A constant array; one parsed expression, however long."""
    return F.expr(f"cast(array({', '.join(map(repr, values))}) as array<{kind}>)")


def words_of(text: Column) -> Column:
    """Lower-case words, cut at ASCII characters that are no letters or digits."""
    return F.array_remove(F.split(F.lower(text), _CUT), "")


def features(text: Column, words: Column) -> Column:
    """Distinct numbers: hashed stems of a text's words, and over BUCKETS the steps of its shape."""
    stems = F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(F.substr(w, F.lit(1), F.lit(STEM))), F.lit(BUCKETS)).cast("int")))
    size = F.greatest(F.length(text), F.lit(1))
    count = lambda chars: size - F.length(reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), chars, text))
    # A measure has all steps up to its value, so that rare high ones count together.
    upto = lambda nth, value, most: F.slice(_numbers([BUCKETS + 32 * nth + i for i in range(most)], "int"), F.lit(1), F.least(F.ceil(value), F.lit(most)).cast("int"))
    # The stems are computed once and their number read beside them.
    return F.transform(F.array(stems), lambda s: F.concat(
        s,
        upto(0, count("#*$%&|<>") * 50 / size, 6),
        upto(1, count("!") * 50 / size, 6),
        upto(2, F.greatest(F.lit(12) - F.log2(size), F.lit(0)), 12),
        upto(3, F.greatest(F.lit(12) - F.floor(F.size(s) * 60 / size), F.lit(0)), 13),
    ))[0]


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(domain, features) of at most ``most`` labelled documents.

    Toxic rows are of the last domain, other rows of the first or second by
    quality. The ids are bounded by ``most``, so they are broadcast.
    """
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    rated = labels.select("doc_id", domain.alias("domain")).filter("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy("doc_id").agg(F.max("domain").alias("domain"))
    drawn = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id").select("domain", "text", words_of(F.col("text")).alias("words")).select("domain", features(F.col("text"), F.col("words")).alias("features"))


class Classifier:
    """Features with a weight for each domain but the first, and the logistic
    coefficients (constant and a number a weighed sum) of each of these domains."""

    def __init__(self, chosen: list[int], weights: list[list[float]], coefficients: np.ndarray) -> None:
        self.chosen, self.weights, self.coefficients = chosen, weights, coefficients

    @classmethod
    def fit(cls, sample: DataFrame, vocabulary: int = VOCABULARY) -> Classifier:
        """Counts meet in aggregations; the driver gets at most ``vocabulary`` counted
        features a domain, and a count for each domain and sums, of which the sample's
        second half has at most a row's each."""
        sample = settle(sample.withColumn("half", F.pmod(F.xxhash64("features"), F.lit(2))))
        rest = range(1, len(DOMAINS))
        sizes = {r.domain: r.n for r in sample.filter("half = 0").groupBy("domain").agg(F.count("*").alias("n")).collect()}
        total = sum(sizes.values())
        long = sample.filter("half = 0").select("domain", F.explode("features").alias("feature"))
        counts = settle(long.groupBy("feature").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("domain") == d, 1)).alias(f"n{d}") for d in range(len(DOMAINS))]))
        found: dict[int, list[int]] = {}
        for d in rest:
            share = sizes.get(d, 0) / max(total, 1)
            if 0 < share < 1:
                sure = (F.col(f"n{d}") - F.col("n") * share - 1) / F.sqrt(F.col("n") * share * (1 - share) + 1)
                top = counts.withColumn("sure", F.round(sure, 6)).filter(F.col("sure") >= SURE).orderBy(F.desc("sure"), "feature").limit(vocabulary)
                found |= {r.feature: [r[f"n{k}"] for k in range(len(DOMAINS))] for r in top.collect()}
        chosen = sorted(found)
        rate = lambda f, d: (found[f][d] + (sum(found[f]) + 1) / (total + 2)) / (sizes.get(d, 0) + 1)
        weights = [[round(math.log(rate(f, d) / rate(f, 0)), 9) for f in chosen] for d in rest]
        self = cls(chosen, weights, np.zeros((len(rest), len(rest) + 1)))
        cells = sample.filter("half = 1").select("domain", self.sums(F.col("features")).alias("s")).groupBy("domain", "s").agg(F.count("*").alias("n"))
        self._newton([(r.domain, r.s, r.n) for r in cells.collect()])
        return self

    def sums(self, feats: Column) -> Column:
        """A weighed sum for each domain but the first, each within 20."""
        if not self.chosen:
            return F.array(*[F.lit(0.0) for _ in self.weights])
        chosen, weights = _numbers(self.chosen, "int"), [_numbers(w, "double") for w in self.weights]
        places = F.transform(F.array_intersect(chosen, feats), lambda f: F.array_position(chosen, f).cast("int"))
        add = lambda w: F.aggregate(F.transform(places, lambda i: F.element_at(w, i)), F.lit(0.0), lambda a, x: a + x)
        return F.array(*[F.least(F.greatest(add(w), F.lit(-20.0)), F.lit(20.0)) for w in weights])

    def _logits(self, s: Column) -> list[Column]:
        return [reduce(lambda a, b: a + b, [F.lit(float(c[0])), *[float(c[i + 1]) * s[i] for i in range(len(self.weights))]]) for c in self.coefficients]

    def _softmax(self, s: Column) -> Column:
        """A probability a domain, in the order of DOMAINS, of an array of sums."""
        powers = F.array(F.lit(1.0), *[F.exp(F.least(x, F.lit(40.0))) for x in self._logits(s)])
        return F.transform(F.array(powers), lambda e: F.transform(e, lambda x: x / reduce(lambda a, b: a + b, [e[i] for i in range(len(DOMAINS))])))[0]

    def _newton(self, cells: list[tuple[int, list[float], int]], ridge: float = 0.05, rounds: int = 100) -> None:
        """Maximum likelihood with a small ridge; cells: domain, sums, count."""
        k, width = self.coefficients.shape
        if not cells:
            return
        x = np.array([[1.0, *s] for _, s, _ in cells])
        n = np.array([c for *_, c in cells], float)
        seen = np.array([[float(d == a + 1) for a in range(k)] for d, *_ in cells])
        for _ in range(rounds):
            powers = np.exp(np.minimum(x @ self.coefficients.T, 40.0))
            p = powers / (1 + powers.sum(1, keepdims=True))
            grad = ((seen - p) * n[:, None]).T @ x - ridge * self.coefficients
            hess = ridge * np.eye(k * width)
            for a in range(k):
                for b in range(k):
                    share = n * p[:, a] * (float(a == b) - p[:, b])
                    hess[a * width : (a + 1) * width, b * width : (b + 1) * width] += (x * share[:, None]).T @ x
            move = np.linalg.solve(hess, grad.ravel())
            # A long way is cut, so that the steps cannot swing.
            move *= min(1.0, 4.0 / max(np.abs(move).max(), 1e-12))
            self.coefficients = self.coefficients + move.reshape(k, width)
            if np.abs(move).max() < 1e-6:
                return

    def posteriors(self, feats: Column) -> Column:
        """A probability a domain, in the order of DOMAINS."""
        return F.transform(F.array(self.sums(feats)), lambda s: self._softmax(s))[0]


def _dot(p: Column, pull: Column | Sequence[float]) -> Column:
    return reduce(lambda a, b: a + b, [p[d] * pull[d] for d in range(len(DOMAINS))])


def _rate(p: Column, pulls: Sequence[Sequence[float]]) -> Column:
    """A document's rate after steps: one each at first, moved against p * pull, never under zero."""
    if not pulls:
        return F.lit(1.0)
    steps = F.array(*[F.array(*map(F.lit, map(float, pull))) for pull in pulls])
    # p travels in the fold's state, so that it is computed once a row.
    first = F.struct(p.alias("p"), F.lit(1.0).alias("rate"))
    step = lambda acc, pull: F.struct(acc["p"].alias("p"), F.greatest(acc["rate"] - _dot(acc["p"], pull), F.lit(0.0)).alias("rate"))
    return F.aggregate(steps, first, step, lambda acc: acc["rate"])


def fit_rates(members: DataFrame, weights: dict[str, float] = WEIGHTS, upper: bool = False) -> tuple[list[list[float]], dict[str, tuple[float, float]]]:
    """The steps' pulls that move every rate from one to its fitted value, and for
    each domain the target and what is reached, in tokens.

    members: tokens and p (an array). With ``upper`` the weights of all domains but the
    first are upper shares: a domain that has less is not raised. Residuals are measured by the inverse of the
    tokens' second moments of p. A step takes these moments over the documents
    whose rate is over zero, as the others cannot follow, and is halved while the
    residual does not fall.
    """
    size = len(DOMAINS)
    p, tokens = F.col("p"), F.col("tokens")

    def look(pulls: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        rate = _rate(p, pulls)
        live = members.select("tokens", "p", rate.alias("rate"))
        sums = [F.sum(tokens * p[i] * F.col("rate")) for i in range(size)]
        second = [F.sum(F.when(F.col("rate") > 0, tokens * p[i] * p[j])) for i in range(size) for j in range(size)]
        row = live.agg(*[F.coalesce(c, F.lit(0.0)) for c in sums + second]).first()
        return np.array(row[:size]), np.array(row[size:]).reshape(size, size)

    pulls: list[list[float]] = []
    now, moments = look(pulls)
    total = float(now.sum())
    if total <= 0:
        return [], dict.fromkeys(DOMAINS, (0.0, 0.0))
    share = np.array([weights.get(d, 0.0) for d in DOMAINS])
    target = share * now[0] / share[0] if share[0] > 0 else share / share.sum() * total
    if upper:
        target = np.concatenate([target[:1], np.minimum(target[1:], now[1:])])
    metric = np.linalg.pinv(moments / total + 1e-9 * np.eye(size))
    worth = lambda v: float((v - target) @ metric @ (v - target)) / total**2
    while np.abs(now - target).max() > ENOUGH * total:
        if len(pulls) == MOST_STEPS:
            raise RuntimeError(f"the rates still move after {MOST_STEPS} steps")
        # Over the live documents' moments, and if that way is too long over all documents'.
        ways = (np.linalg.pinv(moments / total + 1e-9 * np.eye(size)), metric)
        lengths = [(way, halved) for way in ways for halved in range(12)]
        for way, halved in lengths:
            tried = [*pulls, (way @ (now - target) / total / 2**halved).tolist()]
            there, second = look(tried)
            if worth(there) < worth(now) * (1 - 1e-4):
                break
        else:
            break
        pulls, now, moments = tried, there, second
    return pulls, {d: (float(target[i]), float(now[i])) for i, d in enumerate(DOMAINS)}


class Mixture:
    """A fitted classifier and fitted rates, usable on any rows of the corpus.

    With ``carry`` the documents' rows are kept beside their posteriors, so that
    ``drawn`` reads no text again.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, carry: bool = False, upper: bool = False) -> None:
        self.classifier = Classifier.fit(labelled_sample(docs, labels))
        self.members = settle(self.membership(docs, carry))
        self.pulls, self.totals = fit_rates(self.members.select("tokens", "p"), weights, upper)
        self._part: float | None = None

    def membership(self, docs: DataFrame, carry: bool = False) -> DataFrame:
        """doc_id, tokens, p, and the whole row if it is to be carried."""
        row = [F.struct(*[F.col(c) for c in docs.columns]).alias("row")] if carry else []
        kept = ["row"] if carry else []
        text = F.coalesce("text", F.lit(""))
        cut = docs.select("doc_id", text.alias("text"), words_of(text).alias("words"), *row)
        cut = cut.select("doc_id", F.size("words").cast("long").alias("tokens"), features(F.col("text"), F.col("words")).alias("features"), *kept)
        return cut.select("doc_id", "tokens", self.classifier.posteriors(F.col("features")).alias("p"), *kept)

    def residual(self) -> float:
        """The greatest distance of a domain's tokens from its target, as a share of all targets."""
        whole = sum(t for t, _ in self.totals.values())
        return max(abs(n - t) for t, n in self.totals.values()) / whole if whole else 0.0

    def rates(self) -> DataFrame:
        """doc_id, tokens, a posterior a domain, rate, and the fit's residual."""
        named = [F.round(F.col("p")[i], 9).alias(f"p_{d}") for i, d in enumerate(DOMAINS)]
        return self.members.select("doc_id", "tokens", *named, F.round(_rate(F.col("p"), self.pulls), 6).alias("rate"), F.lit(round(self.residual(), 6)).alias("residual"))

    def part(self) -> float:
        """Part of the fitted totals that can be drawn without repeats."""
        if self._part is None:
            most = self.members.filter("tokens > 0").agg(F.max(_rate(F.col("p"), self.pulls))).first()[0]
            self._part = 1 / max(1.0, most or 1.0)
        return self._part

    def _chosen(self, p: Column) -> Column:
        """Whether a hash of id and text lies under the rate times part()."""
        draw = F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.lit(1_000_003)) / 1_000_003.0
        return draw < F.round(_rate(p, self.pulls) * self.part(), 6)

    def mixed_documents(self, docs: DataFrame) -> DataFrame:
        """The documents drawn at their rates times part(); none comes twice."""
        text = F.coalesce("text", F.lit(""))
        rated = docs.withColumn("__f", features(text, words_of(text))).withColumn("__p", self.classifier.posteriors(F.col("__f")))
        return rated.filter(self._chosen(F.col("__p"))).select(*docs.columns)

    def drawn(self) -> DataFrame:
        """``mixed_documents`` of the carried rows."""
        return self.members.select("row.*", F.col("p").alias("__p")).filter(self._chosen(F.col("__p"))).drop("__p")


def mix_documents(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = DRAWN) -> DataFrame:
    """The documents drawn at the rates that bring low and toxic ones down to their
    weights. What has less than its weight stays as it is: raising it would need
    repeats, and without repeats would drop part of all others."""
    return Mixture(docs, labels, weights, carry=True, upper=True).drawn()


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).rates()
