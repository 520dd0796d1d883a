"""Near duplicates by SimHash fingerprints with a pigeonring filter.

A fingerprint is cut into a ring of five segments. If two fingerprints differ in
at most four bits, some start on the ring has, for every length l, differences
within l * 4 / 5 over the l segments from there: none in the first, one at most
in the first two, and so on. Two segments that differ in one bit at most agree in
one half of the second, so the join key is a start's segment with a half of the
next: ten keys a fingerprint, of about 19 bits. Over ``NARROW`` fingerprints the
third segment, of at most two differences, joins the key with two of its quarters:
sixty keys of about 26 bits, with the same pairs. The chains of two to four are
tested on the joined pair, then the whole Hamming distance.

Copies are grouped before anything is joined, fingerprints that differ within
one block of four bits are linked as stars (a group has at most 16 of them), and
the join gives only pairs that those links have not joined yet, so that a large
group of copies does not become all its pairs.

Four bits are few for texts that are only four fifths alike. ``near_texts`` asks for
a similarity of word shingles instead: the fingerprints' components are one source
of candidates, bands of minimum hashes the other; in each bucket of either the
texts are compared exactly with the one that meets most others and with the
oldest, and those that are like neither again among themselves, as long as that
finds links. That joins most of a large group cheaply, and is no condition: every
pair that is alike and not in one class by then is found by an exact join. In one
order of all shingles two texts that are alike share one of the first fifth of
each (its prefix). The order takes shingles that many texts have last; it is read
from counts by hashed cells, and any order gives the same pairs. Pairs of one class
are left out; lengths, places and parities of shingles (whose differing bits are at
most the differing shingles) drop only pairs that cannot be alike, the rest are
compared exactly.

Defined cases: null or empty text has fingerprint zero, linked like any other; a
null id has a fingerprint and component null, and its row stays in ``keep_one``;
different texts under one id are linked only if they are alike; repeated rows each
give their row, of which ``keep_one`` keeps one; of rows that differ elsewhere than
in id and text the one of the least hash stays; texts of any length are read whole;
an empty table gives none; other columns pass through whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anamnesis.llm.common import dropped_shuffles, map_texts, release, settle, settle_narrow, small_batches, table
from anamnesis.llm.components import connected

SHINGLE, SEED, BITS, DISTANCE = 4, 42, 64, 4
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BLOCK = 65_536
#: Up to so many fingerprints the join takes the shorter keys.
NARROW = 1 << 21
#: What ``near_texts`` asks for: words of a shingle and least similarity.
WORDS, ALIKE = 5, 0.8
#: Bands of minimum hashes and hashes of a band: of texts four fifths alike all but
#: one in two hundred pairs share a band.
BANDS, ROWS = 10, 4
#: Cells by which shingles are counted for their order, bits of the parity that a
#: prefix's rows carry, and such rows a task.
CELLS, PARITY, PREFIX_ROWS = 1 << 20, 512, 400_000


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingles(parts: list[bytes], words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of all words if they are fewer."""
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    count = len(parts) - words + 1
    starts = [0, *ends[: count - 1].tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64)


def _majority(hashes: np.ndarray) -> int:
    """Unsigned 64 bits: each is set if it is in over half the hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        ones += np.unpackbits(hashes[i : i + _BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str, words: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64 bits: each is set if it is in over half the shingles' hashes."""
    return _majority(shingles(_words(text), words, seed))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(distance: int) -> list[int]:
    """Bit masks of a ring of distance + 1 segments that cover 64 bits."""
    count = distance + 1
    cuts = [i * BITS // count for i in range(count + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]


def _parts(mask: int, count: int) -> list[int]:
    """The masks of a segment's parts of near equal size, from low to high."""
    places = [b for b in range(BITS) if mask >> b & 1]
    cuts = [i * len(places) // count for i in range(count + 1)]
    return [sum(1 << b for b in places[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


def _ring_keys(ring: list[int], wide: bool) -> list[tuple[int, int]]:
    """(start, mask): pairs within the ring's budgets agree in some start's mask."""
    count, keys = len(ring), []
    for i in range(count):
        for half in _parts(ring[(i + 1) % count], 2):
            thirds = [a | b for a, b in combinations(_parts(ring[(i + 2) % count], 4), 2)] if wide else [0]
            keys += [(i, ring[i] | half | third) for third in thirds]
    return keys


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one narrow pass."""

    def start() -> Callable[[str], tuple]:
        return lambda text: (_signed(fingerprint(text, words)),)

    return map_texts(docs, start, "fp long")


def _stars(nodes: DataFrame) -> DataFrame:
    """Edges among fingerprints that are equal outside one block of four bits."""
    blocks = [_signed((1 << 64) - 1 ^ (15 << i)) for i in range(0, BITS, 4)]
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("rest")) for i, m in enumerate(blocks)])
    groups = nodes.select("fp", F.explode(keys).alias("key")).groupBy("key").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    linked = groups.select(F.explode("fps").alias("hi"), F.array_min("fps").alias("lo"))
    return linked.filter("hi > lo")


def _ring_pairs(nodes: DataFrame, distance: int, wide: bool = False) -> DataFrame:
    """Edges between labels of fingerprints within the distance, not joined before."""
    ring = _masks(distance)
    count = len(ring)
    chain = [[_signed(sum(ring[(i + j) % count] for j in range(n))) for n in range(1, count + 1)] for i in range(count)]
    keys = [(i, _signed(mask)) for i, mask in _ring_keys(ring, wide)]
    both = F.array(*[F.struct(F.lit(n).cast("byte").alias("key"), F.col("fp").bitwiseAND(F.lit(mask)).alias("part")) for n, (_, mask) in enumerate(keys)])
    left = nodes.select(F.explode(both).alias("k"), "fp", "label").select("k.*", "fp", "label")
    right = left.select(*[F.col(c).alias(f"b_{c}") for c in left.columns])
    apart = F.col("fp").bitwiseXOR(F.col("b_fp"))
    near = (F.col("fp") < F.col("b_fp")) & (F.col("label") != F.col("b_label"))
    for n in range(2, count):
        mask = F.element_at(F.array(*[F.lit(chain[i][n - 1]) for i, _ in keys]), F.col("key").cast("int") + 1)
        near &= F.bit_count(apart.bitwiseAND(mask)) <= n * distance // count
    near &= F.bit_count(apart) <= distance
    on = (F.col("key") == F.col("b_key")) & (F.col("part") == F.col("b_part"))
    return left.join(right, on & near).select(F.greatest("label", "b_label").alias("hi"), F.least("label", "b_label").alias("lo"))


def linked_prints(prints: DataFrame, distance: int = DISTANCE, narrow: int = NARROW) -> DataFrame:
    """(fp, class) of distinct fingerprints: a class is the least one reachable."""
    nodes = settle_narrow(prints.select("fp").distinct(), BITS // 4)
    first = connected(_stars(nodes))
    wide = nodes.count() > narrow
    labelled = settle_narrow(nodes.join(first, nodes.fp == first.node, "left").select("fp", F.coalesce("component", "fp").alias("label")), 60 if wide else 10)
    second = connected(_ring_pairs(labelled, distance, wide))
    return labelled.join(second, labelled.label == second.node, "left").select("fp", F.coalesce("component", "label").alias("class"))


def near_duplicates(docs: DataFrame, words: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) of every row.

    Rows of one fingerprint meet only in a minimum that is aggregated before the
    shuffle, and in a join on the fingerprint whose large keys Spark can split.
    """
    prints = settle(fingerprints(docs, words))
    ids = prints.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id"))
    classes = settle(ids.join(linked_prints(prints.filter("doc_id IS NOT NULL"), distance), "fp"))
    named = classes.join(classes.groupBy("class").agg(F.min("id").alias("component_id")), "class").select("fp", "component_id")
    joined = prints.join(named, "fp", "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _signature(words: int) -> Callable[[str], tuple]:
    """A text's 128-bit key (words alone count), fingerprint and bands."""
    draw = np.random.default_rng(SEED)
    factor = draw.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)

    def row(text: str) -> tuple:
        parts = _words(text)
        key = xxhash.xxh3_128_digest(b" ".join(parts))
        hashes = shingles(parts, words)
        if not len(hashes):
            return key, 0, []
        least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(hashes), 4096):
            least = np.minimum(least, (hashes[i : i + 4096, None] * factor + shift).min(0))
        raw = least.tobytes()
        size = ROWS * 8
        return key, _signed(_majority(hashes)), [_signed(xxhash.xxh64_intdigest(raw[i * size : (i + 1) * size], i)) for i in range(BANDS)]

    return row


def _sets(hashed: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(key, set) of the wanted texts (doc_id, h, key)."""

    def shingle_set() -> Callable[[str], tuple]:
        return lambda text: (np.unique(shingles(_words(text), words)).view(np.int64).tolist(),)

    # An id with a text may stand on several rows.
    sets = map_texts(hashed.join(wanted, ["doc_id", "h"]), shingle_set, "set array<long>", ("key",))
    # Ten numbers of a set weigh as much as a narrow row.
    return settle_narrow(sets.groupBy("key").agg(F.min("set").alias("set")), 1 + F.size("set") / 10)


def _alike(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges whose texts' shingle sets have at least the similarity."""
    both = edges.join(sets.select(F.col("key").alias("hi"), F.col("set").alias("a")), "hi").join(sets.select(F.col("key").alias("lo"), F.col("set").alias("b")), "lo")
    common = F.size(F.array_intersect("a", "b"))
    return both.filter(common >= similarity * (F.size("a") + F.size("b") - common) - 1e-9).select("hi", "lo")


def _joined_classes(classes: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(node, component) after more edges: only the classes that these touch are linked anew."""
    if classes is None:
        return connected(edges)
    hi = classes.select(F.col("node").alias("hi"), F.col("component").alias("a"))
    lo = classes.select(F.col("node").alias("lo"), F.col("component").alias("b"))
    ends = edges.join(hi, "hi", "left").join(lo, "lo", "left").select(F.coalesce("a", "hi").alias("a"), F.coalesce("b", "lo").alias("b")).filter("a != b")
    more = connected(ends.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")))
    moved = classes.join(more.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return moved.unionByName(more.join(classes.select("node"), "node", "left_anti"))


def _levels(docs: DataFrame, words: int) -> np.ndarray:
    """How frequent the shingles of each cell are: 0 for no more than the mean and its
    scatter, else the bits of the count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 100):
                found = [shingles(_words(x or ""), words) for x in b.column(0).slice(i, 100).to_pylist()]
                counts += np.bincount((np.concatenate(found) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        rows = np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32).reshape(256, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array([x.tobytes() for x in rows], pa.binary())], names=["block", "counts"])

    def total(parts: pa.Table) -> pa.Table:
        summed = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in parts.column("counts").to_pylist())
        return pa.table({"block": parts.column("block")[:1], "counts": pa.array([summed.tobytes()], pa.binary())})

    small_batches(docs)
    with dropped_shuffles(docs.sparkSession):
        rows = docs.select("text").mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(total, "block int, counts binary").collect()
    counts = np.zeros((256, CELLS // 256), np.int64)
    for r in rows:
        counts[r.block] = np.frombuffer(r.counts, np.int64)
    counts, mean = counts.ravel(), counts.mean()
    return np.where(counts > mean + 4 * math.sqrt(mean) + 4, np.ceil(np.log2(counts + 1)), 0).astype(np.int8)


def _prefix(text: str, words: int, similarity: float, levels: np.ndarray) -> tuple:
    """A text's key, the number of its different shingles, the first of them in the order
    (of which it shares one with every text like it), and the parities of their hashes."""
    parts = _words(text)
    key = xxhash.xxh3_128_digest(b" ".join(parts))
    own = np.unique(shingles(parts, words))
    n = len(own)
    if not n:
        return key, int.from_bytes(key[:8], "big", signed=True), 0, [], b""
    order = np.lexsort((own, levels[(own & np.uint64(CELLS - 1)).astype(np.int64)]))
    first = own[order[: n - math.ceil(similarity * n - 1e-9) + 1]]
    bits = max(PARITY, 1 << (n - 1).bit_length())
    odd = np.bincount((own >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return key, int.from_bytes(key[:8], "big", signed=True), n, first.view(np.int64).tolist(), np.packbits(odd.astype(bool)).tobytes()


def _folded(odd: bytes, size: int) -> np.ndarray:
    """Parities by fewer bits, so many bytes: what a cell of each part has adds up."""
    return np.bitwise_xor.reduce(np.frombuffer(odd, np.uint8).reshape(-1, size), axis=0)


def _columns(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    full = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(full).combine_chunks() if full else None


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, id, place) of the shingles that texts of two classes have in their prefixes."""
    rows = _columns(batches)
    if rows is None:
        return
    token, kind = rows.column("token").to_numpy(), rows.column("class").to_numpy()
    order = np.lexsort((kind, token))
    token, kind = token[order], kind[order]
    begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    count = np.diff(np.append(begin, len(token)))
    mixed = np.repeat(kind[begin] != kind[begin + count - 1], count)
    yield from rows.take(pa.array(order[mixed])).select(["token", "id", "place"]).to_batches(100_000)


def _pairs_of(rows: pa.Table, similarity: float) -> pa.Table:
    """(a, b): pairs of a token's texts of two classes that may be alike, each once.

    Rows are sorted by token and size, and each meets those one, two, ... rows on,
    as long as these have its token and are not too long."""
    columns = {c: rows.column(c).to_numpy() for c in ("token", "id", "place", "size", "class")}
    order = np.lexsort((columns["id"], columns["size"], columns["token"]))
    token, id_, place, size, kind = (x[order] for x in columns.values())
    size = size.astype(np.int64)
    odd = np.frombuffer(b"".join(rows.column("odd").to_pylist()), np.uint64).reshape(len(order), -1)[order]
    at, lag, found, held = np.arange(len(order)), 1, [np.zeros((0, 2), np.int64)], 0
    share = similarity / (1 + similarity)
    while True:
        at = at[at + lag < len(order)]
        # Sizes ascend: a row that has met one too long meets no more.
        at = at[(token[at] == token[at + lag]) & (size[at] >= similarity * size[at + lag] - 1e-9)]
        if not len(at):
            break
        for i in range(0, len(at), 1 << 18):
            x = at[i : i + (1 << 18)]
            y = x + lag
            both, px, py = size[x] + size[y], place[x], place[y]
            # Of the shared ones before this no more than the lesser place, after it no more than the lesser rest.
            most = np.minimum(px, py) + 1 + np.minimum(size[x] - px - 1, size[y] - py - 1)
            near = (kind[x] != kind[y]) & (most >= share * both - 1e-6)
            x, y, both = x[near], y[near], both[near]
            near = np.bitwise_count(odd[x] ^ odd[y]).sum(1) <= (1 - 2 * share) * both + 1e-6
            pair = np.sort(np.stack([id_[x[near]], id_[y[near]]], 1), axis=1)
            found.append(pair)
            held += len(pair)
            if held > 1 << 20:
                found = [np.unique(np.concatenate(found), axis=0)]
                held = len(found[0]) // 2
        lag += 1
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _others(docs: DataFrame, classes: DataFrame | None, words: int, similarity: float) -> DataFrame:
    """(hi, lo): keys of all pairs of texts of different classes that may be alike: an exact join."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(_levels(docs, words))

    def start() -> Callable[[str], tuple]:
        levels = sent.value
        return lambda text: _prefix(text, words, similarity, levels)

    schema = "key binary, id long, size int, first array<long>, odd binary"
    made = map_texts(docs.select("text"), start, schema, ())
    # Equal keys have equal rows.
    once = made.groupBy("key").agg(*[F.first(c).alias(c) for c in ("id", "size", "first", "odd")])
    if classes is not None:
        once = once.join(classes, once.key == classes.node, "left").select(once["*"], F.xxhash64(F.coalesce("component", "key")).alias("class"))
    else:
        once = once.withColumn("class", F.xxhash64("key"))
    base = settle(once)
    with dropped_shuffles(spark):
        rows = base.agg(F.sum(F.size("first"))).first()[0] or 0
    each = base.select("id", "class", F.posexplode("first").alias("place", "token")).select("token", "id", "place", "class")
    shared = settle(each.repartition(rows // PREFIX_ROWS + 1, "token").mapInArrow(_shared, "token long, id long, place int"))
    with dropped_shuffles(spark):
        rows = shared.count()

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            short = [_folded(x, PARITY // 8).tobytes() for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(short, pa.binary())], names=["id", "size", "class", "odd"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _columns(batches)
        if rows is not None:
            yield from _pairs_of(rows, similarity).to_batches(100_000)

    def may_be_alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hi, lo, n, odds, others = b.columns
            keep = []
            for n_, x, y in zip(n.to_pylist(), odds.to_pylist(), others.to_pylist(), strict=True):
                size = min(len(x), len(y))
                keep.append(int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()) <= (1 - similarity) / (1 + similarity) * n_ + 1e-6)
            yield pa.RecordBatch.from_arrays([hi, lo], names=["hi", "lo"]).filter(pa.array(keep, pa.bool_()))

    narrow = base.filter("size > 0").select("id", "size", "class", "odd").mapInArrow(folded, "id long, size int, class long, odd binary")
    met = shared.join(narrow, "id").select("token", "id", "place", "size", "class", "odd").repartition(rows // PREFIX_ROWS + 1, "token")
    pairs = settle(met.mapInArrow(meet, "a long, b long").distinct())
    whole = base.select("id", "key", "size", "odd")
    one, two = (whole.select(F.col("id").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("key", "size", "odd")]) for c in "ab")
    ends = pairs.join(one, "a").join(two, "b").filter("a_key != b_key")
    near = ends.select(F.greatest("a_key", "b_key").alias("hi"), F.least("a_key", "b_key").alias("lo"), (F.col("a_size") + F.col("b_size")).alias("n"), "a_odd", "b_odd")
    done = settle_narrow(near.mapInArrow(may_be_alike, "hi binary, lo binary").distinct())
    release(base, shared, pairs)
    sent.unpersist()
    return done


def near_texts(docs: DataFrame, words: int = WORDS, similarity: float = ALIKE) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): (doc_id, h, key) of every row with an id, and (key, first, class)
    of every different text, where first is the least (doc_id, h) and class the
    least key that chains of sufficiently similar texts reach."""
    hashed = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    rows = settle_narrow(map_texts(hashed, lambda: _signature(words), "key binary, fp long, bands array<long>", ("doc_id", "h")), BANDS)
    texts = settle_narrow(rows.groupBy("key").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.min("fp").alias("fp"), F.min("bands").alias("bands")), BANDS)
    simhashed = texts.join(linked_prints(texts), "fp").select("key", "first", F.concat("bands", F.array("class")).alias("bands"))
    long = settle_narrow(simhashed.select("key", "first", F.posexplode("bands").alias("band", "value")))
    met = long.groupBy("band", "value").agg(F.count("*").alias("n")).filter("n > 1")
    members = long.join(met, ["band", "value"])
    degree = members.groupBy("key").agg(F.sum("n").alias("degree"))
    members = settle_narrow(members.drop("n").join(degree, "key"))
    # Only texts that meet others are cut into shingles again.
    sets = _sets(hashed, members.select("first.doc_id", "first.h", "key").distinct(), words)
    left, classes = members, None
    while True:
        pivots = left.groupBy("band", "value").agg(F.count("*").alias("n"), F.max(F.struct("degree", "key")).alias("top"), F.min(F.struct("first", "key")).alias("oldest")).filter("n > 1")
        met = left.join(pivots.select("band", "value", F.array_distinct(F.array("top.key", "oldest.key")).alias("pivots")), ["band", "value"])
        pairs = met.select("key", F.explode("pivots").alias("pivot")).filter("key != pivot")
        edges = pairs.select(F.greatest("key", "pivot").alias("hi"), F.least("key", "pivot").alias("lo")).distinct()
        alike = settle_narrow(_alike(edges, sets, similarity))
        if alike.isEmpty():
            break
        classes = settle_narrow(_joined_classes(classes, alike))
        # Who is in a class with a pivot of the bucket has been linked; the others go on.
        named = left.join(classes, left.key == classes.node, "left").select(left["*"], F.coalesce("component", "key").alias("class"))
        tops = pivots.select("band", "value", F.explode(F.array_distinct(F.array("top.key", "oldest.key"))).alias("pivot"))
        done = tops.join(classes, tops.pivot == classes.node, "left").select("band", "value", F.coalesce("component", "pivot").alias("class")).distinct()
        rest = settle_narrow(named.join(done, ["band", "value", "class"], "left_anti").select(*left.columns))
        release(left, alike)
        left = rest
    release(long, left, alike, sets)
    # Whatever pairs the buckets and their pivots have missed.
    pairs = _others(hashed, classes, words, similarity)
    if not pairs.isEmpty():
        ends = pairs.select(F.explode(F.array("hi", "lo")).alias("key")).distinct()
        sets = _sets(hashed, texts.join(ends, "key").select("first.doc_id", "first.h", "key"), words)
        alike = settle_narrow(_alike(pairs, sets, similarity))
        release(sets)
        if not alike.isEmpty():
            classes = settle_narrow(_joined_classes(classes, alike))
    release(pairs)
    if classes is None:
        return rows, texts.select("key", "first", F.col("key").alias("class"))
    named = texts.join(classes, texts.key == classes.node, "left")
    return rows, named.select("key", "first", F.coalesce("component", "key").alias("class"))


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = ALIKE) -> DataFrame:
    """One row of each class of near texts, that with the least id; rows with a null id stay."""
    rows, texts = near_texts(docs, words, similarity)
    firsts = texts.groupBy("class").agg(F.min("first").alias("first")).select("first.doc_id", "first.h")
    counted = settle(rows.groupBy("doc_id", "h").agg(F.count("*").alias("__n")).join(firsts, ["doc_id", "h"]).withColumnRenamed("h", "__h"))
    kept = docs.withColumn("__h", F.xxhash64(F.coalesce("text", F.lit("")))).join(counted, ["doc_id", "__h"])
    whole = F.struct(*[F.col(c) for c in docs.columns])
    # Rows that repeat an id and its text meet in a minimum, summed before the shuffle.
    again = kept.filter("__n > 1").groupBy("doc_id", "__h").agg(F.min_by(whole, F.xxhash64(*[F.col(c) for c in docs.columns])).alias("row"))
    one = kept.filter("__n = 1").select(*docs.columns).unionByName(again.select("row.*"))
    return one.unionByName(docs.filter("doc_id IS NULL"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
