"""SimHash groups, components, and the whole pipeline's first stages against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from anamnesis.llm import common, simhash
from anamnesis.llm.components import connected


def plain_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, distance):
    name = {i: i for i in prints}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and bin((prints[a] ^ prints[b]) & (1 << 64) - 1).count("1") <= distance:
                x, y = find(a), find(b)
                name[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


def test_fingerprints(odd_rows):
    for _, t, *_ in odd_rows:
        if t is None or len(t) < 1000:
            assert simhash.fingerprint(t or "") == plain_print(t or "")


@pytest.mark.parametrize("narrow", [simhash.NARROW, 0])
def test_pairs_of_near_fingerprints_are_all_linked(spark, narrow):
    r = random.Random(4)
    prints = set()
    for _ in range(120):
        base = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 2, 5])):
            x = base
            for _ in range(r.randint(0, 6)):
                x ^= 1 << r.randrange(64)
            prints.add(x)
            base = x if r.random() < 0.5 else base
    want = groups({simhash._signed(x): simhash._signed(x) for x in prints}, 4)
    rows = spark.createDataFrame([(simhash._signed(x),) for x in prints] * 2, "fp long")
    got = {x.fp: x["class"] for x in simhash.linked_prints(rows, 4, narrow).collect()}
    assert got == want


@pytest.mark.parametrize("wide", [False, True])
def test_every_pair_within_four_bits_shares_a_key(wide):
    ring = simhash._masks(4)
    masks = [m for _, m in simhash._ring_keys(ring, wide)]
    assert len(masks) == (60 if wide else 10) and {bin(m).count("1") >= (24 if wide else 18) for m in masks} == {True}
    r = random.Random(1)
    for _ in range(20_000):
        apart = sum({1 << r.randrange(64) for _ in range(r.randint(0, 4))})
        assert any(not apart & m for m in masks)


def test_components_of_chains(spark):
    chain = [(i + 1, i) for i in range(0, 60)] + [(101, 100), (102, 100)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(chain, "hi long, lo long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[102] == 100
    assert connected(spark.createDataFrame([], "hi long, lo long")).count() == 0


@pytest.mark.parametrize("rows", [3, 100_000])
def test_classes_joined_in_turns(spark, monkeypatch, rows):
    monkeypatch.setattr(common, "ROWS_A_TASK", rows)
    draw = random.Random(5)
    turns = [[(a, b) for a, b in ((draw.randrange(60), draw.randrange(60)) for _ in range(n)) if a > b] for n in (12, 12, 20)]
    classes, parent = None, list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for edges in turns:
        classes = simhash._joined_classes(classes, spark.createDataFrame(edges, "hi long, lo long"))
        for a, b in edges:
            hi, lo = sorted((root(a), root(b)), reverse=True)
            parent[hi] = lo
    met = {x for edges in turns for e in edges for x in e}
    assert sorted(map(tuple, classes.collect())) == sorted((x, root(x)) for x in met)


def test_rows_and_kept(spark, odd, odd_rows, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(odd_rows)
    comp = {r.doc_id: r.component_id for r in rows}
    assert comp[None] is None and comp[1] == comp[2] == comp[6] == 1 and comp[3] == comp[4] == 3
    assert simhash.near_duplicates(none).count() == 0


def near_classes(texts):
    """Least id of each class of texts under any order of linking: brute force."""
    sets = {}
    for i, t in texts.items():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets[i] = {" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    name = {i: i for i in texts}
    for a in texts:
        for b in texts:
            if a < b and name[a] != name[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((name[a], name[b]))
                name = {i: low if n == high else n for i, n in name.items()}
    return name


def test_kept_of_odd_rows(spark, odd, odd_rows, none):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and simhash.keep_one(none).count() == 0
    ids = sorted([r.doc_id for r in kept.collect() if r.doc_id is not None])
    name = near_classes({i: t for i, t, *_ in odd_rows if i is not None})
    assert ids == sorted(set(name.values()))
    assert kept.filter(F.col("doc_id").isNull()).count() == 1


def test_an_id_of_different_texts_keeps_them_all(spark):
    one, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, one, "a"), (1, other, "b"), (1, other, "b"), (2, one + " end", "c"), (1, other, "d"), (3, None, "e"), (4, " ", "f")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = sorted((r.doc_id, r.text, r.lang in "bd") for r in kept.collect() if r.text)
    assert got == [(1, other, True), (1, one, False)] or got == [(1, one, False), (1, other, True)]
    assert [r.doc_id for r in kept.collect() if not r.text] == [3]


def test_edited_copies_go_and_others_stay(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    texts, family = {}, {}
    for f in range(40):
        base = [word() for _ in range(r.randint(60, 400))]
        for k in range(r.choice([1, 2, 3, 12])):
            w = list(base)
            for _ in range(0 if k == 0 else r.randint(1, max(1, len(w) // 60))):
                w[r.randrange(len(w))] = word()
            i = len(texts)
            texts[i], family[i] = " ".join(w), f
    order = list(texts)
    r.shuffle(order)
    df = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string")
    _, found = simhash.near_texts(df)
    got = {}
    for x in found.collect():
        got.setdefault(bytes(x["class"]), []).append(x["first"].doc_id)
    want = near_classes(texts)
    mine = {i: min(c) for c in got.values() for i in c}
    # Never a link that brute force has not, and nearly all that it has.
    assert all(want[i] == want[m] for i, m in mine.items())
    assert sum(mine[i] == want[i] for i in texts) >= 0.98 * len(texts)
    kept = {x.doc_id for x in simhash.keep_one(df).collect()}
    assert kept == set(mine.values()) and {family[i] for i in kept} == set(family.values())


def test_pairs_that_share_no_bucket_are_linked(spark):
    """Nine shingles of eleven are the same in a pair: bands miss one such pair in about two hundred."""
    texts = {}
    for k in range(1500):
        w = [f"w{k}x{j}" for j in range(14)]
        texts[2 * k], texts[2 * k + 1] = " ".join(w), " ".join([*w[:-1], f"v{k}"])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {x.doc_id for x in simhash.keep_one(df).collect()} == set(range(0, 3000, 2))


def test_classes_are_those_of_brute_force(spark):
    """Passages that many texts have, chains of edits, short and long texts, and pairs on either side of the limit."""
    r = random.Random(11)
    passage = [f"p{i}" for i in range(30)]
    texts = {}
    for f in range(25):
        base = [f"b{f}x{i}" for i in range(r.choice([3, 5, 9, 14, 40, 120, 700]))]
        if f % 3 == 0:
            base = base + passage
        for _ in range(r.choice([1, 2, 5])):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = f"e{len(texts)}x{r.random()}"
            if r.random() < 0.3:
                base = w
            texts[len(texts)] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = sorted(x.doc_id for x in simhash.keep_one(df).collect())
    assert kept == sorted(set(near_classes(texts).values()))
