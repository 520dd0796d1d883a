"""Quality, mixing, chat, media, pieces and pages."""

import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from anamnesis.llm import chat, html_text, mixing, pieces, png_media, quality


def plain_quality(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, odd, odd_rows, none):
    r = random.Random(7)
    extra = [(100 + i, " ".join(r.choice("abc") for _ in range(r.randint(0, 60))) + r.choice(["", "\nx y\nx y", " # | <b>"]), "en", "z", 1, "", "", 0) for i in range(150)]
    df = odd.unionByName(spark.createDataFrame(extra, odd.schema))
    rows = quality.verdicts(df.filter("doc_id IS NOT NULL")).collect()
    texts = {i: t or "" for i, t, *_ in odd_rows + extra}
    assert len(rows) == len([1 for i, *_ in odd_rows + extra if i is not None])
    for x in rows:
        want = plain_quality(texts[x.doc_id])
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (x.base_failed and x.kept)
    kept = quality.kept_documents(df)
    assert kept.columns == df.columns and quality.kept_documents(none).count() == 0 and quality.verdicts(none).count() == 0


def test_quality_thresholds_follow_the_group(spark):
    r = random.Random(1)
    plain = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows = [(i, plain(40) + " ###" * (10 if i % 10 == 0 else 0), "en", "clean") for i in range(100)]
    rows += [(1000 + i, " ".join(w + "##" for w in plain(40).split()), "en", "code") for i in range(100)]
    kept = {x.doc_id: x.kept for x in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[i] == (i % 10 != 0) for i in range(100)) and all(kept[1000 + i] for i in range(100))


def test_quality_limits_are_sketched_quantiles(spark):
    values = [random.Random(i).lognormvariate(0, 1) for i in range(2000)]
    row = lambda v: (v if v > 1 else 0.0, 0.0, 0.0, 0.0, v, 100 * v, 10 * v, v)
    names = (*quality.MEASURES, *quality.SIZES)
    df = spark.createDataFrame([("en", "a", False, row(v)) for v in values], "lang string, source string, base_failed boolean, measures struct<" + ",".join(f"{n}:double" for n in names) + ">")
    limits = quality.thresholds(quality.sketches(df)).filter("source IS NOT NULL").first().limits
    at = lambda x, q: np.quantile(x, q, method="inverted_cdf")
    q50, q90 = at(values, 0.5), at(values, 0.9)
    near = lambda a, b: abs(a - b) < 0.08 * b
    assert near(limits.word_size, q90 + 6 * (q90 - q50))
    plain = [row(v)[0] for v in values]
    assert near(limits.symbols, at(plain, 0.9) + 6 * (at(plain, 0.9) - at(plain, 0.5)))
    # Where most have none, an event in a text of median size is the width.
    assert near(limits.marks, 6 / (100 * q50)) and near(limits.dup_lines, 6 / q50) and near(limits.repeats, 6 * 16 / (10 * q50))


def test_quality_limits_of_zero_inflated_groups_follow_their_sizes(spark):
    r = random.Random(2)
    plain = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows = [(i, plain(40) + " #" * (i % 20 == 0) * 3, "en", "short") for i in range(200)]
    rows += [(1000 + i, plain(800) + " #" * (i % 20 == 0) * 40, "en", "long") for i in range(200)]
    rows += [(2000, plain(40) + " #" * 8, "en", "short"), (2001, plain(40) + " #", "en", "long"), (2002, plain(800) + " #" * 3, "en", "long"), (2003, plain(40) + " #" * 8, "en", "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    limits = {x.source: x.limits for x in quality.thresholds(quality.sketches(quality.measure(df))).filter("source IS NOT NULL").collect()}
    assert 15 < limits["short"].symbols / limits["long"].symbols < 25
    kept = {x.doc_id: x.kept for x in quality.verdicts(df).collect()}
    assert all(kept[i] for i in range(200)) and not any(kept[1000 + i] for i in range(0, 200, 20))
    assert not kept[2000] and kept[2001] and kept[2002] and not kept[2003]


def test_mixing_meets_targets(spark, none):
    r = random.Random(3)
    word = lambda: "".join(r.choice("aeioustrn") for _ in range(6))
    rows, labels = [], []
    for i in range(600):
        kind = i % 6
        text = " ".join(word() for _ in range(30))
        if kind == 4:
            text = " ".join(w + "###" for w in text.split())
        if kind == 5:
            text += " idiotic idiotic moronish"
        rows.append((i, text))
        if i % 2:
            labels.append((i, 0 if kind == 4 else 1, int(kind == 5)))
    labels += [(i, 0 if i % 6 == 4 else 1, int(i % 6 == 5)) for i in range(0, 600, 2) if i % 6 == 4]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = mixing.Mixture(docs, marks)
    got = m.rates().toPandas()
    assert len(got) == 600 and (got.rate >= 0).all()
    total = {d: float((got.tokens * got[f"p_{d}"] * got.rate).sum()) for d in mixing.DOMAINS}
    expected = float((got.tokens * got.p_good).sum())
    assert m.residual() < 0.02 and (got.residual == round(m.residual(), 6)).all()
    for d in mixing.DOMAINS:
        want = expected * mixing.WEIGHTS[d] / mixing.WEIGHTS["good"]
        assert abs(total[d] - want) < 0.02 * expected and abs(m.totals[d][0] - want) < 0.01 * expected
    # Posteriors of held-out documents, by kind.
    kinds = {0: "p_good", 4: "p_low", 5: "p_toxic"}
    for k, name in kinds.items():
        assert got[got.doc_id % 6 == k][name].mean() > 0.8
    kept = {x.doc_id for x in m.mixed_documents(docs).collect()}
    assert kept == {x.doc_id for x in mixing.Mixture(docs, marks, carry=True).drawn().collect()}
    # With upper shares a corpus that meets them keeps everything.
    assert mixing.mix_documents(docs, marks, {"good": 0.4, "low": 0.3, "toxic": 0.3}).count() > 0.93 * 600
    some = {x.doc_id for x in mixing.mix_documents(docs, marks).collect()}
    clean = {i for i in range(600) if i % 6 < 4}
    for drawn in (kept, some):
        assert len(drawn & clean) > 0.85 * len(clean) and len(drawn - clean) < 120
    empty = mixing.Mixture(none, marks.limit(0))
    assert empty.rates().count() == 0 and empty.mixed_documents(none).columns == none.columns


def test_mixed_tokens_are_one_part_of_the_fitted_totals(spark):
    """Soft posteriors: good documents' rates are over one, low ones' under it."""
    marked = {0: ("zebra", 0.8), 1: ("yak", 0.3)}
    docs = spark.createDataFrame([(i, f"{marked[i % 2][0]} " * 30) for i in range(4000)], "doc_id long, text string")
    m = mixing.Mixture(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    p = F.when(F.col("doc_id") % 2 == 0, F.array(*map(F.lit, (0.8, 0.2, 0.0)))).otherwise(F.array(*map(F.lit, (0.3, 0.7, 0.0))))
    m.members = m.members.withColumn("p", p)
    m.classifier.posteriors = lambda feats: F.when(F.array_contains(feats, F.pmod(F.xxhash64(F.lit("zebra")), F.lit(mixing.BUCKETS)).cast("int")), F.array(*map(F.lit, (0.8, 0.2, 0.0)))).otherwise(F.array(*map(F.lit, (0.3, 0.7, 0.0))))
    m.pulls, _ = mixing.fit_rates(m.members, {"good": 0.75, "low": 0.25, "toxic": 0.0})
    rates = m.rates().toPandas()
    most = rates.rate.max()
    assert most > 1.15 and abs(m.part() - 1 / most) < 1e-5
    drawn = {x.doc_id for x in m.mixed_documents(docs).collect()}
    kept = rates[rates.doc_id.isin(drawn)]
    for d in ("good", "low"):
        fitted, got = (rates.tokens * rates[f"p_{d}"] * rates.rate).sum(), (kept.tokens * kept[f"p_{d}"]).sum()
        assert abs(got - fitted * m.part()) < 0.03 * fitted


def nonnegative_least_squares(a, b):
    """Lawson and Hanson's active sets."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    while True:
        pull = a.T @ (b - a @ x)
        if free.all() or pull[~free].max() < 1e-9:
            return x
        free[np.argmax(np.where(free, -np.inf, pull))] = True
        while True:
            z = np.zeros_like(x)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if z[free].min() > 0:
                x = z
                break
            cut = free & (z <= 0)
            x = x + (x[cut] / (x[cut] - z[cut])).min() * (z - x)
            free &= x > 1e-12


@pytest.mark.parametrize("weights", [{"good": 0.8, "low": 0.15, "toxic": 0.05}, {"good": 0.65, "low": 0.3, "toxic": 0.05}])
def test_mixing_rates_are_least_squares(spark, weights):
    r = np.random.default_rng(3)
    p = r.dirichlet([4, 1, 0.5], 400)
    tokens = r.integers(1, 900, 400)
    members = spark.createDataFrame([(i, int(t), [float(x) for x in q]) for i, (t, q) in enumerate(zip(tokens, p))], "doc_id long, tokens long, p array<double>")
    pulls, totals = mixing.fit_rates(members, weights)
    rate = np.array([x.rate for x in members.select("doc_id", mixing._rate(F.col("p"), pulls).alias("rate")).orderBy("doc_id").collect()])
    a = (p * tokens[:, None]).T
    target, reached = (np.array([totals[d][i] for d in mixing.DOMAINS]) for i in (0, 1))
    assert (rate >= 0).all() and np.allclose(a @ rate, reached, rtol=1e-6)
    root = np.linalg.cholesky(np.linalg.inv((p * tokens[:, None]).T @ p / tokens.sum())).T
    best = nonnegative_least_squares(root @ a / tokens.sum(), root @ target / tokens.sum())
    worth = lambda x: float(np.square(root @ (a @ x - target) / tokens.sum()).sum())
    assert worth(rate) <= worth(best) * 1.05 + 1e-6


def test_mixing_handles_odd_rows(spark, odd, odd_rows):
    m = mixing.Mixture(odd, spark.createDataFrame([(3, 1, 0), (None, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int"))
    assert m.rates().count() == len(odd_rows) and m.mixed_documents(odd).columns == odd.columns


def plain_chat(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted(((t is not None, t if t is not None else 0, r or "", x or "") for k, t, r, x in rows if k == c))
        said, learned = "".join(f"{r}\n{x}\n" for *_, r, x in own), "".join(x for *_, r, x in own if r == "assistant")
        out[c] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    r = random.Random(1)
    rows = []
    for c in range(25):
        for i in range(r.choice([1, 2, 3, 9, 600])):
            role = "system" if i == 0 and r.random() < 0.5 else r.choice(["user", "assistant", "ro\nle\\", None])
            rows.append((c, i if r.random() < 0.97 else None, role, r.choice([None, "", "\\", "<|", "<\\+", "<", "|x", "a" * r.randint(1, 900), "<|im_end|>\n", "\\-\\+<|<|"])))
    rows += [rows[0]] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    w = chat.windows(df).cache()
    want = plain_chat(rows)
    got = chat.digests(w).collect()
    assert len(got) == len(want)
    for x in got:
        assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == want[x.conv_id]
    assert chat.digests(chat.windows(df.limit(0))).count() == 0


def test_chat_windows_keep_budget_and_system(spark):
    rows = [(1, i, "system" if i == 0 else "user" if i % 2 else "assistant", f"turn {i} " + "x" * 120) for i in range(60)]
    w = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 256, 80).orderBy("window").collect()
    assert len(w) > 5
    for x in w:
        assert x.formatted.startswith("<|im_start|>system\nturn 0 ")
        turns = x.formatted.split("<|im_end|>\n")[:-1]
        assert sum(-(-(len(t) - t.index("\n") - 1) // 4) + 4 for t in turns) <= 256
        assert x.tokens <= 256 and not x.over_budget
        for s in x.loss:
            assert re.match(r"turn \d+ x+$", x.formatted[s.start : s.end])


def test_chat_budget_holds_but_where_declared(spark):
    r = random.Random(5)
    rows = []
    for c in range(40):
        for i in range(r.choice([2, 9, 30, 300])):
            role = "system" if i == 0 and c % 2 else "user" if i % 2 else "assistant"
            size = r.choice([2000, 900, 100]) if role == "system" else 6000 if r.random() < 0.03 else r.randint(0, 500)
            rows.append((c, i, role, f"{c} {i} " + "y" * size))
    rows += [(None, i, "user" if i % 2 else "assistant", f"n {i}") for i in range(5)] + [(99, 0, "assistant", "z" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    cost = lambda t: -(-len(t) // 4) + 4
    system = {c: t for c, i, role, t in rows if i == 0 and role == "system"}
    seen = Counter()
    for x in chat.windows(df, 512, 96).collect():
        turns = [t[len("<|im_start|>") :].split("\n", 1) for t in x.formatted.split("<|im_end|>\n")[:-1]]
        assert x.tokens == sum(cost(t) for _, t in turns) and x.over_budget == (x.tokens > 512)
        new = turns[x.n_repeated :]
        if x.over_budget:
            # One turn alone, over the stride or the system turn.
            assert len(new) == 1 and cost(new[0][1]) > 512 - 96 - 256
        if x.conv_id in system and cost(system[x.conv_id]) <= 256:
            assert turns[0][1] == system[x.conv_id]
        elif x.conv_id in system:
            assert all(t != system[x.conv_id] for _, t in turns) or turns == [["system", system[x.conv_id]]]
        seen.update((x.conv_id, t) for _, t in new)
    assert seen == Counter((c, t) for c, _, _, t in rows)


def test_png_reads_every_filter_and_tests_sums():
    rng = np.random.default_rng(1)
    for _ in range(10):
        rows, kinds = rng.integers(0, 256, (20, 64)).astype(np.uint8), rng.integers(0, 5, 20).tolist()
        out = bytearray()
        for i, k in enumerate(kinds):
            out.append(k)
            for j in range(64):
                a, b = int(rows[i, j - 1]) if j else 0, int(rows[i - 1, j]) if i else 0
                c = int(rows[i - 1, j - 1]) if i and j else 0
                p = a + b - c
                paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
                out.append((int(rows[i, j]) - [0, a, b, (a + b) // 2, paeth][k]) % 256)
        data = png_media.SIGNATURE + png_media._chunk(b"IHDR", struct.pack(">II5B", 64, 20, 8, 0, 0, 0, 0)) + png_media._chunk(b"IDAT", zlib.compress(bytes(out))) + png_media._chunk(b"IEND", b"")
        assert (png_media.decode_png(data) == rows).all()
        broken = bytearray(data)
        broken[60] ^= 1
        with pytest.raises(ValueError):
            png_media.decode_png(bytes(broken))


def test_media_columns(odd, odd_rows, none):
    rows = png_media.media_columns(odd).collect()
    assert len(rows) == len(odd_rows) and png_media.media_columns(none).count() == 0
    for x, (_, t, *_) in zip(sorted(rows, key=lambda r: (r.doc_id or 0, r.n_bytes)), sorted(odd_rows, key=lambda r: (r[0] or 0, len((r[1] or "").encode())))):
        payload = png_media.pad((t or "").encode())
        assert x.n_bytes == len((t or "").encode()) and x.payload_bytes == len(payload) and len(payload) % 64 == 0
        assert x.payload_sha256 == hashlib.sha256(payload).hexdigest() and x.tail_crc32 == zlib.crc32(payload[-64:])
        assert x.media_sha256 == hashlib.sha256(bytes(x.media)).hexdigest()
    by = [x for x in rows if x.doc_id == 3]
    assert by[0] == by[1]


def test_near_pictures_have_near_hashes():
    rng = np.random.default_rng(0)
    smooth = np.cumsum(np.cumsum(rng.normal(size=(64, 64)), 0), 1)
    smooth = (255 * (smooth - smooth.min()) / np.ptp(smooth)).astype(np.uint8)
    noisy = np.clip(smooth.astype(int) + rng.integers(-3, 4, smooth.shape), 0, 255).astype(np.uint8)
    apart = bin(int(png_media.cosine_hash(smooth), 16) ^ int(png_media.cosine_hash(noisy), 16)).count("1")
    assert apart <= 4


def test_pieces_equal_the_library(odd, odd_rows, none):
    model = pieces.PieceModel(open(pieces.default_model_file(), "rb").read())
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model_file())
    r = random.Random(5)
    letters = "aabbeinorsth   \t\nÉéüßñ€\U0001d11e漢字.,!?0123456789\x00▁"
    for _ in range(3000):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 24)))
        assert model.encode(t) == sp.encode(t, add_eos=True)
        ids = [r.choice([r.randint(0, 31999), r.randint(3, 258)]) for _ in range(r.randint(0, 6))]
        assert model.decode(ids) == sp.decode(ids)
    for k in range(1, 70):
        assert model.encode(" " * k + "tx") == sp.encode(" " * k + "tx", add_eos=True)
    rows = {(x.doc_id, x.ids_sha256) for x in pieces.encode_documents(odd, pieces.default_model_file()).collect()}
    want = {(i, hashlib.sha256(" ".join(map(str, sp.encode(t or "", add_eos=True))).encode()).hexdigest()) for i, t, *_ in odd_rows}
    assert rows == want and pieces.encode_documents(none, pieces.default_model_file()).count() == 0


PAGE = "<html><head><title>x</title></head><body><header>Head</header><nav><a>Menu</a></nav>{}<footer>Foot</footer></body></html>"


def test_pages(spark):
    own = [f"<div class='box'>Site wide box</div><div><p>Story {i} &amp; more\n text<br>line<p>second <b>{i}</b></div><div class='comments'><p>no</p></div>" for i in range(10)]
    rows = [(i, "http://h.example/x", PAGE.format(b)) for i, b in enumerate(own)]
    rows += [(20, "http://other.example/", PAGE.format("<div class='box'>Site wide box</div><p>Alone</p>")), (21, None, None), (22, "", ""), (23, "http://h.example/", PAGE.format("<article><h1>T</h1><p>Site wide box</p></article>")), (23, "http://h.example/", "<p>cut &am")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("template", F.lit("clash"))
    got = [(x.page_id, x.text, x.n_chars) for x in html_text.extract(pages).collect()]
    assert len(got) == len(rows)
    text = {i: t for i, t, _ in got if i != 23}
    assert text[3] == "Story 3 & more text line\nsecond 3" and text[20] == "Site wide box\nAlone"
    assert text[21] == text[22] == "" and {t for i, t, _ in got if i == 23} == {"T\nSite wide box", "cut &am"}
    assert all(n == len(t) for _, t, n in got)
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("most", [html_text.MOST_BROADCAST, 0])
def test_page_templates_of_a_section(spark, monkeypatch, most):
    monkeypatch.setattr(html_text, "MOST_BROADCAST", most)
    layout = lambda i: f"<div>Box of layout {i % 8}</div>"
    rows = [(i, "http://H.example/x", PAGE.format((layout(i) if i < 48 else "") + f"<div>Story {i}</div><div>Seldom {i // 3}</div>")) for i in range(60)]
    rows += [(None, None, None), (70, "http://o.example/", PAGE.format(layout(0) + "<p>Alone</p>"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x.text for x in html_text.extract(pages).collect()}
    assert len(got) == len(rows) and got[None] == "" and got[70] == "Box of layout 0\nAlone"
    assert all(got[i] == f"Story {i}\nSeldom {i // 3}" for i in range(60))


def test_page_of_several_articles():
    page = PAGE.format("<p>List</p><article><p>One</p><article class='comment'><p>in</p></article></article><div><article id='b'><p>Two, longer</p></article></div><article class='related'><p>See this much longer other text</p></article>")
    assert html_text.blocks(html_text.parse(page)) == ["One", "in", "Two, longer"]
    assert html_text.blocks(html_text.parse(PAGE.format("<main><article><p>A</p></article><article><p>B</p></article></main>"))) == ["A", "B"]


def body_text(html):
    return "\n".join(html_text.blocks(html_text.parse(html)))


def test_pages_of_odd_markup():
    assert body_text('<p class="a"">Hello world</p>') == "Hello world"
    assert body_text("<p title='a>b' x=\"<p>\">One</p><p =x>Two</p><a href=\"x>y</a>\" >Three") == "One\nTwo\nThree"
    assert body_text('<div class="layout has-sidebar"><article><p>Text</p></article></div>') == "Text"
    assert body_text('<div class="sidebar-right"><main><p>Text</p></main></div>') == "Text"
    assert body_text('<p class="share-price">Up by 3</p><div class="share-buttons">Share</div><div id="cookieBanner">Ok</div>') == "Up by 3"
    assert body_text("<p>1 < 2 <> </ 3 <!x> <?y?> &lt;b&gt;</p><!--> <p>kept</p> <!-- gone --><p>cut <b") == "1 < 2 <> <b>\nkept\ncut"
    assert body_text("<script>var a = '<p>no</p>';</script x><p>yes</p><style>p{}") == "yes"


def test_pages_long_and_deep():
    assert body_text("<div>" * 10_000 + "deep" + "</div>" * 10_000 + "<p>after</p>") == "deep\nafter"
    assert html_text.subtrees(html_text.parse("<div>" * 10_000 + "x"))
    for part in ("<span>", "<div>x", '<a href="x>', "<a b='", "<!", "<!--", "</p>", "<p>", "<td><table>", "<li>", "<script", "<script>x</script", "<", "<a", "</", "&", "<b c=", "x"):
        page = "<p>" + part * (400_000 // len(part)) + "</span></p>"
        began = time.perf_counter()
        html_text._digest(root := html_text.parse(page))
        html_text.blocks(root)
        assert time.perf_counter() - began < 10, part
    for unclosed in ("</span>", "</td>", "</p>"):
        began = time.perf_counter()
        html_text.parse("<td><table>" + "<div>" * 20_000 + unclosed * 20_000)
        assert time.perf_counter() - began < 5, unclosed


def test_pages_equal_counting_every_subtree(spark):
    """Pages drawn as trees: their html through the operator, their texts by plain counting."""
    r = random.Random(9)
    pool = [("div", [f"shared {i}"]) for i in range(6)] + [("ul", [("li", [f"menu {i}"]), ("li", ["more"])]) for i in range(4)]

    def tree(depth):
        kids = []
        for _ in range(r.randint(1, 4)):
            x = r.random()
            if x < 0.3:
                kids.append(r.choice(pool))
            elif x < 0.6 or depth == 0:
                kids.append((r.choice(["p", "div", "span", "b"]), [f"w{r.randint(0, 10**6)} &amp; <"]))
            elif x < 0.7:
                kids.append((r.choice(["nav", "footer", "script"]), ["gone"]))
            else:
                kids.append(("div" if r.random() < 0.7 else "section", tree(depth - 1)))
        return kids

    show = lambda n: n if isinstance(n, str) else f"<{n[0]}>{''.join(map(show, n[1]))}</{n[0]}>"
    hidden, inline = ("nav", "footer", "script"), ("span", "b")

    def inner(kids):
        for k in kids:
            if not isinstance(k, str) and k[0] not in hidden:
                yield k
                yield from inner(k[1])

    def texts(kids, gone):
        out, run = [], []

        def end():
            t = " ".join("".join(run).replace("&amp;", "&").split())
            run.clear()
            if t:
                out.append(t)

        def walk(kids):
            for k in kids:
                if isinstance(k, str):
                    run.append(k)
                elif k[0] not in hidden and show(k) not in gone:
                    if k[0] not in inline:
                        end()
                    walk(k[1])
                    if k[0] not in inline:
                        end()

        walk(kids)
        end()
        return "\n".join(out)

    pages = [(i, f"http://h{r.choice('aab')}/x", tree(2)) for i in range(60)]
    pages += [(100 + i, u, k) for i, (_, u, k) in enumerate(pages[:10])]
    want = {}
    for host in ("http://ha/x", "http://hb/x"):
        own = [(i, k) for i, u, k in pages if u == host]
        first = {}
        for _, k in own:
            first.setdefault(texts(k, set()), k)
        counts = Counter(s for k in first.values() for s in {show(x) for x in inner(k)})
        gone = {s for s, n in counts.items() if n >= max(5, np.log2(len(first))) and s[1 : s.index(">")] not in inline}
        want |= {i: texts(k, gone) for i, k in own}
    rows = [(i, u, "<html><body>" + "".join(map(show, k)) + "</body></html>") for i, u, k in pages]
    got = {x.page_id: x.text for x in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
