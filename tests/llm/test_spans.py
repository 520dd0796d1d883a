"""PII, secrets and licenses against plain regexes and counts."""

import hashlib
import math
import random
import re
import textwrap
import time

from anamnesis.llm import license_scan, pii, secret_scan
from anamnesis.llm.dfa import self_check


def plain_pii(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_pii_is_the_patterns():
    r = random.Random(3)
    parts = ["a", "@", ".", "b-1", "1", "22", "255", "300", "+", "4", "(", "-", " ", "é", "4785380592391139", "x.y", "\n", "%"]
    for _ in range(5000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 16)))
        assert pii.base_spans(t) == plain_pii(t)


def test_field_finds_held_out_entities():
    field = pii.Field(pii.fit())
    hit = wrong = missed = 0
    for text, spans in pii.examples(400, 99):
        got = {x for run in pii.islands(text) for x in field.decode(text, run)}
        hit, wrong, missed = hit + len(got & set(spans)), wrong + len(got - set(spans)), missed + len(set(spans) - got)
    assert hit / (hit + wrong) > 0.97 and hit / (hit + missed) > 0.93


def every_segmentation(n, cands):
    """All ways to cut an island, as lists of (candidate or None, kind)."""
    if n == 0:
        yield []
        return
    for way in every_segmentation(n - 1, cands):
        yield [*way, (None, pii.OUT)]
    for x, c in enumerate(cands):
        if c[1] == n:
            for way in every_segmentation(c[0], cands):
                for kind in pii.KINDS:
                    yield [*way, (x, kind)]


def test_field_decoding_and_sums_are_over_all_segmentations():
    weights = pii.fit(count=120, rounds=3)
    field = pii.Field(weights)
    seen = 0
    for text, _ in pii.examples(150, 5):
        for run in pii.islands(text):
            cands = pii.candidates(text, run)
            if len(run) > 5 or len(cands) > 6:
                continue
            seen += 1
            scores = pii._scores(cands, weights)

            def value(way, scores=scores):
                kinds = [pii.OUT, *[k for _, k in way], pii.OUT]
                return sum(pii.step_weight(weights, a, b) for a, b in zip(kinds, kinds[1:])) + sum(scores[x][pii.KINDS.index(k)] for x, k in way if x is not None)

            values = [(value(w), w) for w in every_segmentation(len(run), cands)]
            top, way = max(values, key=lambda v: v[0])
            got = field.decode(text, run)
            assert got == [(cands[x][2], pii.KINDS.index(k), cands[x][3]) for x, k in way if x is not None]
            step = {(a, b): math.exp(pii.step_weight(weights, a, b)) for a in (*pii.KINDS, pii.OUT) for b in (*pii.KINDS, pii.OUT)}
            inside, steps, total = pii._sums(len(run), cands, [[math.exp(x) for x in row] for row in scores], step)
            z = math.log(sum(math.exp(v) for v, _ in values))
            assert abs(total - z) < 1e-6
            for x in range(len(cands)):
                share = sum(math.exp(v - z) for v, w in values if any(y == x for y, _ in w))
                assert abs(sum(inside[x]) - share) < 1e-6
            outs = sum(math.exp(v - z) * sum(a == b == pii.OUT for a, b in zip([pii.OUT, *[k for _, k in w]], [*[k for _, k in w], pii.OUT])) for v, w in values)
            assert abs(steps[pii.OUT, pii.OUT] - outs) < 1e-6
    assert seen > 30


def test_pii_reads_spoken_addresses_and_long_runs():
    field = pii.Field(pii.fit())
    said = lambda t: [(pii.KINDS[k], t[s:e]) for s, k, e in pii.find_spans(t, field)[1]]
    assert said("write to joe [at] site3.org now") == [("email", "joe [at] site3.org")]
    assert said("joe.smith [at] example.com") == [("email", "joe.smith [at] example.com")]
    assert said("joe (at) example (dot) org") == [("email", "joe (at) example (dot) org")]
    assert said("he was (at) home in 1987\n(at)\n(dot)") == []
    assert pii.base_spans("1" * 5000 + ".1.1.1") == [] and pii.base_spans("0" * 5000 + "255.1.1.1") == [(0, 1, 5009)]
    for part in ("1", "a@", "1.", "12 ", "(at)", "x", "(at) ", "+1(", "joe@ex.org ", "call 555-123-4567 "):
        began = time.perf_counter()
        pii.find_spans(part * (200_000 // len(part)), field)
        assert time.perf_counter() - began < 20, part


def test_added_spans_touch_no_base_span():
    field = pii.Field(pii.fit())
    for text, _ in pii.examples(200, 11):
        base, added = pii.find_spans(text, field)
        every = [x for run in pii.islands(text) for x in field.decode(text, run)]
        assert added == [x for x in every if all(x[2] <= s or x[0] >= e for s, _, e in base)]


def test_pii_rows(odd, odd_rows, none):
    rows = pii.detect(odd).collect()
    assert len(rows) == len(odd_rows) and pii.detect(none).count() == 0
    by = {r.doc_id: r for r in rows}
    assert (by[8].n_email, by[8].n_ip, by[8].n_card, by[8].n_phone) == (1, 1, 1, 1)
    assert by[1].spans == "" and by[1].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_redaction_leaves_clean_rows(odd, odd_rows):
    out = {(r.doc_id, r.text) for r in pii.redact_documents(odd).collect()}
    clean = {(i, t) for i, t, *_ in odd_rows if t is None or not plain_pii(t)}
    assert clean <= out and pii.redact_documents(odd).columns == odd.columns
    text = next(t for i, t in out if i == 8)
    assert "[EMAIL]" in text and "[CARD]" in text and "ex-am" not in text


def plain_secrets(t):
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
    word += "|[aA][pP][iI]_?[kK][eE][yY]"
    out = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def test_secret_base_is_the_patterns(odd, odd_rows, none):
    scanner = secret_scan.Scanner()
    r = random.Random(1)
    parts = ["token", "secret", "=", ":", " ", '"', "abcdef0123456789", "AKIA", "ABCDEFGHIJKLMN12", "é", "api_key", "x", "password", ".", "-", "deadbeef"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert [x for x in scanner.scan(t) if x[1] < 3] == plain_secrets(t)
    assert [r_[0] for r_ in scanner.scan("-----BEGIN RSA PRIVATE KEY-----")] == [0]
    rows = secret_scan.find_secrets(odd, scanner).collect()
    assert len(rows) == len(odd_rows) and secret_scan.find_secrets(none, scanner).count() == 0
    assert {x.doc_id: (x.n_assign, x.n_access, x.n_hex) for x in rows}[9] == (1, 1, 1)


def test_secret_scan_is_linear_and_begins_anew_after_a_match():
    scanner = secret_scan.Scanner()
    for part in ("token=xtoken:", "token=secret=password:", "AKIAtoken=AKIA", "eyJa.eyJ", "gh", "deadbeef", "-----BEGIN ", "token", "token="):
        t = part + "a" * 100_000 + part * (100_000 // len(part))
        began = time.perf_counter()
        got = scanner.scan(t)
        assert time.perf_counter() - began < 5, part
        assert [x for x in got if x[1] < 3] == plain_secrets(t)
    r = random.Random(4)
    parts = ["token=", "xtoken:", "secret", "a" * 20, "AKIA", "B" * 20, ":", "=", "eyJ", ".", "_", "ghp_", "-----BEGIN ", "PRIVATE KEY-----", "xoxb-", " "]
    rules = [re.compile(x.pattern) for x in secret_scan.RULES[3:]]
    for _ in range(2000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        want = [(m.start(), k, m.end()) for k, rule in enumerate(rules, 3) for m in rule.finditer(t) if len(m[0]) >= secret_scan.RULES[k].least]
        assert scanner.scan(t) == sorted(plain_secrets(t) + want)


def test_automata_agree_with_regexes():
    samples = [bytes(random.Random(i).choice(b"abcxyz019-_. =") for _ in range(12)) for i in range(400)]
    assert self_check(["a*b|c+x?", "(?:ab|a)c{1,3}", "[^a-c]+[0-9]{2,}", "x(y|z)*0"], samples)


def brute_labels(blocks, templates, weight, contained):
    """Labels of blocks (sets of words) by weighing every template against each."""
    labels = set()
    for block in blocks:
        met = []
        for text, label in templates:
            own = set(text.split())
            held, whole = sum(weight[w] for w in own & block), sum(weight[w] for w in own)
            if held >= math.ceil(round(contained * whole, 6)):
                met.append((held / whole, own & block, label))
        for share, common, label in met:
            if not any(common <= o and (s, len(o)) > (share, len(common)) for s, o, _ in met):
                labels.add(label)
    return labels


def test_license_join_is_brute_containment(spark, odd, odd_rows, none):
    templates = (("alpha beta gamma delta epsilon", "t1"), ("beta beta zeta eta", "t2"), ("gamma", "t3"), ("alpha beta gamma delta epsilon zeta", "t4"))
    r = random.Random(2)
    vocab = "alpha beta gamma delta epsilon zeta eta theta iota".split()
    rows = [(i, "\n".join(" ".join(r.choice(vocab[: r.choice([3, 6, 9])]) for _ in range(r.randint(0, 8))) for _ in range(r.randint(0, 4)))) for i in range(300)]
    weight = {w: round(10_000 * math.log(1 + len(rows) / (1 + sum(w in t.split() for _, t in rows)))) for w in vocab}
    got = {x.doc_id: x.labels for x in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates, 0.75).collect()}
    for i, t in rows:
        assert got[i] == ",".join(sorted(brute_labels([set(x.split()) for x in t.split("\n")], templates, weight, 0.75)))
    rows = {x.doc_id: x for x in license_scan.scan(odd).collect()}
    assert rows[10].base_labels == "apache,mit" and (rows[10].n_base, rows[10].first_word, rows[10].last_word) == (2, 3, 8)
    assert rows[1].first_word is None and license_scan.scan(none).count() == 0 and license_scan.scan(odd).count() == len(odd_rows)


def test_license_notices_wrapped_over_lines(spark):
    notices = {label + str(n): (text, label) for n, (text, label) in enumerate(license_scan.TEMPLATES)}
    notices_of = [text for text, _ in notices.values() for _ in range(3)]
    wrapped = [("\n".join(" * " + x for x in textwrap.wrap(text, w)), label) for text, label in notices.values() for w in (30, 45, 75)]
    rows = [(i, f"some code\n\n{t}\n\nmore code") for i, (t, _) in enumerate(wrapped)] + [(len(wrapped), "\n".join(w + " x" * 30 for w in license_scan.TEMPLATES[1][0].split()))]
    got = {x.doc_id: (x.labels, x.score) for x in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), over_lines=True).collect()}
    for i, (_, label) in enumerate(wrapped):
        assert label in got[i][0].split(",") and got[i][1] == 1.0
        # No variant's label beside the notice's own, but for base phrases.
        assert set(got[i][0].split(",")) - {label} <= {b for p, b in license_scan.PHRASES if p in notices_of[i]}
    assert got[len(wrapped)] == ("", 0.0)


def test_license_runs_are_brute_containment():
    templates = (("alpha beta gamma delta epsilon", "t1"), ("beta beta zeta eta", "t2"), ("gamma", "t3"))
    r = random.Random(6)
    vocab = [w.encode() for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa x y z".split()]
    weight = {w: r.randint(1, 9) for w in vocab}
    join = license_scan.TemplateJoin(templates, weight, 0.75)
    for _ in range(500):
        words = [r.choice(vocab) for _ in range(r.randint(0, 40))]
        want = {}
        for k, (text, _) in enumerate(templates):
            own, n = set(text.encode().split()), -(-len(text.split()) * 4 // 3)
            whole = sum(weight[w] for w in own)
            most = max((sum(weight[w] for w in own & set(words[i : i + n])) for i in range(len(words))), default=0)
            if most >= math.ceil(round(0.75 * whole, 6)):
                want[k] = most / whole
        assert {k: share for k, (share, _) in join.match_over_lines(words).items()} == want


def test_license_labels_are_precise(spark):
    lines = ["Released under the Apache License", "Licensed under the terms of the house", *[f"filler {i} the of is and under license" for i in range(200)]]
    lines += [t for t, _ in license_scan.TEMPLATES]
    got = {x.doc_id: x.labels for x in license_scan.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), over_lines=True).collect()}
    assert got[0] == "apache" and not any(got[i] for i in range(1, 202))
    for i, (t, label) in enumerate(license_scan.TEMPLATES, 202):
        assert set(got[i].split(",")) - {b for p, b in license_scan.PHRASES if p in t} <= {label} and label in got[i].split(",")
