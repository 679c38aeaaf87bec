"""Leaks by alignment, and personal data, against brute force and planted cases."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamweave.llm import decontamination as dc
from streamweave.llm import pii
from streamweave.llm.bilstm_crf import Tagger


def brute_alignment(a, b):
    h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = dc.MATCH if a[i - 1] == b[j - 1] else dc.MISMATCH
            h[i][j] = max(0.0, h[i - 1][j - 1] + s, h[i - 1][j] + dc.GAP, h[i][j - 1] + dc.GAP)
    return max(map(max, h))


def test_alignment_equals_table():
    rng = np.random.default_rng(4)
    for _ in range(30):
        a, b = rng.integers(0, 4, rng.integers(0, 15)), rng.integers(0, 4, rng.integers(1, 12))
        assert abs(dc.smith_waterman(a, b)[0] - brute_alignment(a, b)) < 1e-9


def test_find_leaks(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(25)) for i in range(12)] + [(100, "two words"), (101, None), (None, text(20)), (102, "")]
    edited = items[3][1].split()
    edited[4] = "other"
    del edited[11]
    edited.insert(17, "more")
    docs = [(1, text(80) + ". " + items[0][1].upper() + "! " + text(40)), (2, text(60) + " " + " ".join(edited)), (3, text(200)), (4, None), (5, ""), (6, items[1][1]), (6, items[1][1]), (None, items[2][1]), (7, "two words")]
    docs += [(50 + i, text(30) + " " + items[5][1]) for i in range(30)]  # leaked often: still found
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = dc.find_leaks(d, b).collect()
    pairs = sorted((r["doc_id"] or -1, r["item_id"]) for r in got)
    assert pairs == sorted([(1, 0), (2, 3), (6, 1), (6, 1), (-1, 2), (7, 100)] + [(50 + i, 5) for i in range(30)])
    one = next(r for r in got if r["doc_id"] == 1)
    assert one["score"] == 1.0 and (one["first_word"], one["end_word"]) == (80, 105)
    assert dc.find_leaks(d.limit(0), b).count() == 0 and dc.find_leaks(d, b.limit(0)).count() == 0


def test_many_blocks_find_what_one_does(spark, monkeypatch):
    rng = random.Random(18)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    items = [(i, text(20)) for i in range(9)] + [(3, text(12)), (None, text(9)), (77, None)]
    docs = [(i, text(30) + " " + items[i % 10][1] + " " + items[(3 * i) % 10][1]) for i in range(25)] + [(1, None), (None, items[2][1]), (9, ""), (None, items[2][1])] * 2
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("Leaks", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: sorted(dc.with_leaks(d, b).collect(), key=str)
    whole = rows()
    assert whole and sum(len(r["leaks"]) for r in whole) >= 40
    for words in (1, 45):
        monkeypatch.setattr(dc, "BLOCK_WORDS", words)
        assert rows() == whole
    plan = dc.with_leaks(d, b)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan  # blocks don't pile up in one stage
    assert dc.with_leaks(d.limit(0), b).count() == 0


def test_edited_copies_are_found_however_many(spark):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    item = text(40)
    edited = " ".join("other" if i % 4 == 3 else w for i, w in enumerate(item.split()))
    docs = [(i, text(30) + " " + edited + " " + text(20)) for i in range(12)] + [(20 + i, " ".join(item.split()[:12]) + " " + text(50)) for i in range(12)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = dc.find_leaks(d, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(12))
    assert all(abs(r["score"] - 25.5 / 40) < 1e-9 and (r["first_word"], r["end_word"]) == (30, 69) for r in got)


def test_bounds_lose_no_alignment():
    rng = np.random.default_rng(5)
    word = lambda i: f"w{i}"
    leaks = 0
    for round_ in range(150):
        items = [(k, " ".join(map(word, rng.integers(0, 9 + round_, rng.integers(1, 14))))) for k in range(6)]
        seeds = dc.Seeds(items)
        coded = seeds.encode(" ".join(map(word, rng.integers(0, 12 + round_, 30))) + " " + items[round_ % 6][1].replace("w1", "zz ") + " x y")
        got = {seeds.ids[i]: score for i, score, *_ in seeds.alignments(coded)}
        for k, t in items:
            mine = seeds.encode(t)
            score, n = brute_alignment(coded, mine), len(mine)
            assert (k in got) == (score >= max(dc.THRESHOLD * n, min(n, dc.SHORTEST)) - 1e-9)
            assert k not in got or abs(got[k] - score / n) < 1e-9
        leaks += len(got)
    assert leaks > 100


def test_edited_copies_without_three_words_in_a_row(spark):
    rng = random.Random(13)
    text = lambda n: [("".join(rng.choice("abcdefgh") for _ in range(4))) for _ in range(n)]
    items = [(f"i{k}", " ".join(text(36))) for k in range(10)]
    docs, want = [], set()
    for k, t in items:
        w = t.split()
        third = ["other" if i % 3 == 2 else x for i, x in enumerate(w)]
        spread = [y for x in w for y in (x, "filler")]
        fewer = [x for i, x in enumerate(w) if i % 4]
        for kind in (third, spread[:-1], fewer):
            want.add((len(docs), k))
            docs.append((len(docs), " ".join(text(50) + kind + text(900))))
    docs += [(100 + i, " ".join(text(400))) for i in range(20)]
    got = dc.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


def test_leaks_equal_full_alignment_of_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs, bench).collect()}
    seeds = dc.Seeds([tuple(r) for r in bench.select("item_id", "text").collect()])
    want, short = set(), set()
    for r in docs.select("doc_id", "text").collect():
        coded = seeds.encode(r["text"])
        if len(coded) > 250:
            continue
        short.add(r["doc_id"])
        for i, item in enumerate(seeds.coded):
            if len(coded) and dc.smith_waterman(coded, item)[0] >= seeds.score[i]:
                want.add((r["doc_id"], seeds.ids[i]))
    assert len(short) > 50 and want == {x for x in got if x[0] in short}


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 13 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15][k]
            if ok:
                out.append((k, *m.span()))
    return out


def test_base_spans_equal_plain_patterns():
    rng = random.Random(6)
    parts = ["a.b@c.de", "x@y.z@w.v", "@@a@b.c_d@e.f", "1.2.3.4.5", "300.1.1.1", "01.002.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (383) 555-6083", "+1..2", "12 34", "é", " ", "_", "-", ".", "5500005555555559 ", "+49 30 1234567 89", "١٢.3.4.5"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
        assert pii.base_spans(text) == plain_spans(text)
    assert pii.base_spans("1" * 50_000 + "a" * 50_000) == []


def test_reconcile_is_best_non_overlapping():
    rng = random.Random(1)
    for _ in range(60):
        spans = [(rng.random() * 5, rng.randrange(4), a, a + rng.randrange(1, 8)) for a in (rng.randrange(25) for _ in range(9))]
        got = pii.reconcile(spans)
        weight = {(k, a, b): max(w for w, *x in spans if tuple(x) == (k, a, b)) for _, k, a, b in spans}
        assert all(x[2] <= y[1] for x, y in zip(got, got[1:], strict=False))
        best = 0.0
        for mask in range(1 << len(spans)):
            pick = sorted((s[2], s[3], s[0]) for i, s in enumerate(spans) if mask >> i & 1)
            if all(x[1] <= y[0] for x, y in zip(pick, pick[1:], strict=False)):
                best = max(best, sum(p[2] for p in pick))
        assert abs(sum(weight[s] for s in got) - best) < 1e-9


def test_gradients():
    rng = np.random.default_rng(0)
    t = Tagger(10, 2, 3, 4)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    codes, gold = rng.integers(0, 10, (6, 3)), np.array([[0, 1, 2, 2, 0, 3], [1, 1, 2, 0, 0, 0], [3, 4, 0, 1, 2, 2]]).T
    _, grad = t.gradients(codes, gold)
    for k in t.p:
        at = tuple(rng.integers(0, s) for s in t.p[k].shape)
        t.p[k][at] += 1e-3
        up = t.gradients(codes, gold)[0]
        t.p[k][at] -= 2e-3
        down = t.gradients(codes, gold)[0]
        t.p[k][at] += 1e-3
        assert abs(grad[k][at] - (up - down) / 2e-3) < 1e-3


def test_best_path_and_posteriors_equal_enumeration():
    rng = np.random.default_rng(3)
    t = Tagger(6, 2, 3, 4)
    t.p["trans"] = rng.normal(size=t.p["trans"].shape)
    t.p["first"] = rng.normal(size=t.p["first"].shape)
    e = rng.normal(size=(5, 4, t.tags)) * 2
    trans, first = t.p["trans"] + t.banned, t.p["first"] + t.banned_first
    paths = np.array(list(itertools.product(range(t.tags), repeat=5)))
    for n in range(4):
        score = first[paths[:, 0]] + sum(e[i, n, paths[:, i]] for i in range(5)) + sum(trans[paths[:, i], paths[:, i + 1]] for i in range(4))
        assert t.best_path(e)[:, n].tolist() == paths[score.argmax()].tolist()
        weight = np.exp(score - score.max())
        weight /= weight.sum()
        for i in range(5):
            want = np.bincount(paths[:, i], weight, t.tags)
            assert np.allclose(t.marginals(e)[i, n], want, atol=1e-6)


@pytest.fixture(scope="module")
def tagger(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet")
    return pii.train(docs.where("doc_id % 2 = 0"))


def test_tagger_finds_held_out_spans_and_written_out_ones(spark, sf, tagger):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet")
    texts = [r["text"] for r in docs.where("doc_id % 2 = 1").select("text").collect() if r["text"]]
    base = [pii.base_spans(t) for t in texts]
    found = pii.model_spans(tagger, texts)
    hits = sum(len({*b} & {*f}) for b, f in zip(base, found, strict=True))
    assert hits >= 0.95 * sum(map(len, base))
    added = sum(len(m) for _, m in pii.all_spans(tagger, texts))
    assert added <= 0.02 * sum(map(len, base))
    # What the model adds: forms that the base patterns can't see, in texts it hasn't seen.
    rng = np.random.default_rng(77)
    hosts = [t for t in texts if len(t) > 100 and not pii.ANCHOR.search(t)]
    forms = pii.variants(rng, 400)
    cases = [pii.planted(hosts[rng.integers(len(hosts))], v, rng) for v, _ in forms]
    got = pii.all_spans(tagger, [w for w, _ in cases])
    for kind in range(4):
        hit = [(kind, at, at + len(v)) in m for (v, k), (_, at), (_, m) in zip(forms, cases, got, strict=True) if k == kind]
        assert sum(hit) >= 0.9 * len(hit)
    assert not any(s in b for (v, k), (_, at), (b, _) in zip(forms, cases, got, strict=True) for s in [(k, at, at + len(v))])


def test_spans_are_found_wherever_they_lie(tagger):
    form = "firstname.lastname [at] department.some-university [dot] org"
    found = [any(k == 0 and a < 5000 and b - a >= 50 for k, a, b in pii.all_spans(tagger, ["word " * n + "x" * (n % 7) + f" write to {form} today " + "word " * 60])[0][1]) for n in range(0, 60)]
    assert sum(found) >= 0.9 * len(found)
    plain = "a" * 200 + "@" + "b" * 90 + ".org"
    assert pii.all_spans(tagger, [f"{'word ' * 50}{plain} {'12 ' * 2000}"])[0][0][0] == (0, 250, 250 + len(plain))
    starts = pii.windows_of("word " * 50 + plain)
    assert starts[0] <= 250 and starts[-1] + pii.WINDOW >= 250 + len(plain) and all(b - a == pii.STRIDE for a, b in zip(starts, starts[1:], strict=False))


def test_long_runs_equal_one_decoding(tagger):
    text = " ".join(f"{i} 192[.]168[.]{i % 256}[.]7 and" for i in range(200))
    whole = pii.model_spans(tagger, [text])
    import unittest.mock

    with unittest.mock.patch.object(pii, "DECODED", 1 << 20):
        assert whole == pii.model_spans(tagger, [text])


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "mail a@b.co or 1.2.3.4"), (3, "mail a@b.co or 1.2.3.4"), (None, "+1 (383) 555-6083"), (4, "x " * 60_000 + "a@b.co")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("PII_spans", F.lit(1))
    got = pii.find_pii(df, None).collect()
    assert [[(s["kind"], s["start"], s["end"]) for s in r["pii_spans"]] for r in got[:5]] == [[], [], [("email", 5, 11), ("ip", 15, 22)], [("email", 5, 11), ("ip", 15, 22)], [("phone", 0, 17)]]
    assert got[5]["pii_spans"][0]["start"] == 120_000
    clean = [r["text"] for r in pii.redacted(pii.find_pii(df, None)).collect()]
    assert clean[:5] == [None, "", "mail <EMAIL> or <IP>", "mail <EMAIL> or <IP>", "<PHONE>"]
    once = pii.redact_found(df.withColumn("N_spans", F.lit("x")).withColumn("found", F.lit(2)), None).collect()
    assert [r["text"] for r in once] == clean and [r["n_spans"] for r in once] == [len(r["pii_spans"]) for r in got] and once[0]["found"] == 2
    assert pii.redact_found(df.limit(0), None).count() == 0
    assert pii.train(df.limit(0)) is None and pii.find_pii(df.limit(0), None).count() == 0


def test_query_digests(spark, sf):
    got = {r["doc_id"]: r for r in pii.op8_pii_spans(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(plain_spans(r["text"] or "")))
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[r["doc_id"]]["spans"].split(","))
