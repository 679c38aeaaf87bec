"""Held-out accuracy, and exactness of the parts that have an exact answer."""

import random

import numpy as np
from pyspark.sql import functions as F

from streamweave.llm import language, quality
from streamweave.llm.common import table


def test_automaton_knows_every_substring():
    text = [1, 2, 1, 2, 3, 1, 2, 1]
    move = language.suffix_automaton(text)
    subs = {tuple(text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1)}

    def known(s):
        at = 0
        for c in s:
            if c not in move[at]:
                return False
            at = move[at][c]
        return True

    assert all(known(s) for s in subs)
    assert sum(known((a, b, c)) for a in (1, 2, 3) for b in (1, 2, 3) for c in (1, 2, 3)) == len({s for s in subs if len(s) == 3})


def greedy(text, sample):
    """Phrases of a text cut greedily into longest matches with the sample."""
    n = i = 0
    while i < len(text):
        k = 0
        while i + k < len(text) and text[i : i + k + 1] in sample:
            k += 1
        n, i = n + 1, i + max(1, k)
    return n


def test_phrases_equal_greedy_parsing():
    samples = {"x": "abcab cabba", "y": "xyz zyx abc"}
    parser = language.CrossParser(samples)
    for text in ["abc", "zzz abc", "cab cab", "x", "qqq", "ab?ab"]:
        plain = language.normal_text(text) if "?" not in text else "ab ab"
        assert parser.phrases([text])[0].tolist() == [greedy(plain, s) for s in (samples["x"], samples["y"])]


def test_blocks_do_not_show():
    rng = random.Random(3)
    samples = {k: " ".join("".join(rng.choice(a) for _ in range(rng.randrange(1, 6))) for _ in range(150)) for k, a in (("x", "abc"), ("y", "bcd"), ("z", "\u0430\u0431\u0432"))}
    parser = language.CrossParser(samples)
    texts = ["".join(rng.choice("abcd \u0430\u0431\u0432q") for _ in range(n)) for n in (511, 512, 513, 1024, 1500, 4000)]
    texts += ["a" * 3000, "ab" * 2000, "abc" * 3000 + "d", samples["x"] * 5, "q" * 1100, "", "a"]
    got = parser.phrases(texts)
    for t, row in zip(texts, got, strict=True):
        plain = "".join(" " if c == " " and t[i - 1] == " " and i else c for i, c in enumerate(t))
        while "  " in plain:
            plain = plain.replace("  ", " ")
        assert row.tolist() == [greedy(plain, samples[k]) for k in "xyz"]


def test_scripts_are_told_apart():
    base = {
        "ar": "\u0627\u0644\u0644\u063a\u0629 \u0627\u0644\u0639\u0631\u0628\u064a\u0629 \u062c\u0645\u064a\u0644\u0629 ",
        "el": "\u03b7 \u03b3\u03bb\u03ce\u03c3\u03c3\u03b1 \u03b5\u03af\u03bd\u03b1\u03b9 \u03cc\u03bc\u03bf\u03c1\u03c6\u03b7 ",
        "en": "the language is beautiful and old ",
        "ja": "\u79c1\u306f\u660e\u65e5\u5b66\u6821\u306b\u884c\u304d\u307e\u3059 ",
        "ru": "\u044f\u0437\u044b\u043a \u043a\u0440\u0430\u0441\u0438\u0432\u044b\u0439 \u0438 \u0441\u0442\u0430\u0440\u044b\u0439 ",
        "zh": "\u6211\u4eec\u660e\u5929\u56de\u5bb6\u770b\u4e66 ",
    }
    many = {"zh": "".join(map(chr, range(0x4E00, 0x4E00 + 3000)))}
    parser = language.CrossParser({k: (v * 50 + many.get(k, ""))[:20_000] for k, v in base.items()})
    names, scores = parser.predict([v.strip() for v in base.values()] + ["\u6211\u4eec\u660e\u5929\u56de\u5bb6"])
    assert names == [*base, "zh"] and min(scores) > 0.5


def test_training_takes_long_and_repeated_rows(spark):
    rows = [(i, "uno dos tres cuatro " * 3000, "es") for i in range(3)] + [(7, "one two three four", "en")] * 500 + [(None, "eins zwei drei", "de"), (8, None, "fr"), (9, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.training_samples(docs, "text", "lang", F.lit(True))
    assert sorted(got) == ["de", "en", "es"] and got["en"] == "one two three four" and len(got["es"]) >= language.CHARS_PER_LANGUAGE - 1
    assert language.training_samples(docs.limit(0), "text", "lang", F.lit(True)) == {}


def test_many_languages_share_what_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "CHARS_IN_ALL", 3_000)
    docs = spark.createDataFrame([(i, f"word{i % 30} " * 400, f"l{i % 30:02}") for i in range(90)], "doc_id long, text string, lang string")
    got = language.training_samples(docs, "text", "lang", F.lit(True))
    assert len(got) == 30 and {len(v) for v in got.values()} == {100}


def test_language_held_out(spark, sf):
    got = language.op5_language_id(spark, sf)
    both = got.join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    assert both.where("lang = lang_pred").count() >= 0.95 * both.count()


def test_language_edges(spark):
    samples = {"aa": "lorem ipsum dolor sit amet " * 20, "bb": "the quick brown fox jumps over " * 20}
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "quick fox"), (5, "dolor ipsum " * 5000), (5, "dolor ipsum"), (None, "日本")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("SCORE", F.lit("x"))
    got = language.identify(df, samples).collect()
    assert [r["lang_pred"] for r in got[:6]] == ["und", "und", "und", "bb", "aa", "aa"] and got[6]["lang_pred"] in samples
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in language.identify(df, {}).collect()} == {"und"}
    assert language.identify(df.limit(0), samples).count() == 0


def walk(model, row):
    margin = model.prior
    for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
        node = 0
        for _ in range(quality.DEPTH):
            node = 2 * node + 1 + int(row[f[node]] > t[node])
        margin += v[node - len(f)]
    return 1 / (1 + np.exp(-margin))


def test_trees_learn_and_vector_walk_equals_row_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    model = quality.BoostedTrees.fit(x, y)
    s = model.scores(x)
    assert ((s > 0.5) == (y > 0)).mean() > 0.97
    assert np.allclose(s[:20], [walk(model, r) for r in x[:20]])


def test_trees_on_nothing_and_one_class():
    assert quality.BoostedTrees.fit(np.zeros((0, 3)), np.zeros(0)).scores(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert quality.BoostedTrees.fit(np.ones((30, 3)), np.ones(30)).scores(np.ones((1, 3)))[0] > 0.9


def test_quality_held_out(spark, sf):
    sf = sf.replace("0.001", "0.01")
    got = quality.op6_quality_classifier(spark, sf)
    both = got.where("held_out").join(table(spark, sf, "labels"), "doc_id")
    assert both.where("predicted = quality").count() >= 0.95 * both.count()
    assert got.count() == table(spark, sf, "documents").count()


def test_quality_edges(spark):
    model = quality.BoostedTrees.fit(np.zeros((0, quality.FEATURES)), np.zeros(0))
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a " * 50_000), (3, "a")], "doc_id long, text string").withColumn("Score", F.lit(1))
    got = quality.score(df, model).collect()
    assert [r["score"] for r in got] == [0.5] * 4 and {r["predicted"] for r in got} == {1}
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 1), (3, 0)], "doc_id long, quality int")
    assert 0 < quality.train(df, labels, F.lit(True)).scores(np.zeros((1, quality.FEATURES)))[0] < 1


def test_quality_draw_is_bounded_by_rows(spark, monkeypatch):
    seen = []
    fit = quality.BoostedTrees.fit.__func__
    monkeypatch.setattr(quality.BoostedTrees, "fit", classmethod(lambda cls, x, y: seen.append(len(x)) or fit(cls, x, y)))
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(3000)] + [(2, "same")] * 3000 + [(None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    quality.train(docs, labels, F.lit(True), rows=200)
    assert 100 < seen[0] < 400


def plain_fit(x, y):
    """One boosted stump-by-stump tree grown by trying every split of every node."""
    rate = (y.sum() + 1) / (len(y) + 2)
    prior = np.log(rate / (1 - rate))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1])) for j in range(x.shape[1])]
    margin = np.full(len(y), prior)
    for _ in range(quality.TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        parts = [np.ones(len(y), bool)]
        for _ in range(quality.DEPTH):
            after = []
            for part in parts:
                best, split = 1e-9, np.zeros(len(y), bool)
                value = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality.RIDGE)  # noqa: E731, B023
                for j, c in enumerate(cuts):
                    for t in c:
                        low, high = part & (x[:, j] <= t), part & (x[:, j] > t)
                        if min(low.sum(), high.sum()) >= quality.LEAST:
                            gain = value(low) + value(high) - value(part)
                            if gain > best + 1e-9:
                                best, split = gain, x[:, j] > t
                after += [part & ~split, part & split]
            parts = after
        for part in parts:
            margin[part] += -quality.RATE * g[part].sum() / (h[part].sum() + quality.RIDGE)
    return 1 / (1 + np.exp(-margin))


def test_fit_equals_plain_boosting(monkeypatch):
    monkeypatch.setattr(quality, "TREES", 4)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(150, 3))
    y = ((x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=150)) > 0).astype(float)
    assert np.allclose(quality.BoostedTrees.fit(x, y).scores(x), plain_fit(x, y), atol=1e-9)
