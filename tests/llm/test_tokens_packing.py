"""Token counts and packing against the library and the rules of the layout."""

import zlib
from array import array

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from streamweave.llm import bpe, packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)
ENC = bpe.encoder(*tokens._tokenizer(PATH))
TEXTS = [None, "", " ", "\n", "a", "Hello, world! It's 12,5 — naïve ½ ²", "  two  spaces ", "x<|endoftext|>y", "日本語 text", "\x1c a\x1cb", "don't we'll 'S 's's", "the " * 3000, "a", "a"]


def ids(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab éÉ'sS12.,!\n\t  ²ßª<|>_-\x85 日")), max_size=40))
def test_encoder_equals_library(text):
    assert list(memoryview(ENC.ids(text)).cast("I")) == ids(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab é'’—“”я й中 文ー\u0301१२३٣😀\n\t  \x1f\u180e\ufeff\u2003\u00a0s,.")), max_size=60))
def test_encoder_equals_library_in_all_scripts(text):
    assert list(memoryview(ENC.ids(text)).cast("I")) == ids(text)


def test_odd_texts_take_the_shortcut_too(monkeypatch):
    monkeypatch.setattr(ENC, "_library", None)  # no text as a whole
    for text in ("It’s — he said — “fine”", "Привет, мир! Как дела?", "我们 明天回家。", "a  b \n\n c ’ d", " x" * 5000 + "’"):
        assert list(memoryview(ENC.ids(text)).cast("I")) == ids(text)
    ENC.ids("字" * 5000 + " " + "x" * 5000)
    assert all(len(k) <= bpe.LONGEST for k in ENC.chunk.__self__)


def test_whole_tokens_are_proven():
    whole = bpe.prove_whole_tokens(tokens._tokenizer(PATH)[0])
    assert len(whole) > 40_000 and all(ids(t) == [i] for t, i in list(whole.items())[::500])


def test_counts(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, N_TOKENS string")
    got = {r["doc_id"]: r for r in tokens.count_tokens(df).collect()}
    for i, t in enumerate(TEXTS):
        assert (got[i]["n_bytes"], got[i]["n_tokens"]) == (len((t or "").encode()), len(ids(t)))
        assert got[i]["over_limit"] == (len(ids(t)) > 1024)
    assert tokens.count_tokens(df.limit(0)).count() == 0


def test_best_fit_decreasing_equals_one_by_one():
    lengths = [7, 7, 7, 5, 5, 4, 3, 3, 3, 3, 2, 2, 1, 10, 9, 6, 6]
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if sum(b) + n <= 10]
        if fits:
            min(fits, key=lambda b: 10 - sum(b)).append(n)
        else:
            bins.append([n])
    plan = packing.best_fit_decreasing({n: lengths.count(n) for n in lengths}, 10)
    placed = {}
    for n, lo, hi, per, first, offset in plan:
        for r in range(lo, hi):
            placed.setdefault(first + (r - lo) // per, []).append((offset + (r - lo) % per * n, n))
    assert sorted(n for b in placed.values() for _, n in b) == sorted(lengths)
    for b in placed.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 10
    # Bins with equal room are interchangeable, so how full they end up is what must agree.
    assert sorted(sum(n for _, n in b) for b in placed.values()) == sorted(map(sum, bins))


def test_pack(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[5]), (None, "z"), (None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as offset", "1 as piece")
    got = packing.pack(df, capacity=64).collect()
    for b in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == b), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    longest = [r for r in got if r["doc_id"] == 11]
    full = [*ids(TEXTS[11]), 2]
    assert sum(r["length"] for r in longest) == len(full) and sorted(r["length"] for r in longest)[1:] == [64] * (len(longest) - 1)
    for r in longest:
        assert r["ids_crc32"] == zlib.crc32(array("I", full[r["start"] : r["start"] + r["length"]]).tobytes())
    assert len([r for r in got if r["doc_id"] is None]) == 2
    assert packing.pack(df.limit(0)).count() == 0
