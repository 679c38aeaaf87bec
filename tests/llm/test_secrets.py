"""Secret scans: base patterns, entropy windows against a plain recount, allow-list."""

import hashlib
import math
import random
import re
import string
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from streamweave.llm import secrets


def plain_base(text):
    """The contract's patterns as written, failing matches dropped."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


PIECES = ["token=", "TOKEN", "secret: ", "api_key", "apikey='", "password", ":", "=", " ", '"', "AKIA", "AKIAAKIA", "ABCDEFGH01", "deadbeef", "0123456789abcdef", "é", "\n", "xyz", "K", "ſecret", "abcdefghijkl"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25))
def test_base_patterns(pieces):
    assert secrets.base_spans("".join(pieces)) == plain_base("".join(pieces))


@settings(max_examples=200, deadline=None)
@given(st.text("abcdefgh0123XY", max_size=90), st.sampled_from([2.0, 2.5, 2.9]))
def test_windows_equal_a_recount(run, bits):
    n = secrets.WINDOW
    covered = set()
    for i in range(len(run) - n + 1):
        counts = Counter(run[i : i + n])
        weight = sum(round(c * math.log2(c) * (1 << secrets.SCALE)) for c in counts.values())
        high = -sum(c / n * math.log2(c / n) for c in counts.values())
        least = weight <= secrets.TABLE[n] - round(bits * n * (1 << secrets.SCALE))
        assert least == (high >= bits) or abs(high - bits) < 1e-6
        if least:
            covered |= set(range(i, i + n))
    got = secrets.windows(run, bits, secrets.TABLE)
    assert {p for a, b in got for p in range(a, b)} == covered
    assert all(a[1] < b[0] for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("letters, least", [("0123456789ABCDEF", 0.95), (string.ascii_letters + string.digits, 0.95), (string.ascii_letters + string.digits + "+/", 0.95), (string.ascii_lowercase + string.digits, 0.85)])
def test_random_keys_are_found(letters, least):
    r = random.Random(3)
    keys = ["".join(r.choice(letters) for _ in range(32)) for _ in range(300)]
    assert sum(bool(secrets.all_spans(f"ein Wort {k}, noch eins")) for k in keys) / len(keys) >= least


@pytest.mark.parametrize("text", [
    "123e4567-e89b-12d3-a456-426614174000", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "getElementsByClassName2AndSomething", "/usr/local/lib/python3/site-packages/Numpy2/core",
    "customer-service-2024-annual-report-final", "Donaudampfschifffahrtsgesellschaft12", "AbstractSingletonProxyFactoryBean2Impl", "EXAMPLEkey9f8A7c6D5e4F3b2A1", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1A",
])
def test_allow_list(text):
    assert secrets.entropy_spans(text) == []


def test_documents_hold_their_base_spans(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in secrets.op13_secret_scan(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc, text in rows:
        base = plain_base(text or "")
        told = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        r = got[doc]
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert set(told.split(",")) <= set(r["spans"].split(","))


def test_edges(spark):
    key = "Zk3vQ9xR7bT1mW5yP8sD2fG6hJ4"
    texts = [None, "", "   ", key, f"naïve ☃ {key}", "word " * 300_000 + key, f"token = {key}", key]
    df = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("Secrets", F.lit(1)).withColumn("kind", F.lit("x"))
    found = secrets.find_secrets(df)
    assert found.columns == ["doc_id", "text", "kind", "secrets"]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["secrets"]] for r in found.collect()}
    n = len(key)
    assert got == {None: [], 1: [], 2: [], 3: [("entropy", 0, n)], 4: [("entropy", 8, 8 + n)], 5: [("entropy", 1_500_000, 1_500_000 + n)], 6: [("assign", 0, 8 + n)], 7: [("entropy", 0, n)]}
    assert secrets.find_secrets(df.limit(0)).count() == 0
    assert [r["text"] for r in secrets.masked(found).where("doc_id in (4, 6)").orderBy("doc_id").collect()] == ["naïve ☃ <ENTROPY>", "<ASSIGN>"]
    assert secrets.masked(found).where("text is null").count() == 1
