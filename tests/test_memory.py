"""Best versions over a stream that is stopped and goes on, against the batch."""

import json
import random

import pandas as pd
from pyspark.sql import functions as F

from streamweave.operators.series import best_version
from streamweave.streaming import memory

SCHEMA = "code string, month long, level int, mean double, low double"


def test_a_stream_that_goes_on_equals_the_batch(spark, tmp_path):
    rng = random.Random(3)
    value = lambda: rng.choice([None, 0.0, 1.5, -2.0, 7.25])
    every, seen = [], []
    for run in range(3):
        rows = [(rng.choice("abcd"), rng.randint(-20, 40), rng.randint(1, 2), value(), value()) for _ in range(120)]
        rows += [(f"empty{run}", None, None, None, None), ("empty0", None, None, None, None), (None, 1, 1, 1.0, 1.0), ("a", 3, None, 9.0, 9.0), *rows[:5]]
        every += rows
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{run}.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows))
        stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
        better = memory.improvements(stream, "code", "month", "level", ["mean", "low"])
        query = memory.start(better, str(tmp_path / "log"), str(tmp_path / "ck"))
        query.awaitTermination()
        log = spark.read.parquet(str(tmp_path / "log"))
        have = {tuple(r) for r in memory.best(log, "code", "month", "level", ["mean", "low"]).collect()}
        batch = spark.createDataFrame(every, SCHEMA).where("code is not null and month is not null and level is not null").distinct()
        want = {tuple(r) for r in best_version(batch, ["code", "month"], "level", F.col("mean").asc_nulls_last(), F.col("low").asc_nulls_last()).collect()}
        assert have == want
        assert {r["code"] for r in memory.tried(log, "code").collect()} == {"a", "b", "c", "d", *[f"empty{i}" for i in range(run + 1)]}
        assert log.where("month is null").count() == log.where("month is null").distinct().count()  # a key is new once
        seen.append(log.count())
    memory.start(memory.improvements(stream, "code", "month", "level", ["mean", "low"]), str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == seen[-1]  # nothing new, nothing written


class _State:
    """Values by key, and the calls that were made."""

    def __init__(self):
        self.held, self.calls = {}, []

    def exists(self):
        return () in self.held

    def update(self, value):
        self.held[()] = value

    def containsKey(self, key):  # noqa: N802
        self.calls.append("contains")
        return key in self.held

    def getValue(self, key):  # noqa: N802
        return self.held[key]

    def updateValue(self, key, value):  # noqa: N802
        self.calls.append("write")
        self.held[key] = value


def test_a_new_key_asks_nothing_of_the_state():
    """Rows are reduced to the best of each slot at once; only writes of a block each follow, and reads only for a known key."""
    rng = random.Random(4)
    value = lambda: rng.choice([None, 0.0, -0.0, float("inf"), float("-inf"), 2.5])
    blocks, tried, made = _State(), _State(), memory.Best(2)
    made.init(type("Handle", (), {"getValueState": lambda *_: tried, "getMapState": lambda *_: blocks})())
    rows = [(rng.choice([None, *range(-5, 31)]), rng.choice([None, 1, 2, -3]), value(), value()) for _ in range(900)]
    frames = [pd.DataFrame(rows[a : a + 300], columns=["slot", "level", "v0", "v1"]).astype({"v0": "float64", "v1": "float64"}) for a in (0, 300, 600)]
    got = [r for f in made.handleInputRows(("k",), iter(frames), None) for r in f.astype(object).where(f.notna(), None).itertuples(index=False)]
    want = {}
    for slot, level, *vs in rows:
        if slot is not None and level is not None and (slot not in want or memory.rank(level, vs) < memory.rank(want[slot][0], want[slot][1:])):
            want[slot] = (level, *vs)
    assert {r.slot: tuple(r[2:]) for r in got if r.slot is not None} == want and sum(r.slot is None for r in got) == 1
    assert blocks.calls == ["write"] * 2  # slots -5 to 30 lie on either side of 0
    assert not list(made.handleInputRows(("k",), iter(frames), None)) and blocks.calls[2:] == ["contains"] * 2
