"""A stream that remembers: the best version of each value so far, and the keys already tried.

A key's state lies in the query's checkpoint, so a run that is stopped goes on where
it was, and versions that come in a later run meet those of earlier ones.  The best is
the highest level, among equals the least values (nulls last): the order in which
versions come doesn't matter, and a stream's result is the batch's.

What a key holds is kept in blocks of BLOCK slots (months, say, so a block is ten
years): a late version reads and writes its own block, never the key's whole series.
Each write of a block is a call of the state's server, so small blocks cost a full series many calls.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from streamweave.functions.shipping import ship_package
from streamweave.operators.series import best_version

BLOCK = 120
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rank(level: int, values: Sequence[float | None]) -> tuple:
    """Of two versions the better has the lesser rank."""
    return (-level, *[(v is None, v or 0.0) for v in values])


def _number(v: float | None) -> float | None:
    return None if v is None or math.isnan(v) else float(v)


def best_rows(frame: pd.DataFrame, values: Sequence[str]) -> Iterator[tuple]:
    """(slot, level, values) of a frame: for each slot the version of the least rank, the first of equal ones."""
    frame = frame[frame["slot"].notna().to_numpy() & frame["level"].notna().to_numpy()]
    slots, levels, *columns = [frame[c].to_numpy(kind) for c, kind in (("slot", np.int64), ("level", np.int64), *[(v, np.float64) for v in values])]
    order = [slots, -levels]
    for v in columns:
        none = np.isnan(v)
        order += [none, np.where(none, 0.0, v)]
    at = np.lexsort(order[::-1])
    at = at[np.flatnonzero(np.diff(slots[at], prepend=slots[at[:1]] - 1))]
    return zip(slots[at].tolist(), levels[at].tolist(), *[v[at].tolist() for v in columns], strict=True)


class Best(StatefulProcessor):
    """Emits a row for each slot that a batch improves, and one without a slot when a key is first met."""

    def __init__(self, values: int):
        self.values = values

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tried = handle.getValueState("tried", "n long")
        fields = "".join(f", v{i} array<double>" for i in range(self.values))
        self.blocks = handle.getMapState(f"blocks{BLOCK}", "block long", f"slots array<int>, levels array<int>{fields}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best: dict[int, tuple] = {}
        for frame in rows:
            for slot, level, *values in best_rows(frame, [f"v{i}" for i in range(self.values)]):
                new = (level, *[_number(v) for v in values])
                old = best.get(slot)
                if old is None or rank(new[0], new[1:]) < rank(old[0], old[1:]):
                    best[slot] = new
        out = []
        known = self.tried.exists()
        if not known:
            self.tried.update((1,))
            out.append((key[0], None, None, *[None] * self.values))
        by_block: dict[int, dict[int, tuple]] = {}
        for slot, version in best.items():
            by_block.setdefault(slot // BLOCK, {})[slot % BLOCK] = version
        for block, new in by_block.items():
            held = {}
            if known and self.blocks.containsKey((block,)):  # a new key has none: nothing is asked of the state
                slots, levels, *columns = self.blocks.getValue((block,))
                held = {int(s): (int(lv), *[_number(v) for v in vs]) for s, lv, *vs in zip(slots, levels, *columns, strict=True)}
            better = {s: v for s, v in new.items() if s not in held or rank(v[0], v[1:]) < rank(held[s][0], held[s][1:])}
            if better:
                held |= better
                self.blocks.updateValue((block,), ([*held], *[[v[i] for v in held.values()] for i in range(self.values + 1)]))
                out += [(key[0], block * BLOCK + s, *v) for s, v in better.items()]
        if not out:
            return
        names = ["key", "slot", "level", *[f"v{i}" for i in range(self.values)]]
        made = pd.DataFrame(out, columns=names)
        yield made.astype({"slot": "Int64", "level": "Int32", **{c: "float64" for c in names[3:]}})

    def close(self) -> None:
        pass


def improvements(stream: DataFrame, key: str, slot: str, level: str, values: Sequence[str]) -> DataFrame:
    """(key, slot, level, values): what each batch of a stream adds to the best versions.

    Rows without a slot or a level say only that their key was tried, and held nothing.
    Rows without a key are left out; NaN counts as null; repeated rows change nothing.
    `slot` is a whole number, `level` an int, values are doubles.
    """
    ship_package(stream.sparkSession)
    named = stream.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(slot).cast("long").alias("slot"), F.col(level).cast("int").alias("level"), *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)])
    kind = dict(named.dtypes)["key"]
    schema = f"key {kind}, slot long, level int" + "".join(f", v{i} double" for i in range(len(values)))
    best = named.groupBy("key").transformWithStateInPandas(Best(len(values)), schema, "Update", "None")
    return best.select(F.col("key").alias(key), F.col("slot").alias(slot), F.col("level").alias(level), *[F.col(f"v{i}").alias(v) for i, v in enumerate(values)])


def start(better: DataFrame, path: str, checkpoint: str):
    """Append the improvements to a Parquet log, all that is there now, then stop.

    A batch that is written twice after a crash does no harm: the log is read by its best rows.
    """
    spark = better.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)  # state by key and block needs it; taken when the query starts
    try:
        writer = better.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        return writer.foreachBatch(lambda rows, _: rows.write.mode("append").parquet(path)).start()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def best(log: DataFrame, key: str, slot: str, level: str, values: Sequence[str]) -> DataFrame:
    """The best version of each key and slot that a log of improvements holds."""
    return best_version(log.where(F.col(slot).isNotNull()), [key, slot], level, *[F.col(v).asc_nulls_last() for v in values])


def tried(log: DataFrame, key: str) -> DataFrame:
    """The keys that were tried, those that held nothing too."""
    return log.where(F.col(key).isNotNull()).select(key).distinct()
