"""Compare a query's rows with its DuckDB oracle: names, types and values."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    return v


def _key(row):
    return tuple((v is None, str(type(v)), v if not isinstance(v, float) else round(v, 3)) for v in row)


def differences(df, con, sql: str, tolerance: float = 0.0) -> list[str]:
    """What differs; values within the tolerance (absolute and relative) are equal."""
    names = sorted(df.columns)
    cursor = con.execute(sql)
    theirs = {c[0]: str(c[1]) for c in cursor.description}
    got_rows = cursor.fetchall()
    out = []
    if sorted(theirs) != names:
        return [f"columns {names} against {sorted(theirs)}"]
    kinds = dict(df.dtypes)
    out += [f"type of {c}: {kinds[c]} against {theirs[c]}" for c in names if KINDS.get(kinds[c]) != theirs[c]]
    at = [list(theirs).index(c) for c in names]
    want = sorted((tuple(_value(r[i]) for i in at) for r in got_rows), key=_key)
    have = sorted((tuple(_value(v) for v in r) for r in df.select(*names).collect()), key=_key)
    if len(want) != len(have):
        return [*out, f"{len(have)} rows against {len(want)}"]
    bad = 0
    for h, w in zip(have, want, strict=True):
        same = all(a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= tolerance * max(1.0, abs(b))) for a, b in zip(h, w, strict=True))
        if not same:
            bad += 1
            if bad <= 2:
                out.append(f"{dict(zip(names, h, strict=True))} against {dict(zip(names, w, strict=True))}")
    return [*out, f"{bad} rows differ"] if bad else out
