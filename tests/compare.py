"""Compare a query's rows with its SQL twin's, as sets with repeats."""

from __future__ import annotations

import datetime
import glob
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings kite_status kite_status_normalized kite_daily_active_users mixpanel_people_raw tags subject_areas subject_examples mix_targets pack_capacities".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def norm(v: object) -> object:
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return float(v) if type(v).__name__ == "Decimal" else v


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """An empty text if both have the same columns and rows."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    theirs = rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a = Counter(tuple(norm(r[c]) for c in sorted(names)) for r in df.collect())
    place = [names.index(c) for c in sorted(names)]
    b = Counter(tuple(norm(r[i]) for i in place) for r in theirs)
    if a == b:
        return ""
    return f"{sum(a.values())} and {sum(b.values())} rows; only here {list((a - b).items())[:3]}; only there {list((b - a).items())[:3]}"
