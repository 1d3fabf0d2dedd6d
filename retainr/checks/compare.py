"""Order-insensitive comparison of a Spark result with a DuckDB oracle result.

Used by the tests and by ``python -m retainr.checks.run_oracle``.  Values are normalised
(decimals and floats rounded to ``digits``, dates and timestamps to ISO text, NULL/NaN to None),
columns are sorted by name and the rows compared as multisets.
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math
from collections import Counter

DRIVER_VIEWS = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                "events", "documents", "embeddings", "pages", "benchmark", "labels",
                "conversations"]


def duckdb_connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in DRIVER_VIEWS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits: int):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    try:
        import pandas as pd

        if v is pd.NaT or v is pd.NA:
            return None
        if isinstance(v, pd.Timestamp):
            v = v.to_pydatetime()
    except ImportError:  # pragma: no cover
        pass
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        r = round(v, digits)
        return 0.0 if r == 0 else r
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        return _norm(v.item(), digits)
    if isinstance(v, _dt.datetime):
        if v.hour == v.minute == v.second == v.microsecond == 0:
            return v.date().isoformat()
        return v.isoformat(sep=" ")
    if isinstance(v, _dt.date):
        return v.isoformat()
    return v


def normalise(pdf, digits: int = 6) -> tuple[list[str], Counter]:
    cols = sorted(pdf.columns)
    rows = Counter()
    for rec in pdf[cols].itertuples(index=False, name=None):
        rows[tuple(_norm(v, digits) for v in rec)] += 1
    return cols, rows


def compare(spark_pdf, oracle_pdf, digits: int = 6) -> tuple[bool, str]:
    c1, r1 = normalise(spark_pdf, digits)
    c2, r2 = normalise(oracle_pdf, digits)
    if c1 != c2:
        return False, f"columns differ: spark={c1} oracle={c2}"
    n1, n2 = sum(r1.values()), sum(r2.values())
    if n1 != n2:
        return False, f"row counts differ: spark={n1} oracle={n2}"
    if r1 != r2:
        only1 = list((r1 - r2).elements())[:3]
        only2 = list((r2 - r1).elements())[:3]
        return False, f"values differ ({c1}); spark-only {only1}; oracle-only {only2}"
    return True, f"{n1} rows match"
