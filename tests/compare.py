"""Rows of a Spark query and of its SQL as comparable multisets."""

import datetime
from collections import Counter

import numpy as np
import pandas as pd


def _value(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float | np.floating) and x != x):
        return None
    if isinstance(x, bool | np.bool_):
        return bool(x)
    if isinstance(x, int | float | np.integer | np.floating):
        return round(float(x), 6) + 0.0
    if isinstance(x, datetime.datetime):
        return str(pd.Timestamp(x).tz_localize(None))
    return str(x.tolist()) if hasattr(x, "tolist") else str(x)


def rows(frame: pd.DataFrame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), Counter(tuple(_value(x) for x in r) for r in frame.itertuples(index=False))


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con
