"""Shared by the tests: little panels and row comparison."""

import datetime as dt

import numpy as np
import pandas as pd

DAY = dt.date(2020, 1, 1)


def day(n: int) -> dt.date:
    return DAY + dt.timedelta(days=n)


def panel(spark, values: dict, names=("y",), start=0):
    """values: region -> list of numbers (or tuples of numbers) by day."""
    rows = []
    for region, series in values.items():
        for n, v in enumerate(series):
            v = v if isinstance(v, tuple) else (v,)
            rows.append((region, day(start + n), *(None if x is None else float(x) for x in v)))
    columns = ", ".join(f"{c} double" for c in names)
    kind = "string" if isinstance(next(iter(values)), str) else "bigint"
    return spark.createDataFrame(rows, f"region {kind}, t date, {columns}")


def by_key(df, *keys):
    """{key tuple: other columns as a dict}."""
    return {tuple(r[k] for k in keys): {c: r[c] for c in df.columns if c not in keys} for r in df.collect()}


def series(df, column="y"):
    """{region: values in date order}."""
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r["region"], r["t"])):
        found.setdefault(r["region"], []).append(r[column])
    return found


def same_rows(a, b, digits=9):
    def clean(df):
        columns = sorted(df.columns)
        return sorted(
            (tuple(round(r[c], digits) if isinstance(r[c], float) else r[c] for c in columns) for r in df.collect()), key=repr
        )

    return clean(a) == clean(b)


def points(spark, xy: np.ndarray):
    frame = pd.DataFrame(xy, columns=[f"x{n}" for n in range(xy.shape[1])])
    frame.insert(0, "region", np.arange(len(frame)))
    return spark.createDataFrame(frame), list(frame.columns[1:])


def brute_nearest(xy: np.ndarray, k: int) -> set:
    found = set()
    for i, p in enumerate(xy):
        d2 = ((xy - p) ** 2).sum(axis=1)
        order = [j for j in np.lexsort((np.arange(len(xy)), d2)) if j != i]
        found |= {(i, int(j)) for j in order[:k]}
    return found


def brute_within(xy: np.ndarray, threshold: float) -> set:
    d = np.sqrt(((xy[:, None, :] - xy[None, :, :]) ** 2).sum(axis=2))
    return {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= threshold)) if i != j}


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
