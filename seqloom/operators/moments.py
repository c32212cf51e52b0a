"""Mergeable moments: a state (n, mean, m2) of many values, m2 the summed squares of their distances from the mean.

A row's arrays are folded to states in place, and states are merged in pairs: (n1, mean1, m2_1) and (n2, mean2, m2_2) have
mean = mean1 + d * n2 / n and m2 = m2_1 + m2_2 + d * d * n1 * n2 / n for d = mean2 - mean1. Nothing is exploded, and as squares of values
are never subtracted from each other, nothing cancels: equal values give a deviation of exactly 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.storage import free_name, ship

_PARTS = ("n", "mean", "m2")


def _state(n: Column, mean: Column, m2: Column) -> Column:
    return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"))


def _empty() -> Column:
    return _state(F.lit(0).cast("long"), F.lit(0.0), F.lit(0.0))


def folded(values: Column) -> Column:
    """struct<n, mean, m2> of an array<double>; null elements are skipped, and a null array is an empty one."""

    def add(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        d = x - s["mean"]
        mean = s["mean"] + d / n
        return F.when(x.isNull(), s).otherwise(_state(n, mean, s["m2"] + d * (x - mean)))

    return F.coalesce(F.aggregate(values, _empty(), add), _empty())


def merged(a: Column, b: Column) -> Column:
    """The state of the values of both states."""
    n = a["n"] + b["n"]
    d = b["mean"] - a["mean"]
    both = _state(n, a["mean"] + d * b["n"] / n, a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / n)
    return F.when(a["n"] == 0, b).when(b["n"] == 0, a).otherwise(both)


def _merge_all(n: np.ndarray, mean: np.ndarray, m2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States of rows (rows x states each) merged in pairs, and these again, to one row."""
    while len(n) > 1:
        even = len(n) // 2 * 2
        rest = n[even:], mean[even:], m2[even:]
        n1, n2, x, y = n[0:even:2], n[1:even:2], mean[0:even:2], mean[1:even:2]
        total = np.maximum(n1 + n2, 1)
        d = np.where((n1 > 0) & (n2 > 0), y - x, 0.0)
        both = np.where(n1 > 0, x, y) + d * (n2 / total)
        squares = m2[0:even:2] + m2[1:even:2] + d * d * (n1 * (n2 / total))
        n, mean, m2 = (np.concatenate(p) for p in zip((n1 + n2, both, squares), rest, strict=True))
    return n, mean, m2


def merge_rows(df: DataFrame, states: list[str]) -> DataFrame:
    """One row: each state column of df merged over all rows. An empty table gives empty states.

    A task merges its rows to one; these, a row a task, are merged in the order of tasks.
    """
    ship(df.sparkSession)
    flat = df.select(*[F.col(s)[p].alias(f"{s}_{p}") for s in states for p in _PARTS])
    names, kinds = flat.columns, {"n": "long", "mean": "double", "m2": "double"}

    def merge(batches):
        now = np.zeros((1, len(states))), np.zeros((1, len(states))), np.zeros((1, len(states)))
        for b in batches:
            if b.num_rows:
                of = [np.stack([b.column(f"{s}_{p}").to_numpy(zero_copy_only=False).astype(np.float64) for s in states], axis=1) for p in _PARTS]
                now = _merge_all(*(np.concatenate(x) for x in zip(now, of, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(v[:, i].astype(np.int64) if p == "n" else v[:, i]) for i in range(len(states)) for p, v in zip(_PARTS, now, strict=True)], names)

    tasks = flat.mapInArrow(merge, ", ".join(f"`{s}_{p}` {kinds[p]}" for s in states for p in _PARTS))
    task = free_name(tasks, "task")
    tasks = tasks.select(F.spark_partition_id().alias(task), *[_state(*(F.col(f"{s}_{p}") for p in _PARTS)).alias(s) for s in states])
    rows = F.array_sort(F.collect_list(F.struct(task, *states)))  # a row a task
    one = tasks.agg(rows.alias("rows"))
    of = lambda s: F.transform("rows", lambda r: r[s])
    return one.select(*[F.aggregate(of(s), _empty(), merged).alias(s) for s in states])


def numbers_of(column: pa.ListArray) -> np.ndarray:
    """All elements of a column of lists of doubles, one after another; null ones as NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts, one after another, and where each begins and the last ends; null ones are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    return np.frombuffer(data or b"", dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def text_codes(column: pa.Array) -> np.ndarray:
    """The code points of a column of texts, one after another."""
    data, _ = text_bytes(column)
    return data if not len(data) or data.max() < 128 else np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)


def _counted_state(x: np.ndarray, counts: np.ndarray) -> tuple[int, float, float]:
    """_state_of the values x, each as often as counts say."""
    keep = np.isfinite(x) & (counts > 0)
    x, counts = x[keep], counts[keep]
    if not len(x):
        return 0, 0.0, 0.0
    n, d = int(counts.sum()), x - x[0]
    mean = float((d * counts).sum() / n)
    return n, x[0] + mean, float((np.square(d - mean) * counts).sum())


def _state_of(x: np.ndarray) -> tuple[int, float, float]:
    """The state of the finite values of x; distances are taken from the first, so that equal values give 0."""
    x = x[np.isfinite(x)]
    if not len(x):
        return 0, 0.0, 0.0
    d = x - x[0]
    mean = d.mean()
    return len(x), x[0] + mean, float(np.square(d - mean).sum())


def list_states(df: DataFrame, scales: dict[str, np.ndarray] | None = None) -> DataFrame:
    """df's columns, lists of doubles, as states of all their elements, in numpy: a row a batch of rows. Missing, NaN and infinite ones are skipped.

    scales: df's first column is texts, and these stand for as many lists before the others: values by code point, the last one for all beyond.
    """
    ship(df.sparkSession)
    texts, lists = (df.columns[:1], df.columns[1:]) if scales else ([], df.columns)
    names = [*(scales or {}), *lists]

    def fold(batches):
        for b in batches:
            states = []
            if texts:
                most = len(next(iter(scales.values())))
                counts = np.bincount(np.minimum(text_codes(b.column(0)), most - 1), minlength=most)
                states = [_counted_state(values, counts) for values in scales.values()]
            states += [_state_of(numbers_of(b.column(c))) for c in lists]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for s in states for v in s], [f"{c}_{p}" for c in names for p in _PARTS])

    rows = df.mapInArrow(fold, ", ".join(f"`{c}_n` long, `{c}_mean` double, `{c}_m2` double" for c in names))
    return rows.select(*[_state(*(F.col(f"{c}_{p}") for p in _PARTS)).alias(c) for c in names])


def mean_of(state: Column, empty: float | None = None) -> Column:
    """The mean; `empty` where there is no value."""
    return F.when(state["n"] > 0, state["mean"]).otherwise(F.lit(empty).cast("double"))


def deviation_of(state: Column, empty: float | None = None) -> Column:
    """The population deviation; `empty` where there is no value."""
    return F.when(state["n"] > 0, F.sqrt(state["m2"] / state["n"])).otherwise(F.lit(empty).cast("double"))
