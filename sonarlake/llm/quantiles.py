"""Percentiles with a deterministic error bound from buffers that collapse, combinable over partitions and days.

A sketch keeps up to k raw values and full buffers of k sorted values, of which one at level l stands for 2^l times as many. Two
buffers of one level collapse into one of the next by taking every other value of the two merged, from the first or the
second place by turns. A collapse at level l moves no rank by more than 2^l; the sum of these is kept as ``err``. Over n values
it is at most n h / 2k with h = log2(n / k), which for k = 2048 is below 1 % up to 2^51 values.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarlake.plans.lineage import group_bounds, whole_groups

K = 2048
FAN_IN = 64
SKETCH = "n long, err long, raw array<double>, levels array<int>, kept array<double>"


class Sketch:
    """The buffers of one group."""

    def __init__(self, k: int = K):
        self.k, self.n, self.err = k, 0, 0
        self.raw = np.empty(0)
        self.full: dict[int, np.ndarray] = {}
        self.turn: dict[int, int] = {}

    def _push(self, level: int, buffer: np.ndarray) -> None:
        while level in self.full:
            both = np.concatenate([self.full.pop(level), buffer])
            both.sort(kind="stable")
            turn = self.turn.get(level, level & 1)
            self.turn[level] = 1 - turn
            buffer = both[turn::2]
            self.err += 1 << level
            level += 1
        self.full[level] = buffer

    def add(self, values: np.ndarray) -> None:
        """Take up raw values."""
        self.n += len(values)
        rest = np.concatenate([self.raw, values])
        cut = len(rest) // self.k * self.k
        for i in range(0, cut, self.k):
            self._push(0, np.sort(rest[i : i + self.k]))
        self.raw = rest[cut:]

    def merge(self, n: int, err: int, raw: np.ndarray, levels: Sequence[int], kept: np.ndarray) -> None:
        """Take up another sketch of the same k."""
        self.n += n - len(raw)
        self.err += err
        for i, level in enumerate(levels):
            self._push(int(level), np.asarray(kept[i * self.k : (i + 1) * self.k]))
        self.add(np.asarray(raw, float))

    def row(self) -> tuple:
        """(n, err, raw, levels, kept)"""
        levels = sorted(self.full)
        return self.n, self.err, self.raw, np.array(levels, np.int32), np.concatenate([self.full[x] for x in levels]) if levels else np.empty(0)


def read_quantiles(raw: np.ndarray, levels: Sequence[int], kept: np.ndarray, ps: Sequence[float], k: int = K) -> np.ndarray:
    """Values at the fractions ``ps``: linear between the two nearest ranks where all is raw, else the value whose weights cover the rank."""
    if not len(levels):
        return np.quantile(raw, ps) if len(raw) else np.full(len(ps), np.nan)
    values = np.concatenate([raw, kept])
    weights = np.concatenate([np.ones(len(raw)), np.repeat(2.0 ** np.asarray(levels, float), k)])
    order = np.argsort(values, kind="stable")
    middle = np.cumsum(weights[order]) - weights[order] / 2
    return np.interp(np.asarray(ps) * weights.sum(), middle, values[order])


def _lists(starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[starts[:1], ends].astype(np.int32) if len(starts) else np.zeros(1, np.int32)), pa.array(values))


def sketches(df: DataFrame, keys: Sequence[str], value: str, k: int = K) -> DataFrame:
    """Sketches of ``value`` per ``keys``: the keys, n, err, raw, levels, kept.

    Null, NaN and infinite values and rows with a null key take no part; an empty table gives an empty result; other columns are
    ignored. Every partition makes one sketch per group before anything is shuffled. Groups with a sketch in many partitions
    are merged in rounds of FAN_IN, so that no task gets an unbounded number of them.
    """
    clean = df.select(*keys, F.col(value).cast("double").alias("__v")).where(" and ".join([f"`{x}` is not null" for x in keys] + ["__v is not null and not isnan(__v) and abs(__v) < double('Infinity')"]))
    kinds = ", ".join(f"`{n}` {t}" for n, t in clean.select(*keys).dtypes)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _partial(batches, list(keys), k)

    made = clean.mapInArrow(partial, f"{kinds}, salt long, {SKETCH}")
    rounds, tasks = 1, _tasks(clean)
    while tasks > FAN_IN:
        rounds, tasks = rounds + 1, tasks / FAN_IN
    for i in range(rounds):
        made = _merged(made, list(keys), kinds, FAN_IN if i < rounds - 1 else None, k)
    return made.drop("salt")


def _tasks(df: DataFrame) -> float:
    """About how many tasks a table is made in at most, from its estimated size; nothing is run for it."""
    conf = df.sparkSession.conf
    size = float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    piece = float(re.sub(r"\D", "", conf.get("spark.sql.files.maxPartitionBytes"))) * {"k": 2.0**10, "m": 2.0**20, "g": 2.0**30}.get(conf.get("spark.sql.files.maxPartitionBytes").lower().rstrip("b")[-1:], 1.0)
    return max(float(conf.get("spark.sql.shuffle.partitions")), min(size, 1e18) / max(piece, 1.0))


def _partial(batches: Iterator[pa.RecordBatch], keys: list[str], k: int, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    salt = TaskContext.get().partitionId() if TaskContext.get() else 0
    held: list[pa.RecordBatch] = []
    rows = 0

    def flush() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        values = t["__v"].to_numpy()
        code = np.zeros(len(values), np.int64)
        for key in keys:
            d = t[key].combine_chunks().dictionary_encode()
            code = code * max(1, len(d.dictionary)) + d.indices.to_numpy()
        order = np.lexsort((values, code))
        code, values = code[order], values[order]
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        ends = np.r_[starts[1:], len(code)]
        head = t.select(keys).take(pa.array(order[starts]))
        small = ends - starts < k
        out = []
        if small.any():
            size = np.where(small, ends - starts, 0)
            mine = np.repeat(small, ends - starts)
            stop = np.cumsum(size[small])
            out.append((np.flatnonzero(small), size[small], np.zeros(small.sum(), np.int64), _lists(stop - size[small], stop, values[mine]), pa.array([[]] * int(small.sum()), pa.list_(pa.int32())), pa.array([[]] * int(small.sum()), pa.list_(pa.float64()))))
        for g in np.flatnonzero(~small):
            s = Sketch(k)
            s.add(values[starts[g] : ends[g]])
            n, err, raw, levels, kept = s.row()
            out.append((np.array([g]), np.array([n]), np.array([err]), pa.array([raw], pa.list_(pa.float64())), pa.array([levels], pa.list_(pa.int32())), pa.array([kept], pa.list_(pa.float64()))))
        for at, n, err, raw, levels, kept in out:
            cols = head.take(pa.array(at))
            arrays = [cols[c].combine_chunks() for c in keys] + [pa.array(np.full(len(at), salt, np.int64)), pa.array(n.astype(np.int64)), pa.array(err.astype(np.int64)), raw, levels, kept]
            yield pa.RecordBatch.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays], [*keys, "salt", "n", "err", "raw", "levels", "kept"])

    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= most:
            yield from flush()
            held, rows = [], 0
    if rows:
        yield from flush()


def _merged(made: DataFrame, keys: list[str], kinds: str, fan_in: int | None, k: int) -> DataFrame:
    salted = made.withColumn("salt", F.floor(F.col("salt") / fan_in) if fan_in else F.lit(0).cast("long"))
    by = [*keys, "salt"]
    ready = salted.repartition(*by).sortWithinPartitions(*by)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, by):
            edge = group_bounds(b, by)
            n, err, raws, levels, kept = b.n.to_numpy(), b.err.to_numpy(), b.raw.to_numpy(), b.levels.to_numpy(), b.kept.to_numpy()
            out = []
            for i, j in zip(edge[:-1], edge[1:]):
                if j - i == 1:
                    out.append((n[i], err[i], raws[i], levels[i], kept[i]))
                elif n[i:j].sum() < k:
                    out.append((n[i:j].sum(), 0, np.concatenate(raws[i:j]), levels[i], kept[i]))
                else:
                    s = Sketch(k)
                    for x in range(i, j):
                        s.merge(int(n[x]), int(err[x]), raws[x], levels[x], kept[x])
                    out.append(s.row())
            res = b.iloc[edge[:-1]][by].reset_index(drop=True)
            for c, x in zip(("n", "err", "raw", "levels", "kept"), zip(*out)):
                res[c] = pd.Series(list(x), dtype="int64" if c in ("n", "err") else object)
            yield res

    return ready.mapInPandas(merge, f"{kinds}, salt long, {SKETCH}")


def combine(made: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """Sketches of finer groups (days, partitions) combined into sketches of ``keys``."""
    kinds = ", ".join(f"`{n}` {t}" for n, t in made.select(*keys).dtypes)
    salted = made.select(*keys, F.pmod(F.xxhash64("raw", "kept"), F.lit(FAN_IN * FAN_IN)).alias("salt"), "n", "err", "raw", "levels", "kept")
    return _merged(_merged(salted, list(keys), kinds, FAN_IN, k), list(keys), kinds, None, k).drop("salt")


def percentiles(made: DataFrame, keys: Sequence[str], ps: Sequence[float], k: int = K) -> DataFrame:
    """keys, n, rank_error (the bound as a fraction of n), q (array in the order of ``ps``)."""
    kinds = ", ".join(f"`{n}` {t}" for n, t in made.select(*keys).dtypes)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[list(keys)].copy()
            out["n"] = b.n
            out["rank_error"] = [e / n + (2.0 ** max(lv) / n if len(lv) else 0.0) for e, n, lv in zip(b.err, b.n, b["levels"])]
            out["q"] = [read_quantiles(np.asarray(r), lv, np.asarray(kp), ps, k) for r, lv, kp in zip(b.raw, b["levels"], b.kept)]
            yield out

    return made.mapInPandas(read, f"{kinds}, n long, rank_error double, q array<double>")
