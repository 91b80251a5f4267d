"""Implausible readings per source: physically impossible, stuck, or spikes against the source's own behaviour."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonarlake.plans.lineage import group_bounds, keep, range_sorted, whole_groups

SEGMENT_ROWS = 20_000  # a longer series is cut
MARGIN_PARTS = 8  # of so many parts of a segment, one is shown to each neighbour as well
STUCK_RUN = 10
#: Spikes are asked for beyond 14 times the usual scatter. The scatter comes from as few as 40 readings and the level from a filter, so that
#: the ratio as estimated may be a fifth smaller.
SPIKE_SCATTER = 14.0
ESTIMATE_SLACK = 0.8
RESET_AFTER = 8
CELLS = 64  # of absolute differences, to each power of two
ZERO_CELL = -(2**40)


def _cells(d: np.ndarray) -> np.ndarray:
    """The cell of every absolute difference: CELLS to each power of two; ZERO_CELL for none."""
    size = np.abs(d)
    with np.errstate(divide="ignore"):
        return np.where(size > 0, np.floor(np.log2(size) * CELLS), ZERO_CELL).astype(np.int64)


def differences(y: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the first and of the fourth differences that end at readings of one's own."""
    return _cells((y[1:] - y[:-1])[own[1:]]), _cells((y[4:] - y[:-4])[own[4:]])


def _median(cell: np.ndarray, count: np.ndarray) -> float:
    """Median of absolute differences counted by cells in ascending order, within half a cell."""
    total = int(count.sum())
    if not total:
        return 0.0
    upto = np.cumsum(count)
    middle = cell[np.searchsorted(upto, [(total + 1) // 2, total // 2 + 1])]
    return float(np.where(middle == ZERO_CELL, 0.0, 2.0 ** ((middle + 0.5) / CELLS)).mean())


def counted_scatter(near: tuple[np.ndarray, np.ndarray], far: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """``kalman_scatter`` from the counted cells of first and of fourth differences."""
    cell, count = near
    n = int(count.sum())
    moving = cell != ZERO_CELL
    if int(count[moving].sum()) * 2 > n:
        cell, count = cell[moving], count[moving]
    if not n:
        return 0.0, 0.0
    both = 1.4826 * _median(cell, count)  # sqrt(2 obs^2 + step^2)
    wide = 1.4826 * _median(*far) if int(far[1].sum()) > 8 else both  # sqrt(2 obs^2 + 4 step^2)
    step2 = max((wide * wide - both * both) / 3, 0.0)
    obs2 = max((both * both - step2) / 2, both * both / 8)
    return obs2**0.5, min(step2, obs2) ** 0.5


def kalman_scatter(y: np.ndarray) -> tuple[float, float]:
    """Robust standard deviations of a local level model: of the readings around their level, and of the level's steps.

    From the medians of absolute first and fourth differences, which few spikes and shifts don't move. The differences are counted in cells of
    about one percent, so that the counts of parts of a series add up to those of the whole.
    """
    return counted_scatter(*(np.unique(c, return_counts=True) for c in differences(y, np.ones(len(y), bool))))


def kalman_ratio(y: list[float], obs: float, step: float, limit: float) -> list[float]:
    """Innovations of a local level Kalman filter over ``obs``, the scatter of readings around their level.

    An innovation beyond ``limit`` is withheld from the state. Once RESET_AFTER withheld ones follow each other and agree among
    themselves, the level has changed for good and the filter starts anew there.
    """
    out = [0.0] * len(y)
    if not y:
        return out
    r, q = obs * obs, max(step * step, 0.01 * obs * obs)
    head = sorted(y[:9])
    level, p = head[len(head) // 2], r / 4
    held: list[float] = []
    for i, x in enumerate(y):
        p += q
        e = x - level
        out[i] = ratio = e / obs
        if ratio > limit or ratio < -limit:
            held.append(x)
            if len(held) >= RESET_AFTER:
                near = sorted(held[-RESET_AFTER:])
                if near[-2] - near[1] < limit * obs:
                    level, p, held = near[RESET_AFTER // 2], r / 4, []
                else:
                    p = min(p, r)
        else:
            k = p / (p + r)
            level += k * e
            p *= 1 - k
            held = []
        if p > r:
            p = r
    return out


def vanishing(y: np.ndarray, run: int = STUCK_RUN) -> np.ndarray:
    """Readings in ``run`` or more successive ones over which the variance of the innovations vanishes.

    Innovations are those of a filter that takes the last reading for the level: any weight on older readings would let a stuck value
    show only after the level has come close to it.
    """
    out = np.zeros(len(y), bool)
    if len(y) < run:
        return out
    moved = np.r_[0, np.cumsum(np.diff(y) != 0)]  # innovations that are not nothing, so far
    start = np.flatnonzero(moved[run - 1 :] == moved[: len(y) - run + 1])
    edge = np.zeros(len(y) + 1, int)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + run, -1)
    return np.cumsum(edge[:-1]) > 0


def certain(y: np.ndarray, low: np.ndarray | float, high: np.ndarray | float, stuck_run: int = STUCK_RUN) -> np.ndarray:
    """Kinds that need no scatter: 'impossible', 'stuck', else ''."""
    kind = np.full(len(y), "", object)
    kind[vanishing(y, stuck_run)] = "stuck"
    kind[(y < low) | (y > high)] = "impossible"
    return kind


def implausible(y: np.ndarray, low: float, high: float, stuck_run: int = STUCK_RUN, scatter: float = SPIKE_SCATTER, known: tuple[float, float] | None = None) -> np.ndarray:
    """Kinds of one series in time order: '' (plausible), 'impossible', 'stuck' or 'spike'.

    A spike must stand away from the level that the filter predicts going forward in time and from that going backward, on
    the same side: a lasting change of level does so from one side only. Readings that are impossible, or whose innovation
    variance vanishes (equal values in succession), are kept from the filter. ``known``: the scatter of the whole series, if this is a part.
    """
    kind = certain(y, low, high, stuck_run)
    free = np.flatnonzero(kind == "")
    if free.size >= 5:
        z = y[free]
        obs, step = kalman_scatter(z) if known is None else known
        if obs > 0:
            limit = scatter * ESTIMATE_SLACK
            ahead = np.array(kalman_ratio(z.tolist(), obs, step, limit))
            back = np.array(kalman_ratio(z[::-1].tolist(), obs, step, limit))[::-1]
            kind[free[(np.minimum(np.abs(ahead), np.abs(back)) > limit) & (ahead * back > 0)]] = "spike"
    return kind


def segments(rows: DataFrame) -> DataFrame:
    """``rows`` (recording_id, metric, ts, reading_id, ...) with a segment number ``seg``, ``margin`` (shown there for context only) and ``long``.

    Series of up to SEGMENT_ROWS readings stay whole. Longer ones are cut by rank: their rows are range-sorted past the series, ranks follow from the
    counts of the partitions, so many ranks are a part, MARGIN_PARTS parts a segment, and the parts next to it its margins. No task
    gets an unbounded series however its readings lie in time, and a run of STUCK_RUN equal values is whole in one segment at least.
    """
    return _placed(rows)[0]


def _placed(rows: DataFrame) -> tuple[DataFrame, bool]:
    """``segments``, and whether any series is cut."""
    key = ["recording_id", "metric"]
    part_rows = SEGMENT_ROWS // MARGIN_PARTS
    # a row for each long series; broadcast if below the session's threshold
    long = keep(rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > SEGMENT_ROWS).select(*key))
    whole = rows.select(*rows.columns, F.lit(0).alias("seg"), F.lit(False).alias("margin"), F.lit(False).alias("long"))
    if not long.head(1):
        return whole, False
    ranged = range_sorted(rows.join(long, key, "left_semi"), [*key, "ts", "reading_id"])
    held = ranged.groupBy(*key, "pid").agg(F.count("*").alias("c"), F.min("at").alias("first"))
    before = Window.partitionBy(*key).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition that holds some of a series
    offsets = keep(held.select(*key, "pid", "first", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("off")))
    place = F.col("at") - F.col("first") + F.col("off")
    part = F.floor(place / part_rows)
    own = F.floor(part / MARGIN_PARTS).cast("int")
    at = F.pmod(part, F.lit(MARGIN_PARTS))
    places = F.array(
        F.struct(own.alias("seg"), F.lit(False).alias("margin")),
        F.when((at == 0) & (own > 0), F.struct((own - 1).alias("seg"), F.lit(True).alias("margin"))),
        F.when(at == MARGIN_PARTS - 1, F.struct((own + 1).alias("seg"), F.lit(True).alias("margin"))),
    )
    cut_ = ranged.join(offsets, [*key, "pid"]).withColumn("place", F.explode(F.filter(places, lambda x: x.isNotNull())))
    cut_ = cut_.select(*rows.columns, F.col("place.seg").alias("seg"), F.col("place.margin").alias("margin"), F.lit(True).alias("long"))
    return whole.join(long, key, "left_anti").unionByName(cut_), True


def long_scatter(placed: DataFrame, stuck_run: int) -> DataFrame:
    """recording_id, metric, obs, step of the series that are cut, from the counts of their segments."""
    keys = ["recording_id", "metric", "seg"]
    ready = placed.where("long").repartition(*keys).sortWithinPartitions(*keys, "ts", "reading_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, keys):
            ids = b.reading_id.to_numpy()
            b = b[np.r_[True, ids[1:] != ids[:-1]]]
            edge, y = group_bounds(b, keys), b.value.to_numpy()
            low, high = np.nan_to_num(b.low.to_numpy(float), nan=-np.inf), np.nan_to_num(b.high.to_numpy(float), nan=np.inf)
            for i, j in zip(edge[:-1], edge[1:]):
                free = np.flatnonzero(certain(y[i:j], low[i], high[i], stuck_run) == "")
                for lag, cells in enumerate(differences(y[i:j][free], ~b.margin.to_numpy()[i:j][free])):
                    cell, n = np.unique(cells, return_counts=True)
                    yield pd.DataFrame({"recording_id": b.recording_id.iloc[i], "metric": b.metric.iloc[i], "lag": lag, "cell": cell, "n": n})

    counts = ready.mapInPandas(count, "recording_id string, metric string, lag int, cell long, n long").groupBy("recording_id", "metric", "lag", "cell").agg(F.sum("n").alias("n"))

    def settle(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        parts = [(p.cell.to_numpy(), p.n.to_numpy()) for p in (g[g.lag == lag].sort_values("cell") for lag in (0, 1))]
        obs, step = counted_scatter(*parts)
        return pd.DataFrame({"recording_id": [key[0]], "metric": [key[1]], "obs": [obs], "step": [step]})

    # rows of a series are cells: at most CELLS for every power of two that a double has
    return keep(counts.groupBy("recording_id", "metric").applyInPandas(settle, "recording_id string, metric string, obs double, step double"))


def implausible_readings(series: DataFrame, catalog: DataFrame, stuck_run: int = STUCK_RUN, scatter: float = SPIKE_SCATTER) -> DataFrame:
    """Readings of monitored metrics that are impossible, stuck or spikes: reading_id, recording_id, metric, timestamp_s, value, kind.

    Null and NaN values, rows without reading_id, recording, metric or time, and metrics that the catalog does not monitor take
    no part; a null limit in the catalog is no limit. Repeated rows count once. Ties in time stand in order of reading_id. Series
    of fewer than five plausible readings, or without any scatter, get no spikes. Empty tables give an empty result; other columns are ignored.
    """
    limits = catalog.where("monitored").groupBy("metric").agg(F.min("valid_min").alias("low"), F.max("valid_max").alias("high"))
    rows = (
        series.select("reading_id", "recording_id", "metric", F.col("timestamp_s").alias("ts"), "value")
        .where("value is not null and not isnan(value) and ts is not null and not isnan(ts) and reading_id is not null and recording_id is not null")
        .join(limits, "metric")  # a row per metric; broadcast if below the session's threshold
    )
    keys = ["recording_id", "metric", "seg"]
    placed, any_long = _placed(rows)
    if any_long:  # the scatter usual in a series is that of the whole series, wherever it is cut
        placed = placed.join(long_scatter(placed, stuck_run), ["recording_id", "metric"], "left")
    else:
        placed = placed.withColumns({"obs": F.lit(None).cast("double"), "step": F.lit(None).cast("double")})
    ready = placed.repartition(*keys).sortWithinPartitions(*keys, "ts", "reading_id")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, keys):
            ids = b.reading_id.to_numpy()
            b = b[np.r_[True, ids[1:] != ids[:-1]]]  # repeated rows stand together
            edge, y = group_bounds(b, keys), b.value.to_numpy()
            kind = np.empty(len(b), object)
            obs, step = b.obs.to_numpy(float), b.step.to_numpy(float)
            low, high = np.nan_to_num(b.low.to_numpy(float), nan=-np.inf), np.nan_to_num(b.high.to_numpy(float), nan=np.inf)
            for i, j in zip(edge[:-1], edge[1:]):
                kind[i:j] = implausible(y[i:j], low[i], high[i], stuck_run, scatter, None if np.isnan(obs[i]) else (obs[i], step[i]))
            b = b.assign(kind=kind)
            yield b.loc[(kind != "") & ~b.margin.to_numpy(), ["reading_id", "recording_id", "metric", "ts", "value", "kind"]]

    return ready.mapInPandas(judge, "reading_id long, recording_id string, metric string, ts double, value double, kind string").withColumnRenamed("ts", "timestamp_s")
