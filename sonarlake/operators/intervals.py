"""Overlapping and gapped intervals: continuous periods per entity and the gaps between them.

Rows are range-sorted over the whole cluster by entity and start. One pass takes from every partition the largest end of
its last entity; a prefix combination of these summaries (one row per partition) tells each partition the largest end that
came before it; the second pass rescans with that state. An entity may thus span any number of partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarlake.plans.lineage import cut, range_sorted

_LOWEST = -(2**62)


def hms_to_seconds(col: Column) -> Column:
    """``HH:MM:SS.mmm`` as seconds; null where it does not have that form."""
    ok = col.rlike(r"^\d+:\d{1,2}:\d{1,2}(\.\d+)?$")
    part = F.split(F.when(ok, col), ":")
    return part[0].cast("double") * 3600 + part[1].cast("double") * 60 + part[2].cast("double")


def _usable(df: DataFrame, entity: str, start: str, end: str, gap: str, others: list[str]) -> DataFrame:
    rows = df.select(
        F.col(entity).alias("entity"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"), F.coalesce(F.col(gap).cast("long"), F.lit(0)).alias("g"), *others
    )
    return rows.where("entity is not null and s is not null and e is not null and e >= s")


class _Scan:
    """The two passes over range-sorted intervals, and what crosses the edges of partitions."""

    def __init__(self, rows: DataFrame):
        kind = dict(rows.dtypes)["entity"]
        self.ranged = range_sorted(rows, ["entity", "s", "e"])
        slim = self.ranged.select("entity", "s", "e", "g", "pid")

        def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            first = last = top = pid = None
            for b in batches:
                if len(b):
                    first, pid = (b.entity.iloc[0], int(b.pid.iloc[0])) if pid is None else (first, pid)
                    mine = b.e.to_numpy()[b.entity.to_numpy() == b.entity.iloc[-1]].max()
                    top = max(top, mine) if last == b.entity.iloc[-1] else mine
                    last = b.entity.iloc[-1]
            if pid is not None:
                yield pd.DataFrame({"pid": [pid], "first": [first], "last": [last], "top": [top]})

        # one row per partition, whatever the size of the data
        self.carried: dict[int, tuple] = {}
        state = None
        for r in sorted(slim.mapInPandas(summary, f"pid int, first {kind}, last {kind}, top long").collect(), key=lambda r: r.pid):
            if state and state[0] == r.first:
                self.carried[r.pid] = state
            state = (r.last, max(state[1], r.top) if state and state[0] == r.last else r.top)
        carried = self.carried

        def rescan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            entity, top, opened, known, pid, begun = None, _LOWEST, 0, True, -1, False
            for b in batches:
                if not len(b):
                    continue
                if not begun:
                    begun, pid = True, int(b.pid.iloc[0])
                    if pid in carried:
                        (entity, top), known = carried[pid], False
                first, new, before, last_top = _breaks(b, entity, top)
                ent, s = b.entity.to_numpy(), b.s.to_numpy()
                at = np.flatnonzero(new)
                if at.size:
                    # an opening closes the island before it; the start of the first of these comes from the state
                    starts = np.r_[opened, s[at[:-1]]]
                    owner = np.r_[np.array([entity if entity is not None else ent[0]], object), ent[at[:-1]].astype(object)]
                    is_known = np.r_[known, np.ones(at.size - 1, bool)]
                    keep = np.ones(at.size, bool)
                    keep[0] = entity is not None
                    # where the entity changes, the end of its last island is the running end of the row before
                    ends = np.where(first[at], np.r_[top, last_top[:-1]][at], before[at])
                    yield pd.DataFrame({"pid": pid, "entity": owner, "kind": np.where(is_known, "period", "head"), "s": np.where(is_known, starts, 0), "e": ends})[keep]
                    inner = at[~first[at]]
                    yield pd.DataFrame({"pid": pid, "entity": ent[inner], "kind": "gap", "s": before[inner], "e": s[inner]})
                    opened, known = int(s[at[-1]]), True
                entity, top = ent[-1], int(last_top[-1])
            if begun:
                yield pd.DataFrame({"pid": [pid], "entity": [entity], "kind": ["open" if known else "through"], "s": [opened], "e": [top]})

        self.found = cut(slim.mapInPandas(rescan, f"pid int, entity {kind}, kind string, s long, e long"))
        # at most two rows per partition: islands that cross its edges
        edges = self.found.where("kind in ('head', 'open', 'through')").collect()
        self.closed: list[tuple] = []
        self.heads: dict[int, int] = {}
        current = None
        for pid in sorted({r.pid for r in edges}):
            mine = {r.kind: r for r in edges if r.pid == pid}
            if pid in carried:
                self.heads[pid] = current[1]
            if "through" in mine:
                current = (current[0], current[1], mine["through"].e)
                continue
            if "head" in mine:
                self.closed.append((current[0], "period", current[1], mine["head"].e))
            elif current:
                self.closed.append((current[0], "period", current[1], current[2]))
            r = mine["open"]
            current = (r.entity, r.s, r.e)
        if current:
            self.closed.append((current[0], "period", current[1], current[2]))


def _breaks(b: pd.DataFrame, entity, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row of a sorted batch: is it the first of its entity, does it open an island, the latest end before it and with it."""
    ent, s, e, g = b.entity.to_numpy(), b.s.to_numpy(), b.e.to_numpy(), b.g.to_numpy()
    first = np.r_[entity is None or ent[0] != entity, ent[1:] != ent[:-1]]
    code = np.cumsum(first)
    running = pd.Series(np.r_[top, e]).groupby(np.r_[0, code]).cummax().to_numpy()
    before = np.where(first, _LOWEST, running[:-1])
    return first, first | (s > before + g), before, running[1:]


def merge_intervals(df: DataFrame, entity: str, start: str, end: str, gap: str) -> DataFrame:
    """Periods and gaps of ``df`` (entity, start, end, gap; the last three of type long, in one unit).

    An interval joins the period before it if it starts no later than the latest end so far plus its ``gap``.
    Result: entity, kind ('period' or 'gap'), start, end. Rows with a null entity, start or end, or with end before start,
    take no part; a null gap counts as 0; repeated rows and intervals of no length change nothing; other columns are ignored;
    an empty table gives an empty result.
    """
    scan = _Scan(_usable(df, entity, start, end, gap, []))
    kind = dict(scan.found.dtypes)["entity"]
    patched = df.sparkSession.createDataFrame(scan.closed, f"entity {kind}, kind string, s long, e long")
    whole = scan.found.where("kind in ('period', 'gap')").select("entity", "kind", "s", "e").unionByName(patched)
    return whole.select(F.col("entity").alias(entity), "kind", F.col("s").alias(start), F.col("e").alias(end))


def label_intervals(df: DataFrame, entity: str, start: str, end: str, gap: str, others: list[str]) -> DataFrame:
    """entity, start, end, ``others``, island_start: every usable interval with the start of the period it belongs to.

    The same periods, and the same rows left out, as ``merge_intervals``. ``others`` must not be named entity, s, e, g or pid.
    """
    scan = _Scan(_usable(df, entity, start, end, gap, others))
    carried, heads = scan.carried, scan.heads
    kinds = ", ".join(f"`{n}` {t}" for n, t in scan.ranged.drop("pid").dtypes)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entity_, top, opened, begun = None, _LOWEST, 0, False
        for b in batches:
            if not len(b):
                continue
            if not begun:
                begun, pid = True, int(b.pid.iloc[0])
                if pid in carried:
                    (entity_, top), opened = carried[pid], heads[pid]
            _, new, _, running = _breaks(b, entity_, top)
            island = np.r_[opened, b.s.to_numpy()[new]][np.cumsum(new)]
            yield b.drop(columns="pid").assign(island=island)
            entity_, top, opened = b.entity.iloc[-1], int(running[-1]), int(island[-1])

    out = scan.ranged.mapInPandas(label, f"{kinds}, island long")
    return out.select(F.col("entity").alias(entity), F.col("s").alias(start), F.col("e").alias(end), *others, F.col("island").alias("island_start"))


def moment_periods(moments: DataFrame, config: DataFrame) -> DataFrame:
    """Periods and gaps of the moments of each recording, in milliseconds, under the ``merge_gap_s`` of the project.

    A null (or NaN) start_s or end_s is taken from the hms column, a still missing end from start plus duration_s. A project
    that the configuration does not name, or names with a null, has a merge gap of 0.
    """
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    start = F.coalesce(number("start_s"), hms_to_seconds(F.col("start_hms")))
    end = F.coalesce(number("end_s"), hms_to_seconds(F.col("end_hms")), start + number("duration_s"))
    gaps = config.groupBy("project").agg(F.max("merge_gap_s").alias("merge_gap_s"))
    rows = moments.select("recording_id", "project", F.round(start * 1000).cast("long").alias("start_ms"), F.round(end * 1000).cast("long").alias("end_ms"))
    # the configuration has a row per project; Catalyst broadcasts it if it is below the session's threshold, and shuffles otherwise
    joined = rows.join(gaps, "project", "left").withColumn("gap_ms", F.round(F.col("merge_gap_s") * 1000).cast("long"))
    return merge_intervals(joined, "recording_id", "start_ms", "end_ms", "gap_ms")
