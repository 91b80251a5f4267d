"""Cutting lineage, range-sorted partitions and group-wise batches: what the multi-pass operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names; a folder of our own only where none is named (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="sonarlake-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder: later passes read it again, also after executors are lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it from there.

    Unlike ``cut`` it is read by columns and its size is known to the optimizer, but its partitions are not kept. Tables are removed
    when the driver ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended before
        pass


def range_sorted(df: DataFrame, by: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Globally sorted partitions, cut, with their number as column ``pid`` and the place of every row: ``at`` counts up by one within a partition.

    A key that holds a third of all rows is spread over many partitions, as ``by`` goes on past the key.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumns({"pid": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))


def whole_groups(batches: Iterable[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Batches of a partition sorted by ``keys``, cut anew so that no group of equal keys is torn apart."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = np.ones(len(batch), bool)
        for k in keys:
            col = batch[k].to_numpy()
            last &= col == col[-1]
        start = len(batch) - int(np.argmin(last[::-1])) if not last.all() else 0
        head, tail = batch.iloc[:start], batch.iloc[start:]
        if held and any(held[-1][k].iloc[-1] != batch[k].iloc[0] for k in keys):
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
            held = []
        if len(head):
            yield pd.concat([*held, head], ignore_index=True)
            held = [tail]
        else:
            held.append(tail)
    if held:
        yield pd.concat(held, ignore_index=True)


def group_bounds(frame: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Start positions of the groups of equal keys in a sorted frame, and its length at the end."""
    n = len(frame)
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for k in keys:
        col = frame[k].to_numpy()
        new[1:] |= col[1:] != col[:-1]
    return np.append(np.flatnonzero(new), n)
