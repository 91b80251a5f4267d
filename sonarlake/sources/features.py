"""Feature vectors from files and to files."""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "frame_idx long, time_s double, matrix array<double>, feature_names array<string>"


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """frame_idx, time_s, matrix, feature_names of one file: .npz (times_s, features, feature_names), .npy (times are places), or .csv (time first).

    CSV is read by the executors; the NumPy formats are files of one recording.
    """
    suffix = Path(path).suffix.lower()
    if suffix == ".csv":
        rows = spark.read.option("header", True).option("inferSchema", True).csv(path)
        if len(rows.columns) < 2:
            raise ValueError("a time and at least one feature are needed")
        names = rows.columns[1:]
        timed = rows.select(F.col(rows.columns[0]).cast("double").alias("time_s"), F.array(*[F.col(f"`{n}`").cast("double") for n in names]).alias("matrix"))
        return timed.select(F.monotonically_increasing_id().alias("frame_idx"), "time_s", "matrix", F.array(*map(F.lit, names)).alias("feature_names"))
    if suffix == ".npz":
        with np.load(path, allow_pickle=False) as z:
            matrix = z["features"] if "features" in z else z["matrix"]
            times = z["times_s"] if "times_s" in z else np.arange(len(matrix), dtype=float)
            names = [str(n) for n in z["feature_names"]] if "feature_names" in z else [f"f{i:03d}" for i in range(matrix.shape[1])]
    elif suffix == ".npy":
        matrix = np.load(path)
        times, names = np.arange(len(matrix), dtype=float), [f"f{i:03d}" for i in range(matrix.shape[1])]
    else:
        raise ValueError(f"{suffix} is no format of feature vectors")
    rows = [(i, float(t), [float(v) for v in m], names) for i, (t, m) in enumerate(zip(times, matrix))]
    return spark.createDataFrame(rows, COLUMNS)


def save_vectors(vectors: DataFrame, path: str, most: int = 1_000_000) -> None:
    """The vectors of one recording, at most ``most``, as .npz, or of any number of them as a folder of CSV or parquet."""
    if path.endswith(".npz"):
        rows = vectors.orderBy("frame_idx").limit(most + 1).toPandas()
        if len(rows) > most:
            raise ValueError(f"more than {most} vectors; write a folder")
        matrix = np.stack(rows.matrix).astype(np.float32) if len(rows) else np.empty((0, 0), np.float32)
        np.savez(path, times_s=rows.time_s.to_numpy(), features=matrix, feature_names=np.array(rows.feature_names.iloc[0] if len(rows) else [], str))
    elif path.endswith(".csv"):
        names = vectors.first().feature_names
        vectors.select("time_s", *[F.col("matrix")[i].alias(n) for i, n in enumerate(names)]).write.mode("overwrite").option("header", True).csv(path)
    else:
        vectors.write.mode("overwrite").parquet(path)
