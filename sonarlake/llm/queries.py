"""Named queries of the operators for training data, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarlake.llm.leakage import leaks
from sonarlake.llm.neighbours import nearest, similar_pairs
from sonarlake.llm.packing import pack
from sonarlake.llm.quantiles import combine, percentiles, sketches
from sonarlake.llm.sentences import sentences
from sonarlake.sources.tables import table

PS = (0.05, 0.25, 0.5, 0.75, 0.95)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of vectors among each other's ten nearest with a cosine of at least 0.96."""
    return similar_pairs(table(spark, d, "feature_vectors"), 10, 0.96)


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar vectors of every twentieth vector, among all of them; the trees offer about a seventh of all vectors."""
    return nearest(table(spark, d, "feature_vectors"), 10, asks=F.col("vec_id") % 20 == 0, share=0.15)


def _series(spark: SparkSession, d: str) -> DataFrame:
    """Readings, repeated rows once."""
    return table(spark, d, "metric_series").select("reading_id", "recording_id", "metric", "captured_on", "value").dropDuplicates(["reading_id"])


def _columns(found: DataFrame, keys: list[str]) -> DataFrame:
    return found.select(*keys, "n", "rank_error", *[F.col("q")[i].alias(f"p{round(100 * p):02d}") for i, p in enumerate(PS)])


def p2_by_metric(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per metric, combined from the sketches of its days."""
    daily = sketches(_series(spark, d), ["metric", "captured_on"], "value")
    return _columns(percentiles(combine(daily, ["metric"]), ["metric"], PS), ["metric"])


def p2_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per metric and day."""
    keys = ["metric", "captured_on"]
    return _columns(percentiles(sketches(_series(spark, d), keys, "value"), keys, PS), keys)


def p2_by_recording(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per recording and metric beside the stored summary of that name."""
    keys = ["recording_id", "metric"]
    found = _columns(percentiles(sketches(_series(spark, d), keys, "value"), keys, PS), keys)
    stored = table(spark, d, "metric_results").groupBy("recording_id", F.col("name").alias("metric")).agg(F.first("summary", True).alias("s"))
    return found.join(stored, keys, "left").select("*", F.col("s.p50").alias("stored_p50"), F.col("s.p95").alias("stored_p95")).drop("s")


def p2_bounds_hold(spark: SparkSession, d: str) -> DataFrame:
    """For every metric and percentile, whether the exact rank of the value given is within the bound that the sketch gives for it."""
    values = _series(spark, d).where("value is not null and not isnan(value) and metric is not null")
    made = percentiles(combine(sketches(_series(spark, d), ["metric", "captured_on"], "value"), ["metric"]), ["metric"], PS)
    # a row per metric; the exact counts are summed before the exchange
    told = values.select("metric", "value").join(made.withColumnRenamed("n", "told"), "metric")
    counts = [f((F.col("value") < F.col("q")[i]).cast("long") if low else (F.col("value") <= F.col("q")[i]).cast("long")).alias(f"{'lt' if low else 'le'}{i}") for i in range(len(PS)) for low, f in ((True, F.sum), (False, F.sum))]
    rows = told.groupBy("metric").agg(F.count("*").alias("n"), F.max("told").alias("told"), F.max("rank_error").alias("e"), *counts)
    checks = [F.struct(F.lit(p).alias("p"), ((F.col(f"lt{i}") <= (p + F.col("e")) * F.col("n") + 1) & (F.col(f"le{i}") >= (p - F.col("e")) * F.col("n") - 1) & (F.col("told") == F.col("n"))).alias("within")) for i, p in enumerate(PS)]
    return rows.select("metric", "n", F.explode(F.array(*checks)).alias("c")).select("metric", "n", "c.p", "c.within")


def p7_assign(spark: SparkSession, d: str) -> DataFrame:
    """The assignment itself: every piece of every document in a bin."""
    return pack(table(spark, d, "documents"), table(spark, d, "containers"))


def p7_totals(spark: SparkSession, d: str) -> DataFrame:
    """Of every kind: documents and tokens placed, and bins that hold more than they can (none)."""
    capacity = table(spark, d, "containers").groupBy("container_id").agg(F.min("capacity_tokens").alias("capacity"))
    bins = p7_assign(spark, d).groupBy("container_id", "bin_id").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("piece") == 0).alias("documents"))
    whole = bins.join(capacity, "container_id").groupBy("container_id")
    return whole.agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") > F.col("capacity")).alias("overfull"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that a kind of container cannot take whole."""
    return pack(table(spark, d, "documents"), table(spark, d, "containers")).where("pieces > 1").select("container_id", "doc_id").distinct()


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Bins used of every kind, and the share of their space that is filled."""
    capacity = table(spark, d, "containers").groupBy("container_id").agg(F.min("capacity_tokens").alias("capacity"))
    packed = pack(table(spark, d, "documents"), table(spark, d, "containers"))
    bins = packed.groupBy("container_id", "bin_id").agg(F.sum("tokens").alias("tokens"))
    total = bins.groupBy("container_id").agg(F.count("*").alias("bins"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return total.join(capacity, "container_id").select("container_id", "bins", "tokens", "fullest", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity")), 4).alias("filled"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that carry test passages, and which."""
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).distinct()


def p8_by_item(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each leaked test item is in."""
    found = p8_found(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"))
    return found.join(table(spark, d, "eval_items").select("item_id", "suite").distinct(), "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Where the sentences and other units of every document end."""
    return sentences(table(spark, d, "documents")).distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_neighbours, p2_by_metric, p2_by_day, p2_by_recording, p2_bounds_hold, p7_found, p7_assign, p7_totals, p7_fill, p8_found, p8_by_item, p9_found)}

SQL = {
    "p2_bounds_hold": """
WITH v AS (SELECT DISTINCT ON (reading_id) metric, value FROM metric_series WHERE value IS NOT NULL AND NOT isnan(value) AND metric IS NOT NULL)
SELECT metric, count(*) AS n, p, true AS within FROM v, (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]::DOUBLE[]) AS p) GROUP BY metric, p""",
    "p7_totals": """
WITH d AS (SELECT DISTINCT doc_id, strlen(text) AS size FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
SELECT container_id, count(*) AS documents, CAST(sum(size) AS BIGINT) AS tokens, 0 AS overfull FROM d, containers GROUP BY container_id""",
    "p7_found": "SELECT DISTINCT container_id, doc_id FROM documents, containers WHERE strlen(text) > capacity_tokens",
}
