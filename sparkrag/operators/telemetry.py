"""Counters, histograms and gauges over event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: str, bounds: list[float], labels: list[str]) -> DataFrame:
    """labels, le, bucket (observations up to le, cumulative; the last le is infinite), sum, count."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    one = df.groupBy(*labels).agg(*counts, F.sum(value).alias("sum"), F.count(value).alias("count"))
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("bucket")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("bucket")))
    return one.select(*labels, F.explode(rows).alias("x"), "sum", "count").select(*labels, "x.le", "x.bucket", "sum", "count")


def histogram_quantile(hist: DataFrame, q: float, labels: list[str]) -> DataFrame:
    """labels and the q-quantile, interpolated within its bucket; the infinite bucket gives the last finite bound."""
    line = W.partitionBy(*labels).orderBy("le")
    df = hist.withColumn("low", F.lag("le").over(line)).withColumn("below", F.coalesce(F.lag("bucket").over(line), F.lit(0))).withColumn("rank", F.lit(q) * F.col("count"))
    hit = df.where((F.col("bucket") >= F.col("rank")) & (F.col("count") > 0)).withColumn("nth", F.row_number().over(line)).where("nth = 1")
    start = F.coalesce("low", F.when(F.col("le") <= 0, F.col("le")).otherwise(0.0))
    inside = start + (F.col("le") - start) * (F.col("rank") - F.col("below")) / F.nullif(F.col("bucket") - F.col("below"), F.lit(0))
    return hit.select(*labels, F.when(F.col("le") == float("inf"), F.col("low")).otherwise(F.coalesce(inside, start)).alias("quantile"))


def increase(samples: DataFrame, labels: list[str], window: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """labels, start, increase of a counter (ts, value) over windows; a fall is a reset, after which it counted from 0.
    Samples of equal ts go by the columns ties.

    Each day's samples are one ordered run; the last value before a run comes from the days' own last values, so no task
    sorts a label's whole history.
    """
    day = F.date_trunc("day", F.col("ts")).alias("_day")
    order = ["ts", *ties]
    own = samples.select("*", day)
    ends = own.groupBy(*labels, "_day").agg(F.max_by("value", F.struct(*order)).alias("_last"))
    ends = ends.withColumn("_prior", F.lag("_last").over(W.partitionBy(*labels).orderBy("_day"))).drop("_last")
    run = F.lag("value").over(W.partitionBy(*labels, "_day").orderBy(*order))
    first = F.row_number().over(W.partitionBy(*labels, "_day").orderBy(*order)) == 1
    own = own.join(ends, [*labels, "_day"]).withColumn("_before", F.when(first, F.col("_prior")).otherwise(run))
    step = F.when(F.col("_before").isNull(), 0).when(F.col("value") < F.col("_before"), F.col("value")).otherwise(F.col("value") - F.col("_before"))
    return own.withColumn("_step", step).groupBy(*labels, F.window("ts", window).alias("_w")).agg(F.sum("_step").alias("increase")).select(*labels, F.col("_w.start").alias("start"), "increase")


def mean_from_histogram(hist: DataFrame, labels: list[str]) -> DataFrame:
    one = hist.where(F.col("le") == float("inf"))
    return one.groupBy(*labels).agg((F.sum("sum") / F.sum("count")).alias("mean"))


def share_of_kind(df: DataFrame, kind: str) -> DataFrame:
    n = df.groupBy(kind).agg(F.count("*").alias("n"))
    return n.crossJoin(n.agg(F.sum("n").alias("total"))).select(kind, (F.col("n") / F.col("total")).alias("share"))


def query_totals(log: DataFrame) -> DataFrame:
    """method, outcome, queries, tokens_in, tokens_out; tokens that were not reported do not count."""
    return log.groupBy("method", "outcome").agg(F.count("*").alias("queries"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


def last_run(runs: DataFrame) -> DataFrame:
    """finished_at, seconds and documents of the run that finished last."""
    best = F.max_by(F.struct("finished_at", "seconds", "documents"), F.struct("finished_at", "run_id"))
    return runs.where("finished_at is not null").agg(best.alias("x")).where("x is not null").select("x.*")


def status_counts(docs: DataFrame, status: str = "status") -> DataFrame:
    return docs.groupBy(F.coalesce(status, F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def in_flight(docs: DataFrame, status: str = "status") -> DataFrame:
    return docs.agg(F.count_if(F.lower(status).isin("pending", "processing", "parsing", "analyzing", "failed")).alias("in_flight"))


def progress(events: DataFrame) -> DataFrame:
    """events (run_id, event_id, total) with the number done so far in their run."""
    line = W.partitionBy("run_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    return events.withColumn("done", F.count("*").over(line))
