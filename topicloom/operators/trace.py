"""Metric traces: parsing, pivots and summaries."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.functions.text import metric_name
from topicloom.sources.scratch import scratch_path

#: Metrics and events that a trace keeps.
STATS = ("num_words", "init_in_sample_nmi", "in_sample_nmi", "out_of_sample_nmi", "out_of_sample_perplexity", "out_of_sample_log_likelihood", "out_of_sample_coherence")
EVENTS = ("resampling",)
#: Of a line's number: the bits of its place in a block. Blocks of a run are parsed side by side.
BLOCK_BITS = 20
#: Tables that are written side by side.
TABLES_AT_ONCE = 8


def parse(lines: DataFrame, iter_key: str = "doc", first_iter: int = 0) -> DataFrame:
    """(run, iter, metric, value, line) from (run, line, value) of ``key: value``
    lines. Each belongs to the last line ``iter_key: number`` above it, or to
    ``first_iter``; what follows a bad number in its run is left out."""
    at = F.instr("value", ":")
    rows = lines.where(at > 0).select("run", "line", metric_name(F.trim(F.expr("substring(value, 1, instr(value, ':') - 1)"))).alias("metric"), F.trim(F.expr("substring(value, instr(value, ':') + 1)")).alias("text"))
    mark = F.col("metric") == iter_key
    rows = rows.withColumn("_iter", F.when(mark, F.expr("try_cast(text as bigint)"))).withColumn("_bad", (mark & F.col("_iter").isNull()).cast("int"))
    rows = rows.withColumn("_block", F.coalesce(F.shiftright(F.col("line").cast("long"), BLOCK_BITS), F.lit(-1 << 62)))
    # what a block of lines leaves to those behind it, one row a block
    marks = rows.where(mark).groupBy("run", "_block").agg(F.max_by("_iter", "line").alias("_last"), F.max("_bad").alias("_spoilt"))
    ahead = Window.partitionBy("run").orderBy("_block")
    blocks = rows.select("run", "_block").distinct().join(marks, ["run", "_block"], "left")
    before = ahead.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("run", "_block", F.last("_last", ignorenulls=True).over(before).alias("_from"), F.max("_spoilt").over(before).alias("_after"))
    rows = rows.join(blocks.where("_from is not null or _after is not null"), ["run", "_block"], "left")
    w = Window.partitionBy("run", "_block").orderBy("line")
    rows = rows.withColumn("iter", F.coalesce(F.last("_iter", ignorenulls=True).over(w), "_from", F.lit(first_iter))).withColumn("_bad", F.greatest(F.max("_bad").over(w), F.coalesce("_after", F.lit(0))))
    return rows.where((F.col("_bad") == 0) & ~mark).select("run", "iter", "metric", F.col("text").alias("value"), "line")


def stat_pivot(metrics: DataFrame, metric: str, runs: list[str]) -> DataFrame:
    """iter x run of a metric's last value, by line; iterations without any value go."""
    rows = metrics.where(F.col("metric") == metric).where(F.col("value") != "NA")
    return rows.groupBy("iter").pivot("run", runs).agg(F.max_by("value", "line"))


def count_pivot(metrics: DataFrame, metric: str, runs: list[str]) -> DataFrame:
    """iter x run counts of an event from 1, 0 where there is none."""
    return metrics.where(F.col("metric") == metric).groupBy("iter").pivot("run", runs).agg(F.count("value")).na.fill(0)


def unpivot(wide: DataFrame, **labels: str) -> DataFrame:
    """(iter, run, val, labels) of a wide table."""
    runs = [c for c in wide.columns if c != "iter"]
    long = wide.unpivot("iter", [f"`{c}`" for c in runs], "run", "val").where("val is not null")
    return long.select("iter", "run", F.expr("try_cast(val as double)").alias("val"), *[F.lit(v).alias(k) for k, v in labels.items()])


def summary(long: DataFrame, *by: str, mult: float = 1.0) -> DataFrame:
    """Mean and mean -+ mult standard deviations over runs."""
    sd = F.coalesce(F.stddev_samp("val"), F.lit(0.0)) * mult
    return long.groupBy(*by).agg(F.avg("val").alias("mean"), (F.avg("val") - sd).alias("low"), (F.avg("val") + sd).alias("high"), F.count("*").alias("runs"))


def write_tsv(wide: DataFrame, path: str) -> None:
    """A table in order; files of a large one follow each other by their names."""
    wide.orderBy("iter").write.option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, log, line, value) of the logs path/dataset/log. Files are read in
    splits; a line's number is where its split begins and its place there, which
    ascends as no line is shorter than its end."""
    rows = spark.read.option("lineSep", "\n").text(f"{path}/*/*")
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("value"))
    place = F.row_number().over(Window.partitionBy("file", "start").orderBy("at")) - 1
    return rows.select(F.regexp_extract("file", "([^/]+)/[^/]+$", 1).alias("dataset"), F.regexp_extract("file", "([^/]+)$", 1).alias("log"), (F.col("start") + place).alias("line"), "value")


def process_logs(spark: SparkSession, path: str, out: str, iter_key: str = "doc") -> dict[str, list[str]]:
    """A table iter x run for each data set below ``path`` and each of STATS and
    EVENTS, written to out/dataset_metric. Runs are numbered in the order of the
    names of their logs; a log without an iteration or a tracked metric has no
    run. Gives the logs of each data set."""
    lines = read_logs(spark, path)
    parsed = parse(lines.select(F.concat_ws("/", "dataset", "log").alias("run"), "line", "value"), iter_key, -1)
    parsed = parsed.where((F.col("iter") >= 0) & F.col("metric").isin(*STATS, *EVENTS)).withColumn("dataset", F.substring_index("run", "/", 1)).withColumn("log", F.substring_index("run", "/", -1)).drop("run")
    kept = scratch_path(spark, "trace")
    parsed.write.option("compression", "zstd").partitionBy("dataset", "metric").parquet(kept)  # a table reads its own folder alone
    parsed = spark.read.schema(parsed.schema).parquet(kept)
    logs: dict[str, list[str]] = {}
    for r in sorted(parsed.select("dataset", "log").distinct().collect()):  # one row a log
        logs.setdefault(r.dataset, []).append(r.log)
    tables = []
    for dataset, names in logs.items():
        number = F.create_map(*[F.lit(x) for k, log in enumerate(names) for x in (log, f"run.{k}")])
        rows = parsed.where(F.col("dataset") == dataset).select(number[F.col("log")].alias("run"), "iter", "metric", "value", "line")
        runs = [f"run.{k}" for k in range(len(names))]
        tables += [(stat_pivot(rows, metric, runs), f"{out}/{dataset}_{metric}") for metric in STATS]
        tables += [(count_pivot(rows, metric, runs), f"{out}/{dataset}_{metric}") for metric in EVENTS]
    with ThreadPool(TABLES_AT_ONCE) as pool:
        pool.starmap(write_tsv, tables, chunksize=1)
    return logs
