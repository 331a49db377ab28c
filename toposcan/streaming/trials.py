"""Trial summary that grows as log files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from toposcan.sources.readers import TRIAL_SCHEMA


def stream_trials(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """The trial log as a stream of JSON files."""
    return spark.readStream.schema(TRIAL_SCHEMA).option("maxFilesPerTrigger", max_files).json(path)


def fp_totals(trials: DataFrame) -> DataFrame:
    """Per root: trials that report it and false positives. State is one row per root."""
    return trials.select(F.explode("fp_roots").alias("root", "n")).groupBy("root").agg(
        F.count(F.lit(1)).alias("n_trials"), F.sum("n").alias("n_fp"))


def summary(trials: DataFrame) -> DataFrame:
    """Count, best and mean score; works on a stream and on a table."""
    return trials.groupBy().agg(F.count(F.lit(1)).alias("n_trials"), F.max("score").alias("best_score"), F.avg("score").alias("avg_score"))


def start_summary(trials: DataFrame, name: str, checkpoint: str, fp: bool = True) -> StreamingQuery:
    """Keep a summary up to date as an in-memory table ``name``; it has one row, or one per root."""
    out = fp_totals(trials) if fp else summary(trials)
    return (out.writeStream.outputMode("complete").format("memory").queryName(name)
            .option("checkpointLocation", checkpoint).start())


def run_to_table(trials: DataFrame, path: str, checkpoint: str, fp: bool = True) -> None:
    """Process what has arrived, write the totals after each batch, then stop."""
    out = fp_totals(trials) if fp else summary(trials)
    query = (out.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
             .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).trigger(availableNow=True).start())
    query.awaitTermination()
