"""Archives that keep arriving: a file stream of containers into an entries table, and a log of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratalog.sources import archives

_FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, glob: str = "*", files_per_trigger: int = 100) -> DataFrame:
    """Entries of archives as they arrive; the rate is bounded by files."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return archives.entries(files)


def ingest(spark: SparkSession, path: str, table: str, checkpoint: str, glob: str = "*") -> StreamingQuery:
    """Appends what has arrived to a Parquet table, each file exactly once, and stops."""
    out = arriving(spark, path, glob).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True).start()


def run_row(spark: SparkSession, run_id: str, command: str, paths: list[str], success: bool, seconds: float, ts: str, metadata: dict[str, str] | None = None) -> DataFrame:
    """A row of the log of runs; the log is appended to, never changed."""
    return spark.createDataFrame([(run_id, command, paths, success, seconds, ts, metadata or {})], "run_id string, command string, paths array<string>, success boolean, seconds double, ts string, metadata map<string,string>").withColumn("ts", F.col("ts").cast("timestamp"))


def undone(runs: DataFrame) -> DataFrame:
    """Runs that are in effect, newest first: those whose last undo, if any, was redone.

    An undo and a redo name a run, or with ``macro`` all runs of a batch (metadata ``macro`` of the runs).
    """
    last = undo_state(runs)
    return runs.where("command not in ('undo', 'redo')").join(last.where("command = 'undo'"), "run_id", "left_anti").orderBy(F.desc("ts"), "run_id")


def undo_state(runs: DataFrame) -> DataFrame:
    """run_id and the last undo or redo that reached each run."""
    moves = runs.where("command in ('undo', 'redo')").select(F.col("command").alias("move"), "ts", F.col("run_id").alias("by"), F.element_at("metadata", F.lit("run_id")).alias("target"), F.element_at("metadata", F.lit("macro")).alias("macro"))
    plain = runs.where("command not in ('undo', 'redo')").select("run_id", F.element_at("metadata", F.lit("macro")).alias("macro"))
    single = moves.where("target is not null").select(F.col("target").alias("run_id"), "move", "ts", "by")
    whole = plain.join(moves.where("target is null").select("macro", "move", "ts", "by"), "macro").select("run_id", "move", "ts", "by")
    return single.unionByName(whole).groupBy("run_id").agg(F.max_by("move", F.struct("ts", "by")).alias("command"))


def redoable(runs: DataFrame) -> DataFrame:
    """Runs that were undone and not redone since, newest first."""
    return runs.join(undo_state(runs).where("command = 'undo'").select("run_id"), "run_id", "left_semi").orderBy(F.desc("ts"), "run_id")
