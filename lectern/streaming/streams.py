"""Streams: documents folded as they arrive, notes and library events kept current, activity windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.fold import fold_local
from ..operators.notes import apply_note_changes
from ..operators.segment import units_of


def fold_stream(docs: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Arriving documents (doc_id, lang, text and a time) as folded units; the same document and language within the
    watermark is folded once. State is bounded by the watermark."""
    once = docs.withWatermark(time, late).dropDuplicatesWithinWatermark(["doc_id", "lang"])
    return fold_local(units_of(once)).select("doc_id", "pos", "key", "takeaway", "topic")


#: Buckets of a note table. A batch writes those again that its notes fall into.
BUCKETS = 64


def _held(spark: SparkSession, path: str) -> dict[int, list[tuple[int, str]]]:
    """For each bucket below path its finished versions, oldest first, with their folders. A version is finished once its files are all there."""
    fs = spark._jvm.org.apache.hadoop.fs
    files = fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    done = {x.getPath().getParent().getName() for x in files.globStatus(fs.Path(f"{path}/v=*/_SUCCESS")) or []}
    held: dict[int, list[tuple[int, str]]] = {}
    for x in files.globStatus(fs.Path(f"{path}/v=*/b=*")) or []:
        version = x.getPath().getParent().getName()
        if version in done:
            held.setdefault(int(x.getPath().getName()[2:]), []).append((int(version[2:]), str(x.getPath())))
    return {b: sorted(v) for b, v in held.items()}


def current_notes(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, note_id, created, updated, text from each bucket's newest finished version. Readers never meet a half-written one."""
    return apply_note_changes(spark.read.parquet(*[versions[-1][1] for versions in _held(spark, path).values()]))


def compact_changes(changes: DataFrame) -> DataFrame:
    """Of each note's changes its last deletion, and the first and the last put after it: three rows at most.

    What apply_note_changes() makes of them is what it makes of all. changes: doc_id, note_id, op, ts, seq, text.
    """
    at = F.struct("ts", "seq")
    gone = F.max(F.when(F.col("op") == "delete", at)).over(Window.partitionBy("doc_id", "note_id"))
    live = changes.withColumn("_at", at).withColumn("_gone", gone).where("_gone IS NULL OR _at >= _gone")
    row = F.struct("op", "ts", "seq", "text")
    put = F.when((F.col("op") == "put") & (F.col("_gone").isNull() | (F.col("_at") > F.col("_gone"))), row)
    kept = live.groupBy("doc_id", "note_id").agg(
        F.max_by(F.when(F.col("op") == "delete", row), F.when(F.col("op") == "delete", F.col("_at"))).alias("d"),
        F.min_by(put, F.when(put.isNotNull(), F.col("_at"))).alias("f"), F.max_by(put, F.when(put.isNotNull(), F.col("_at"))).alias("l"),
    )
    rows = F.array_distinct(F.filter(F.array("d", "f", "l"), lambda x: x.isNotNull()))
    return kept.select("doc_id", "note_id", F.explode(rows).alias("x")).select("doc_id", "note_id", "x.*")


def upsert_notes(changes: DataFrame, path: str, checkpoint: str, keep: int = 3, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the note changes that still matter as a table at path: buckets of notes, in versions.

    A batch is merged with the newest version of the buckets that its notes fall into, and these are written again; other buckets
    are not read. Of a note at most three rows stay (compact_changes), so the table follows the notes and not their history. Changes of a
    note may come again, and puts late; a deletion that comes later than puts made after it sees only the puts that stayed. A batch
    that is run again writes its own version again; `keep` old versions of a bucket stay for readers that have begun.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mine = batch.withColumn("b", F.pmod(F.xxhash64("doc_id", "note_id"), F.lit(buckets)).cast("int"))
        touched = {r.b for r in mine.select("b").distinct().collect()}  # as many as there are buckets, at most
        if not touched:
            return
        held = {b: [v for v in versions if v[0] < number] for b, versions in _held(spark, path).items()}
        older = [held[b][-1][1] for b in touched if held.get(b)]
        every = mine.drop("b")
        if older:
            every = every.unionByName(spark.read.schema(every.schema).parquet(*older))
        merged = compact_changes(every).withColumn("b", F.pmod(F.xxhash64("doc_id", "note_id"), F.lit(buckets)).cast("int"))
        merged.repartition("b").write.mode("overwrite").partitionBy("b").parquet(f"{path}/v={number}")
        fs = spark._jvm.org.apache.hadoop.fs
        for b in touched:
            for _, place in held.get(b, [])[:-keep]:
                at = fs.Path(place)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def opened(events: DataFrame) -> DataFrame:
    """doc_id, opened: the last opening of each document, for update mode."""
    return events.where("event = 'opened'").groupBy("doc_id").agg(F.max("ts").alias("opened"))


def job_status(progress: DataFrame, lines: int = 40) -> DataFrame:
    """job_id, stage, done, total, status, log: the last state of each job and its last lines.

    progress: job_id, seq, stage, done, total, status, line. A stopped job stays stopped. The log keeps the newest lines,
    which is what a status shows.
    """
    newest = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("seq")))
    log = progress.select("job_id", "seq", "line", newest.alias("k")).where(F.col("k") <= lines)
    log = log.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).getField("line").alias("log"))
    made = progress.groupBy("job_id").agg(
        F.max_by(F.struct("stage", "done", "total", "status"), "seq").alias("x"), F.max((F.col("status") == "stopped").cast("int")).alias("ended")
    )
    status = F.when(F.col("ended") == 1, "stopped").otherwise(F.col("x.status"))
    return made.join(log, "job_id").select("job_id", "x.stage", "x.done", "x.total", status.alias("status"), "log")


def activity(events: DataFrame, late: str = "1 day") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts by day, by sliding seven days, and by reader's session of 30 minutes; late rows beyond the watermark are dropped.

    events: ts timestamp, user_id.
    """
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    count = F.count(F.lit(1)).alias("n")
    span = lambda w: [F.col(f"{w}.start").alias("start"), F.col(f"{w}.end").alias("end")]
    day = timed.groupBy(F.window("ts", "1 day").alias("w")).agg(count).select(*span("w"), "n")
    week = timed.groupBy(F.window("ts", "7 days", "1 day").alias("w")).agg(count).select(*span("w"), "n")
    session = timed.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(count).select("user_id", *span("w"), "n")
    return day, week, session


def run_to_table(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append", then: Callable | None = None) -> StreamingQuery:
    """Run a stream over what is there and stop: append to Parquet, or hand each batch to `then`."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(then).start() if then else writer.format("parquet").option("path", sink).start()
