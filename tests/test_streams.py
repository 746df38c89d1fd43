"""Streams with keyed state: notes in buckets, jobs with their newest lines."""

from __future__ import annotations

import os
import random
from datetime import timedelta

from pyspark.sql import functions as F

from lectern.operators import notes
from lectern.streaming import jobs, streams

CHANGES = "doc_id long, note_id string, op string, ts timestamp, seq long, text string"


def changes(spark, rows):
    made = spark.createDataFrame(rows, "doc_id long, note_id string, op string, t long, text string")
    return made.select("doc_id", "note_id", "op", F.timestamp_seconds("t").alias("ts"), F.col("t").alias("seq"), "text")


def test_notes_in_buckets_equal_all_changes(spark, tmp_path):
    rng = random.Random(2)
    rows = [(1, f"n-{rng.randint(0, 30)}", rng.choice(["put", "put", "put", "delete"]), t, f"text {t}") for t in range(400)]
    rows += [(2, "n-live", "put", 1000 + t, f"put {t}") for t in range(3000)]
    every = changes(spark, rows)
    source, where = str(tmp_path / "in"), str(tmp_path / "notes")
    os.makedirs(source)
    stream = spark.readStream.schema(CHANGES).parquet(source)
    for k in range(4):  # batches in order; each brings some of the one before again
        every.where(F.col("seq").between(1000 * k - 100, 1000 * k + 999)).coalesce(1).write.mode("append").parquet(source)
        streams.upsert_notes(stream, where, str(tmp_path / "ck")).awaitTermination()
    want = {tuple(r) for r in notes.apply_note_changes(every).collect()}
    assert {tuple(r) for r in streams.current_notes(spark, where).collect()} == want and len(want) > 10
    held = streams._held(spark, where)
    rows_of = spark.read.parquet(*[v[-1][1] for v in held.values()]).groupBy("doc_id", "note_id").count()
    assert rows_of.agg(F.max("count")).first()[0] <= 3 and rows_of.where("note_id = 'n-live'").first()["count"] == 2
    # A batch of one note writes one bucket, and old versions go.
    newest = max(v for versions in held.values() for v, _ in versions)
    assert [b for b, versions in held.items() if versions[-1][0] == newest] == [b for b in held if os.path.isdir(f"{where}/v={newest}/b={b}")]
    assert sum(os.path.isdir(f"{where}/v={newest}/b={b}") for b in range(streams.BUCKETS)) == 1
    assert all(len(versions) <= 4 for versions in held.values())


def test_compacted_changes_say_the_same(spark):
    rng = random.Random(7)
    rows = [(d, f"n-{rng.randint(0, 5)}", rng.choice(["put", "put", "delete"]), t, str(t)) for d in range(20) for t in range(rng.randint(1, 25))]
    every = changes(spark, rows + rows[:30])
    few = streams.compact_changes(every)
    assert {tuple(r) for r in notes.apply_note_changes(few).collect()} == {tuple(r) for r in notes.apply_note_changes(every).collect()}
    assert few.groupBy("doc_id", "note_id").count().agg(F.max("count")).first()[0] <= 3


PROGRESS = "job_id long, seq long, stage string, done long, total long, status string, line string"


def test_job_state_equals_the_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(j, s, rng.choice("abc"), s, 200, "stopped" if j == 2 and s == 30 else "running", f"{j}/{s}" if s % 7 else None) for j in range(4) for s in range(120)]
    late = rng.sample(rows, len(rows))
    batches = [late[:150], late[100:300], late[300:], late[:50]]
    source, said = str(tmp_path / "in"), {}
    os.makedirs(source)
    stream = spark.readStream.schema(PROGRESS).parquet(source)

    def keep(batch, number):
        said.update({r.job_id: r for r in batch.collect()})

    for rows_ in batches:
        spark.createDataFrame(rows_, PROGRESS).coalesce(1).write.mode("append").parquet(source)
        jobs.run_jobs(jobs.job_stream(stream), str(tmp_path / "ck"), keep).awaitTermination()
    want = {r.job_id: r for r in streams.job_status(spark.createDataFrame(rows, PROGRESS)).collect()}
    for j, r in want.items():
        assert (said[j].stage, said[j].done, said[j].total, said[j].status) == (r.stage, r.done, r.total, r.status)
        assert list(said[j].log) == [line for line in r.log if line is not None]
    assert said[2].status == "stopped" and all(spark.conf.get(k, None) != v for k, v in jobs.SETTINGS.items())


def test_a_stopped_job_ends(spark, tmp_path):
    source, said = str(tmp_path / "in"), []
    os.makedirs(source)
    stream = spark.readStream.schema(PROGRESS).parquet(source)
    for row in [(1, 5, "a", 1, 2, "stopped", "first"), (2, 1, "a", 1, 2, "running", "x"), (1, 6, "b", 1, 2, "running", "anew")]:
        spark.createDataFrame([row], PROGRESS).coalesce(1).write.mode("append").parquet(source)
        jobs.run_jobs(jobs.job_stream(stream, keep=timedelta(0)), str(tmp_path / "ck"), lambda b, n: said.extend(tuple(r) for r in b.collect())).awaitTermination()
    assert said[-1] == (1, "b", 1, 2, "running", ["anew"])  # its state was cleared when the second batch came
