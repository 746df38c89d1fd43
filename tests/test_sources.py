"""Delimited text against Python's csv, and packed folders of texts."""

from __future__ import annotations

import csv
import glob
import io
import json
import random

from pyspark.sql import functions as F

from lectern.plans import QUERIES
from lectern.sources import readers, sinks


def test_cells_equal_pythons_csv(spark):
    rng = random.Random(11)
    texts = []
    for k in range(1000):
        sep = ",;\t|"[k % 4]
        texts.append((k, sep, "".join(rng.choice([sep, '"', '""', "\n", "\r\n", "a", "b c", "é", " ", "\x1e", "\x1d1", ",;"[k % 2]]) for _ in range(rng.randint(0, 25)))))
    texts += [(2000, ",", 'a,"x\ny, z",b\n"q ""r"" s",,\n'), (2001, ",", '"open, never\nclosed'), (2002, ",", '"' + "long\n" * 20_000 + '",end'), (2003, ";", "")]
    made = spark.createDataFrame(texts, "k long, sep string, text string").select("k", readers.delimited_cells(F.col("text"), F.col("sep")).alias("rows"))
    got = {r.k: [row for row in r.rows if row != [""]] for r in made.collect()}
    for k, sep, text in texts:
        want = [row for row in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if row not in ([], [""])]
        assert got[k] == want, text


def test_rows_of_delimited_texts(spark):
    text = 'name;"note\nof it";n\n\nA;"x; y";3.0\n;;\nB;2024-01-02 00:00;\n'
    many = "h\n" + "\n".join(map(str, range(12)))
    made = readers.read_sniffed_csv(spark.createDataFrame([(1, text), (2, many), (3, ""), (4, None)], "id long, text string"), "id", max_rows=10)
    rows = {}
    for r in made.orderBy("id", "row").collect():
        rows.setdefault(r.id, []).append(r.cells)
    assert rows[1] == [["name", "note\nof it", "n"], ["A", "x; y", "3"], ["B", "2024-01-02"]]
    assert rows[2] == [["h"], *[[str(k)] for k in range(10)], ["…"]] and set(rows) == {1, 2}


def test_packed_texts_are_read_from_their_place(spark, tmp_path):
    where = str(tmp_path / "packed")
    texts = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text é\n"), F.repeat(F.lit("日本 "), (F.col("id") % 7).cast("int")), "id").alias("text"))
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "twice"), (-3, "twice"), (-4, "x" * 100_000)], "doc_id long, text string")
    sinks.write_packed(texts.unionByName(odd), where, shard_bytes=200_000)
    files = glob.glob(f"{where}/texts/shard=*/part-*")
    assert 3 <= len(files) <= 8
    for k in (0, 1, 17, 19_999):
        assert sinks.read_packed(spark, where, k) == ["text é\n" + "日本 " * (k % 7) + str(k)]
    assert [sinks.read_packed(spark, where, k) for k in (-1, -2, -3, -4, -5)] == [[""], [""], ["twice", "twice"], ["x" * 100_000], []]
    index = spark.read.parquet(f"{where}/index")
    assert index.count() == 20_005
    ends = index.groupBy("file").agg(F.sum(F.col("size") + 1).alias("n")).collect()
    import os

    assert all(os.path.getsize(r.file.replace("file:", "")) == r.n for r in ends)
    sinks.write_packed(odd.where("false"), str(tmp_path / "none"))
    assert sinks.read_packed(spark, str(tmp_path / "none"), 1) == []


def test_a_whole_negative_zero_is_zero(spark):
    texts = spark.createDataFrame([(1, "n;v\na;-0.00\nb;-0.50\nc;-10.0\nd;0.0\ne;-0\n")], "doc_id long, text string")
    cells = {r.cells[0]: r.cells[1] for r in readers.read_sniffed_csv(texts, "doc_id").collect()}
    assert cells == {"n": "v", "a": "0", "b": "-0.50", "c": "-10", "d": "0", "e": "-0"}


def test_a_packed_folder_is_unpacked_whole(spark, tmp_path):
    rows = [(k, f"é{k}\r\n\n" * (k % 4) + "x" * (k % 3)) for k in range(300)] + [(7, "again"), (7, "again"), (900, None), (901, "\n")]
    sinks.write_packed(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "p"), shard_bytes=500)
    got = sorted((r.doc_id, r.text) for r in sinks.unpack(spark, str(tmp_path / "p")).collect())
    assert got == sorted((k, text or "") for k, text in rows)
    assert all(r.size == len(r.text.encode()) for r in sinks.unpack(spark, str(tmp_path / "p")).collect())


def test_notes_of_many_documents_lie_in_one_file(spark, tmp_path):
    """Each user was a folder with a file: what the driver does for files grew with the users."""
    (tmp_path / "1.json").write_text(json.dumps([{"format": f, "version": 1, "paper": {"id": d}, "notes": [{"id": f"n-{d}", "text": "a\nb"}]} for d, f in (("d1", "f"), ("d2", "g"), ("d3", "f"))]))
    (tmp_path / "2.json").write_text(json.dumps({"format": "f", "version": 1, "paper": {"id": "d4"}, "notes": [{"id": "n-d4"}]}))
    (tmp_path / "3.json").write_text('[{"format": "f", "paper": {"id": "d5"')
    assert sorted(r.note_id for r in readers.read_notes(spark, str(tmp_path), ["f"]).collect()) == ["n-d1", "n-d3", "n-d4"]
    (tmp_path / "t").mkdir()
    users = spark.range(1000).select(F.col("id").alias("event_id"), F.col("id").alias("user_id"), F.lit("view").alias("event_type"))
    users.write.parquet(str(tmp_path / "t" / "events.parquet"))
    made = QUERIES["s5_read_notes"](spark, str(tmp_path / "t"))
    assert made.count() == 900 and len(made.inputFiles()) == 5
