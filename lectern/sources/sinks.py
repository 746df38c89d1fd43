"""Sinks: documents as JSON and Markdown, notes as Markdown, versioned layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.fold import document_at
from ..operators.library import latest_layers
from .tables import drop_settled, settle


def doc_json(levels: DataFrame, docs: DataFrame, edges: DataFrame | None = None, model: str = "") -> DataFrame:
    """doc_id, json: sections, units, five levels, where they came from, and unit-to-unit links.

    levels: doc_id, section_id, pos, full, brief, key, takeaway, topic; docs: doc_id, title, lang; edges: doc_id, f, t, tk, rel.
    """
    unit = F.struct("pos", F.concat(F.lit("u"), "pos").alias("id"), "full", "brief", "key", "takeaway", "topic")
    units = levels.groupBy("doc_id", "section_id").agg(F.array_sort(F.collect_list(unit)).alias("units"), F.min("pos").alias("first"))
    sections = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", F.col("section_id").alias("id"), "units"))).alias("sections"))
    out = docs.select("doc_id", "title", "lang").join(sections, "doc_id")
    if edges is not None:
        mine = edges.where("tk = 'unit'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("f").alias("from"), F.col("t").alias("to"), "rel"))).alias("links"))
        out = out.join(mine, "doc_id", "left")
    else:
        out = out.withColumn("links", F.lit(None).cast("array<struct<from:string,to:string,rel:string>>"))
    shown = F.transform("sections", lambda s: F.struct(s["id"].alias("id"), F.transform(s["units"], lambda u: u.dropFields("pos")).alias("units")))
    source = F.struct(F.lit(bool(model)).alias("ai_generated"), F.lit(not model).alias("local"), F.lit(model).alias("model"))
    none = F.array().cast("array<struct<from:string,to:string,rel:string>>")
    body = F.struct(F.col("doc_id").cast("string").alias("id"), "lang", "title", source.alias("provenance"), shown.alias("sections"), F.coalesce("links", none).alias("links"))
    return out.select("doc_id", F.to_json(body).alias("json"))


def write_doc_json(levels: DataFrame, docs: DataFrame, path: str, **how) -> None:
    doc_json(levels, docs, **how).select("json").write.mode("append").text(path)


#: Bytes of texts that one file of a packed folder aims at.
SHARD_BYTES = 128_000_000


def write_packed(texts: DataFrame, path: str, shard_bytes: int = SHARD_BYTES) -> None:
    """Texts (doc_id, text) end to end in files of about shard_bytes, and where each one lies.

    path/texts holds one file for each shard, a line end behind every text; path/index is a table of doc_id, file, offset and size in
    bytes. The number of files follows the bytes, not the texts. Null texts are empty; repeated rows are written as often.
    """
    spark = texts.sparkSession
    # The texts are read for their sum, their files and their places: what makes them runs once.
    given = settle(texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    total = given.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))
    dealt = given.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    dealt.repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "text").drop("doc_id").write.partitionBy("shard").text(f"{path}/texts")
    fs = spark._jvm.org.apache.hadoop.fs
    files = fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(int(x.getPath().getParent().getName()[6:]), str(x.getPath())) for x in files.globStatus(fs.Path(f"{path}/texts/shard=*/part-*")) or []]
    before = Window.partitionBy("shard").orderBy("doc_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("text").cast("long")
    placed = dealt.select("doc_id", "shard", size.alias("size"), F.coalesce(F.sum(size + 1).over(before), F.lit(0)).alias("offset"))
    named = placed.join(F.broadcast(spark.createDataFrame(found, "shard int, file string")), "shard") if found else placed.withColumn("file", F.lit(""))
    named.select("doc_id", "file", "offset", "size").write.parquet(f"{path}/index")
    drop_settled(given)


def unpack(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, offset, size, text of every text of a packed folder, put together from the lines that lie from its place on.

    Files are read line by line, so that no row holds a file: cut out of a row with the whole file, each text would copy it all.
    """
    shard = F.regexp_extract("file", r"shard=(\d+)/", 1).cast("int").alias("shard")
    places = spark.read.parquet(f"{path}/index").select(shard, F.col("offset").alias("at"), F.struct("doc_id", "offset", "size").alias("place"))
    # The order of lines inside a file: that of its splits, then that of their rows.
    order = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("k")).alias("k")
    read = spark.read.schema("value string, shard int").option("lineSep", "\n").text(f"{path}/texts").select("shard", order, "value")
    before = Window.partitionBy("shard").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    lines = read.select("shard", F.coalesce(F.sum(F.octet_length("value") + 1).over(before), F.lit(0)).alias("at"), "value")
    upto = Window.partitionBy("shard").orderBy("at", F.col("place").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    laid = lines.unionByName(places, allowMissingColumns=True).withColumn("of", F.last("place", ignorenulls=True).over(upto)).where("place IS NULL")
    whole = F.array_join(F.array_sort(F.collect_list(F.struct("at", "value"))).getField("value"), "\n")
    return laid.groupBy("shard", "of").agg(whole.alias("text")).select("of.doc_id", "of.offset", "of.size", "text")


def read_packed(spark: SparkSession, path: str, doc_id: int) -> list[str]:
    """The texts of one document of a packed folder, each read from its place alone."""
    fs = spark._jvm.org.apache.hadoop.fs
    out = []
    for r in spark.read.parquet(f"{path}/index").where(F.col("doc_id") == doc_id).orderBy("offset").collect():
        place = fs.Path(r.file)
        stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
        try:
            stream.seek(r.offset)
            out.append(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, r.size)).decode("utf-8"))
        finally:
            stream.close()
    return out


def write_markdown(levels: DataFrame, level: str, path: str) -> None:
    """Each document at a level as one text, packed (see write_packed)."""
    write_packed(document_at(levels, level), path)


def file_name(title: Column) -> Column:
    r"""A title as a file's name: without \/:*?"<>| and 90 characters at most."""
    return F.substring(F.trim(F.regexp_replace(title, r'[\\/:*?"<>|]+', " ")), 1, 90)


def notes_markdown(notes: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, file, text: a document's notes in order: head block, quotes, own words, questions with their answers' lines, a link back.

    notes: doc_id, note_id, created, text, thread, quote, pos; docs: doc_id, title.
    """
    turns = F.array_join(F.transform("thread", lambda x: F.concat(F.lit("**Q:** "), x["q"], F.lit("\n\n"), x["takeaway"])), "\n\n")
    entry = F.concat_ws("\n\n", F.concat(F.lit("> "), "quote"), F.nullif(F.coalesce("text", F.lit("")), F.lit("")), F.nullif(turns, F.lit("")), F.concat(F.lit("[back](#u"), "pos", F.lit(")")))
    made = notes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "created", "note_id", entry.alias("e")))).alias("x"))
    head = F.concat(F.lit("---\ntitle: "), "title", F.lit("\n---\n\n"))
    return made.join(docs.select("doc_id", "title"), "doc_id").select("doc_id", file_name(F.col("title")).alias("file"), F.concat(head, F.array_join("x.e", "\n\n")).alias("text"))


def write_notes_markdown(notes: DataFrame, docs: DataFrame, path: str) -> None:
    """Each document's notes as one text, packed (see write_packed)."""
    write_packed(notes_markdown(notes, docs), path)


def save_layer(ladders: DataFrame, path: str) -> None:
    """Append a layer: rows carry doc_id, lang, version; readers take the newest of each."""
    ladders.write.mode("append").partitionBy("lang").parquet(path)


def read_layers(layers: DataFrame, local: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, pos, key, takeaway, topic, model: the newest layer's lines for each unit, the extractive ones where it has none.

    layers: doc_id, lang, version, pos, key, takeaway, topic, model; local: fold_local(); wanted: doc_id and the one lang in which
    it is read, such as its own or that of a translation. Layers in other languages are left alone.
    """
    asked = layers.join(wanted.select("doc_id", "lang"), ["doc_id", "lang"], "left_semi")
    newest = latest_layers(asked.select("doc_id", "lang", "version").distinct())
    mine = asked.join(newest, ["doc_id", "lang", "version"], "left_semi")
    cols = ["key", "takeaway", "topic", "model"]
    ours = mine.select("doc_id", "pos", *[F.col(c).alias(f"_{c}") for c in cols])
    return local.select("doc_id", "pos", *cols).join(ours, ["doc_id", "pos"], "left").select("doc_id", "pos", *[F.coalesce(f"_{c}", c).alias(c) for c in cols])
