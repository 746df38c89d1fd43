"""Queries: sinks, layers, structure and streams over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cjk, fold, segment, structure
from ..sources import readers, sinks
from ..sources.tables import shared_dir
from ..streaming import jobs, streams
from . import derived as d
from . import sql
from .registry import Tables, query


def _folder(spark: SparkSession) -> str:
    """A new folder where the cluster shares files."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _stream(t: Tables, table: str) -> DataFrame:
    """A given table as a stream; the pattern makes a file count as a folder's content."""
    return readers.stream_docs(t.spark, f"{t.sf_dir}/{table}.parque[t]", t.spark.read.parquet(f"{t.sf_dir}/{table}.parquet").schema)


# --- Sinks and layers -----------------------------------------------------------------------------------------------


@query(f"""WITH {sql.FOLD} SELECT f.doc_id, count(*) AS units, count(DISTINCT f.pos // 5) AS sections FROM fold f GROUP BY 1""")
def s9_doc_json(t: Tables) -> DataFrame:
    """Documents as JSON, read back: their units and sections."""
    made = sinks.doc_json(fold.local_levels(d.units(t)), d.titles(t))
    v = F.from_json("json", "sections array<struct<id:string,units:array<struct<id:string>>>>")
    units = F.aggregate(v["sections"], F.lit(0), lambda a, s: a + F.size(s["units"]))
    return made.select("doc_id", units.cast("long").alias("units"), F.size(v["sections"]).cast("long").alias("sections"))


@query(f"""WITH {sql.FOLD}, {d.TITLES}, s AS (SELECT doc_id, pos, string_agg(text, ' ' ORDER BY sent) AS whole, min(text) FILTER (sent = 0) AS first FROM sents GROUP BY ALL),
u AS (SELECT u.doc_id, u.pos, {{'id': 'u' || u.pos, 'full': coalesce(whole, ''), 'brief': CASE WHEN first IS NULL THEN []::VARCHAR[] ELSE [first] END, 'key': coalesce(key, ''), 'takeaway': coalesce(takeaway, ''), 'topic': coalesce(topic, '')}} AS x
  FROM units u LEFT JOIN s ON s.doc_id = u.doc_id AND s.pos = u.pos LEFT JOIN fold f ON f.doc_id = u.doc_id AND f.pos = u.pos),
c AS (SELECT doc_id, min(pos) AS p, {{'id': 's' || pos // 5, 'units': list(x ORDER BY pos)}} AS x FROM u GROUP BY doc_id, pos // 5),
a AS (SELECT doc_id, list(x ORDER BY p) AS sections FROM c GROUP BY 1)
SELECT doc_id, CAST(to_json({{'id': doc_id::VARCHAR, 'lang': lang, 'title': title, 'provenance': {{'ai_generated': false, 'local': true, 'model': ''}}, 'sections': sections, 'links': []::VARCHAR[]}}) AS VARCHAR) AS json FROM a JOIN titles USING (doc_id)""")
def s9_doc_json_text(t: Tables) -> DataFrame:
    return sinks.doc_json(fold.local_levels(d.units(t)), d.titles(t))


@query(f"""WITH {d.NOTES}, {d.TITLES}, e AS (SELECT doc_id, note_id, created, pos, '> ' || quote || coalesce(chr(10) || chr(10) || text, '') ||
 coalesce(chr(10) || chr(10) || '**Q:** ' || question || chr(10) || chr(10) || 'because', '') || chr(10) || chr(10) || '[back](#u' || pos || ')' AS e FROM notes)
SELECT e.doc_id, '---' || chr(10) || 'title: ' || any_value(title) || chr(10) || '---' || chr(10) || chr(10) || string_agg(e, chr(10) || chr(10) ORDER BY pos, created, note_id) AS text
FROM e JOIN titles USING (doc_id) GROUP BY e.doc_id""")
def s11_notes_markdown(t: Tables) -> DataFrame:
    return sinks.notes_markdown(d.notes(t), d.titles(t)).select("doc_id", "text")


@query(f"""WITH {sql.FOLD} SELECT doc_id, pos, CASE WHEN doc_id % 3 = 0 AND pos % 2 = 0 THEN 'two ' || takeaway WHEN doc_id % 3 <> 0 AND pos % 4 = 0 THEN 'one ' || takeaway ELSE takeaway END AS takeaway,
CASE WHEN doc_id % 3 = 0 AND pos % 2 = 0 OR doc_id % 3 <> 0 AND pos % 4 = 0 THEN 'model' ELSE 'local' END AS model FROM fold""")
def s12_read_layers(t: Tables) -> DataFrame:
    """Two versions of a layer in the document's language; units that the newest lacks fall back to their extractive fold.

    A newer layer in another language changes nothing.
    """
    local = fold.fold_local(d.units(t))
    own = t.documents.select("doc_id", "lang")
    base = local.select("doc_id", "pos", "key", "takeaway", "topic", F.lit("model").alias("model")).join(own, "doc_id")
    other = base.withColumns({"lang": F.concat("lang", F.lit("-x")), "version": F.lit(9), "takeaway": F.lit("other")})
    one = base.where("pos % 4 = 0").withColumns({"version": F.lit(1), "takeaway": F.concat(F.lit("one "), "takeaway")})
    two = base.where("doc_id % 3 = 0 AND pos % 2 = 0").withColumns({"version": F.lit(2), "takeaway": F.concat(F.lit("two "), "takeaway")})
    return sinks.read_layers(one.unionByName(two).unionByName(other), local, own).select("doc_id", "pos", "takeaway", "model")


@query("""SELECT c_custkey AS doc_id, CAST(k AS INTEGER) AS row, CASE k WHEN 0 THEN 'name|balance' ELSE c_name || '|' || CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) ELSE CAST(c_acctbal AS DECIMAL(18, 2))::VARCHAR END END AS cells
FROM customer, (SELECT unnest([0, 1]) AS k)""")
def s3_sniffed_csv(t: Tables) -> DataFrame:
    """A small delimited text for each customer, with a separator by its key."""
    sep = F.element_at(F.array(*[F.lit(s) for s in ",;\t|"]), (F.col("c_custkey") % 4 + 1).cast("int"))
    line = F.concat_ws("", F.lit("name"), sep, F.lit("balance"), sep, F.lit("\n\n"), "c_name", sep, F.format_string("%.2f", F.col("c_acctbal").cast("double")), F.lit("\n"))
    made = readers.read_sniffed_csv(t.customer.select(F.col("c_custkey").alias("doc_id"), line.alias("text")), "doc_id")
    return made.select("doc_id", "row", F.array_join("cells", "|").alias("cells"))


# --- Structure ------------------------------------------------------------------------------------------------------


def _page_blocks(t: Tables) -> DataFrame:
    """Pages of five lines, each headed by its source and page, and ended by the page number alone."""
    u = d.units(t).select("doc_id", F.floor(F.col("pos") / 5).cast("int").alias("page"), (F.col("pos") % 5 + 1).alias("block"), "text")
    pages = u.select("doc_id", "page").distinct().join(t.documents.select("doc_id", "source"), "doc_id")
    head = pages.select("doc_id", "page", F.lit(0).alias("block"), F.format_string("Source %s %d", "source", "page").alias("text"))
    foot = pages.select("doc_id", "page", F.lit(9).alias("block"), F.col("page").cast("string").alias("text"))
    return u.unionByName(head).unionByName(foot)


@query(f"""WITH {sql.UNITS}, p AS (SELECT doc_id, count(DISTINCT pos // 5) AS n FROM units GROUP BY 1)
SELECT doc_id, CAST(pos // 5 AS INTEGER) AS page, CAST(pos % 5 + 1 AS INTEGER) AS block, text FROM units WHERE NOT regexp_matches(text, '^\\s*[-–]?\\s*\\d+\\s*[-–]?\\s*$')
UNION ALL SELECT DISTINCT doc_id, CAST(pos // 5 AS INTEGER), 0, 'Source ' || source || ' ' || pos // 5 FROM units JOIN p USING (doc_id) JOIN documents USING (doc_id) WHERE n < 3""")
def t14_running_heads(t: Tables) -> DataFrame:
    return structure.drop_running_heads(_page_blocks(t))


def _blocks(t: Tables) -> DataFrame:
    """Lines as blocks, every tenth a heading of the second level and the fifth after it one of the third."""
    u = d.units(t)
    head = F.col("pos") % 5 == 0
    level = F.when(head, F.when(F.col("pos") % 10 == 0, 2).otherwise(3)).alias("level")
    text = F.when(head, F.concat(F.lit("Part "), "pos")).otherwise(F.col("text")).alias("text")
    return u.select("doc_id", "pos", F.when(head, "heading").otherwise("paragraph").alias("kind"), level, text)


@query(f"""WITH {sql.UNITS}, top AS (SELECT doc_id, min(CASE WHEN pos % 10 = 0 THEN 2 WHEN pos % 5 = 0 THEN 3 END) AS top, min(pos) AS first, max(pos) AS last FROM units GROUP BY 1),
h AS (SELECT doc_id, pos, 'part-' || pos AS section_id, 'Part ' || pos AS title, CASE WHEN pos % 10 = 0 THEN 2 ELSE 3 END - top + 1 AS level, last FROM units JOIN top USING (doc_id) WHERE pos % 5 = 0
  UNION ALL SELECT doc_id, first, 'abstract', '', 1, last FROM top WHERE first % 5 <> 0)
SELECT doc_id, section_id, title, CAST(level AS INTEGER) AS level, CASE WHEN level > 1 THEN arg_max(CASE WHEN level = 1 THEN section_id END, CASE WHEN level = 1 THEN pos END) OVER w END AS parent, pos,
  CAST(coalesce(lead(pos) OVER w, last + 1) AS INTEGER) AS "end" FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""")
def t8_sections(t: Tables) -> DataFrame:
    return structure.sections(_blocks(t)).select("doc_id", "section_id", "title", "level", "parent", "pos", "end")


@query(f"WITH {sql.UNITS} SELECT doc_id, pos, 'u' || row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS unit_id FROM units WHERE pos % 5 <> 0".replace("'u' || row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1", "'u' || (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)"))
def t9_units(t: Tables) -> DataFrame:
    b = _blocks(t)
    return structure.units(b, structure.sections(b)).select("doc_id", "pos", "unit_id")


@query(f"""WITH {sql.UNITS} SELECT doc_id, 'a' || row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS atom_id, pos, 'cite' AS kind, '[' || pos || ']' AS alt FROM units WHERE pos % 3 = 0""")
def t19_atoms(t: Tables) -> DataFrame:
    """A citation put behind every third line."""
    u = d.units(t).withColumn("text", F.when(F.col("pos") % 3 == 0, F.concat(F.lit("Said ["), F.col("pos").cast("string"), F.lit("].")))
                              .otherwise(F.regexp_replace("text", r"[\[\]$(]", "")))
    return structure.atoms(u)


@query(rf"""WITH {sql.FOLD}, w AS (SELECT c.doc_id, c.pos, CAST(tok AS INTEGER) AS tok, regexp_replace(lower(t), '[^\p{{L}}\p{{N}}_\p{{M}}]', '', 'g') AS w FROM counted c JOIN heads h ON h.doc_id = c.doc_id AND h.pos = c.pos WHERE tok <= coalesce(h14, hn))
SELECT doc_id, pos, tok AS line_tok, tok AS source_tok FROM w WHERE w <> '' AND w NOT IN ({sql.quoted(T.STOP_WORDS)})""")
def f5_align_words(t: Tables) -> DataFrame:
    """Takeaways begin as their sentences do, so each word but stop words is its own source."""
    made = fold.fold_local(d.units(t)).select("doc_id", "pos", F.col("takeaway").alias("line"), F.col("key").alias("source"))
    return structure.align_words(made)


_SECTION_LINE = "第三方支付应当统一监管并且立法规制"


@query(f"""WITH {sql.UNITS}, x AS (SELECT doc_id, pos, pos // 8 AS sec, pos % 8 AS k, doc_id % 2 = 0 AS zh FROM units),
f AS (SELECT *, pos = min(pos) OVER (PARTITION BY doc_id, sec) AS first FROM x),
g AS (SELECT *, sum(CASE WHEN k <> 5 AND (first OR k IN (0, 3)) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sec ORDER BY pos) AS g FROM f),
r AS (SELECT *, sum(CASE WHEN k IN (1, 2, 4, 6, 7) AND NOT first THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sec, g ORDER BY pos) AS run FROM g)
SELECT doc_id, pos, NOT zh OR k <> 5 AND (first OR k IN (0, 3) OR run <= 2 AND k <> 2) AS shown FROM r""")
def f8_background_run(t: Tables) -> DataFrame:
    """Lines of which every second document's are Chinese: claims, background, a cited title, one with a colon, the section's own line.

    Of English documents every line stands.
    """
    k, zh = F.col("pos") % 8, F.col("doc_id") % 2 == 0
    said = (
        F.when(k.isin(0, 3), "本文认为应当立法").when(k == 2, "《支付办法》规定甲乙").when(k == 4, "《资本要求》：若干条件").when(k == 5, _SECTION_LINE + "。")
        .otherwise("甲乙丙丁戊己庚")
    )
    text = F.when(zh, said).otherwise(F.when(k == 5, "The section says this once more.").otherwise(F.col("text")))
    u = d.units(t).withColumn("text", text)
    line = F.when(zh, _SECTION_LINE).otherwise("The section says this once more.")
    section = F.concat(F.lit("s"), F.floor(F.col("pos") / 8))
    lines = u.select("doc_id", section.alias("section_id"), "pos", F.when(k.isin(0, 3, 5), "claim").otherwise("context").alias("role"), F.col("text").alias("takeaway"), line.alias("section_line"))
    return cjk.step_down_background(lines, segment.document_cjk_share(u)).select("doc_id", "pos", "shown")


# --- Streams --------------------------------------------------------------------------------------------------------


@query(f"WITH {sql.FOLD} SELECT doc_id, pos, takeaway FROM fold")
def w1_fold_stream(t: Tables) -> DataFrame:
    """The documents as a stream, folded and appended, equals the batch."""
    where = _folder(t.spark)
    docs = _stream(t, "documents").withColumn("ts", F.to_timestamp(F.lit("2024-01-01")))
    streams.run_to_table(streams.fold_stream(docs), f"{where}/out", f"{where}/ck").awaitTermination()
    return t.spark.read.parquet(f"{where}/out").select("doc_id", "pos", "takeaway")


@query("""SELECT note_id, CASE WHEN event_type = 'view' THEN 'seen' ELSE 'put' END AS text FROM (SELECT 'n-' || user_id AS note_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS event_type FROM events GROUP BY 1) WHERE event_type <> 'error'""")
def w2_note_stream(t: Tables) -> DataFrame:
    """Each user's events as changes of one note: errors delete it, others put it."""
    where = _folder(t.spark)
    op = F.when(F.col("event_type") == "error", "delete").otherwise("put")
    changes = _stream(t, "events").select(
        F.lit(0).cast("long").alias("doc_id"), F.concat(F.lit("n-"), "user_id").alias("note_id"), op.alias("op"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "seen").otherwise("put").alias("text"),
    )
    streams.upsert_notes(changes, where, f"{where}/ck").awaitTermination()
    return streams.current_notes(t.spark, where).select("note_id", "text")


@query("SELECT event_id % 100 AS doc_id, max(ts) AS opened FROM events WHERE event_type = 'view' GROUP BY 1")
def w3_opened_stream(t: Tables) -> DataFrame:
    where = _folder(t.spark)
    events = _stream(t, "events").select((F.col("event_id") % 100).alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "view", "opened").alias("event"))

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/now")

    streams.run_to_table(streams.opened(events), "", f"{where}/ck", "complete", keep).awaitTermination()
    return t.spark.read.parquet(f"{where}/now").withColumn("opened", F.col("opened").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events)
SELECT user_id AS job_id, arg_max(event_type, event_id) AS stage, count(*) AS lines, CASE WHEN bool_or(event_type = 'error') THEN 'stopped' ELSE 'running' END AS status,
string_agg(event_type, ',' ORDER BY event_id) FILTER (k <= 40) AS log FROM e GROUP BY 1""")
def w4_job_status(t: Tables) -> DataFrame:
    """Each user's events as the progress of a job; an error stops it."""
    p = t.events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), F.lit(1).alias("done"), F.lit(1).alias("total"), F.when(F.col("event_type") == "error", "stopped").otherwise("running").alias("status"), F.col("event_type").alias("line"))
    n = p.groupBy("job_id").agg(F.count(F.lit(1)).alias("lines"))
    return streams.job_status(p).join(n, "job_id").select("job_id", "stage", "lines", "status", F.array_join("log", ",").alias("log"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events)
SELECT user_id AS job_id, arg_max(event_type, event_id) AS stage, CASE WHEN bool_or(event_type = 'error') THEN 'stopped' ELSE 'running' END AS status,
string_agg(event_type, ',' ORDER BY event_id) FILTER (k <= 40) AS log FROM e GROUP BY 1""")
def w4_job_stream(t: Tables) -> DataFrame:
    """The same jobs from a stream of four batches: split by event, a third of the rows twice, the latest rows first."""
    where = _folder(t.spark)
    progress = t.events.select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), F.lit(1).cast("long").alias("done"), F.lit(1).cast("long").alias("total"),
        F.when(F.col("event_type") == "error", "stopped").otherwise("running").alias("status"), F.col("event_type").alias("line"),
    )
    deal = F.col("seq") % 3
    for k, some in enumerate((deal == 2, deal == 0, deal == 2, deal == 1)):
        progress.where(some).coalesce(1).write.mode("append").parquet(f"{where}/in/{k}")
    stream = t.spark.readStream.schema(progress.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{where}/in")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{where}/out/v={number}")

    jobs.run_jobs(jobs.job_stream(stream), f"{where}/ck", keep).awaitTermination()
    said = t.spark.read.option("recursiveFileLookup", "true").parquet(f"{where}/out")
    last = said.groupBy("job_id").agg(F.max_by(F.struct("stage", "status", "log"), "batch").alias("x"))
    return last.select("job_id", "x.stage", "x.status", F.array_join("x.log", ",").alias("log"))


def _timed(t: Tables) -> DataFrame:
    return t.events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id")


def _local(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, (date_trunc('day', ts) + INTERVAL 1 DAY)::TIMESTAMP AS \"end\", count(*) AS n FROM events GROUP BY ALL")
def w5_activity_day(t: Tables) -> DataFrame:
    return _local(streams.activity(_timed(t))[0])


@query("""WITH e AS (SELECT date_trunc('day', ts)::TIMESTAMP AS d, unnest(range(0, 7)) AS k FROM events)
SELECT d - to_days(CAST(k AS INTEGER)) AS start, d - to_days(CAST(k AS INTEGER)) + INTERVAL 7 DAY AS "end", count(*) AS n FROM e GROUP BY ALL""")
def w5_activity_week(t: Tables) -> DataFrame:
    return _local(streams.activity(_timed(t))[1])


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def w5_activity_session(t: Tables) -> DataFrame:
    return _local(streams.activity(_timed(t))[2])


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS start, (date_trunc('day', ts) + INTERVAL 1 DAY)::TIMESTAMP AS "end", count(*) AS n FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY ALL""")
def w5_activity_stream(t: Tables) -> DataFrame:
    """The day counts from a stream: days beyond the watermark are complete and appended."""
    where = _folder(t.spark)
    events = _stream(t, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    streams.run_to_table(streams.activity(events)[0], f"{where}/out", f"{where}/ck").awaitTermination()
    return _local(t.spark.read.schema("start timestamp, end timestamp, n long").parquet(f"{where}/out"))


_COMPLETE = "(SELECT max(ts) - INTERVAL 1 DAY FROM events)"


@query(f"""WITH e AS (SELECT date_trunc('day', ts)::TIMESTAMP AS d, unnest(range(0, 7)) AS k FROM events),
g AS (SELECT d - to_days(CAST(k AS INTEGER)) AS start, d - to_days(CAST(k AS INTEGER)) + INTERVAL 7 DAY AS "end", count(*) AS n FROM e GROUP BY ALL)
SELECT * FROM g WHERE "end" <= {_COMPLETE}""")
def w5_week_stream(t: Tables) -> DataFrame:
    """Sliding weeks from a stream, complete ones."""
    where = _folder(t.spark)
    events = _stream(t, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    streams.run_to_table(streams.activity(events)[1], f"{where}/out", f"{where}/ck").awaitTermination()
    return _local(t.spark.read.schema("start timestamp, end timestamp, n long").parquet(f"{where}/out"))


@query(f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g),
x AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k)
SELECT * FROM x WHERE "end" <= {_COMPLETE}""")
def w5_session_stream(t: Tables) -> DataFrame:
    """Sessions from a stream, those that have ended."""
    where = _folder(t.spark)
    events = _stream(t, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    streams.run_to_table(streams.activity(events)[2], f"{where}/out", f"{where}/ck").awaitTermination()
    return _local(t.spark.read.schema("user_id long, start timestamp, end timestamp, n long").parquet(f"{where}/out"))
