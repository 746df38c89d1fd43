"""Notes on texts and the records made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def local_day(ts: str | Column, tz: str = "UTC") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, tz))


def note_kind(notes: DataFrame) -> DataFrame:
    """notes with shown_kind (ask, note with words, hl) and line: own words, else the first question, else the quote."""
    words = F.nullif(F.trim(F.coalesce("text", F.lit(""))), F.lit(""))
    kind = F.when(F.col("kind") == "ask", "ask").when(words.isNotNull(), "note").otherwise("hl")
    return notes.withColumns({"shown_kind": kind, "line": F.coalesce(words, F.get("thread", F.lit(0))["q"], "quote")})


def notes_feed(notes: DataFrame, docs: DataFrame, used: DataFrame) -> DataFrame:
    """Every note with its document's title and language and the records that use it, newest first by place.

    docs: doc_id, title, lang; used: doc_id, note_id, record_id.
    """
    records = used.groupBy("doc_id", "note_id").agg(F.array_join(F.array_sort(F.collect_set("record_id")), ",").alias("records"))
    return (
        notes.join(docs, "doc_id").join(records, ["doc_id", "note_id"], "left")
        .withColumn("records", F.coalesce("records", F.lit(""))).select("doc_id", "note_id", "created", "title", "lang", "records")
        .orderBy(F.desc("created"), "note_id")
    )


def apply_note_changes(changes: DataFrame) -> DataFrame:
    """Notes after puts and deletes: the last change of an id wins, created stays from the first put since a delete.

    changes: doc_id, note_id, op (put, delete), ts, seq, text. Ids must start with n-.
    """
    good = changes.where(F.col("note_id").startswith("n-"))
    last = good.groupBy("doc_id", "note_id").agg(
        F.max_by(F.struct("op", "text", "ts"), F.struct("ts", "seq")).alias("x"),
        F.max(F.when(F.col("op") == "delete", F.struct("ts", "seq"))).alias("gone"),
    )
    live = last.where("x.op = 'put'")
    first = good.where("op = 'put'").join(live.select("doc_id", "note_id", "gone"), ["doc_id", "note_id"])
    first = first.where("gone IS NULL OR struct(ts, seq) > gone").groupBy("doc_id", "note_id").agg(F.min("ts").alias("created"))
    return live.join(first, ["doc_id", "note_id"]).select("doc_id", "note_id", "created", F.col("x.ts").alias("updated"), F.col("x.text").alias("text"))


def pick_notes(picks: DataFrame, notes: DataFrame, most: int = 400) -> DataFrame:
    """doc_id, note_id, created, place: picked notes by time within a text, texts by their first picked note; 400 at most.

    The limit belongs to a record.
    """
    found = notes.join(picks, ["doc_id", "note_id"], "left_semi")
    first = F.min(F.struct("created", "note_id")).over(Window.partitionBy("doc_id"))
    ordered = found.withColumn("_first", first).orderBy("_first", "doc_id", "created", "note_id").limit(most)
    place = F.row_number().over(Window.orderBy("_first", "doc_id", "created", "note_id"))
    return ordered.withColumn("place", place).select("doc_id", "note_id", "created", "place")


def texts_read(picked: DataFrame, levels: DataFrame, tz: str = "UTC") -> DataFrame:
    """doc_id, line, notes, first_day, last_day: each text's own line and its picked notes.

    levels: doc_id, pos, role, full, takeaway. The line is an abstract's takeaway, else that of the first paragraph of
    12 characters or more.
    """
    rank = F.struct(F.when(F.col("role") == "abstract", 0).otherwise(1).alias("k"), "pos", "takeaway")
    # The condition is inside the aggregate: as a filter it would be pushed below and fold every unit twice.
    fit = F.when((F.col("role") == "abstract") | (F.length("full") >= 12), rank)
    line = levels.groupBy("doc_id").agg(F.min(fit)["takeaway"].alias("line"))
    day = local_day("created", tz)
    spans = picked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("notes"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    return spans.join(line, "doc_id", "left").select("doc_id", "line", "notes", "first_day", "last_day")


def asked(notes: DataFrame, tz: str = "UTC") -> DataFrame:
    """doc_id, note_id, turn, question, answer_line, section_id, day: one row a question."""
    rows = notes.select("doc_id", "note_id", "section_id", local_day("created", tz).alias("day"), F.posexplode("thread").alias("turn", "x"))
    return rows.where(F.trim("x.q") != "").select("doc_id", "note_id", "turn", F.col("x.q").alias("question"), F.col("x.takeaway").alias("answer_line"), "section_id", "day")


def wrote(notes: DataFrame, tz: str = "UTC") -> DataFrame:
    """doc_id, note_id, words, quote, section_id, day: the reader's own words."""
    words = F.trim(F.coalesce("text", F.lit("")))
    return notes.where(words != "").select("doc_id", "note_id", words.alias("words"), "quote", "section_id", local_day("created", tz).alias("day"))


def marked(notes: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_id, section_id, line, quotes: highlights by section, with the section's line less its own heading.

    sections: doc_id, section_id, title, line.
    """
    rows = notes.where("trim(coalesce(text, '')) = '' AND kind <> 'ask'")
    made = rows.groupBy("doc_id", "section_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("created", "note_id", "quote"))).getField("quote"), " | ").alias("quotes"))
    own = F.when((F.col("title") != "") & F.col("line").startswith(F.col("title")), F.regexp_replace(F.substring("line", F.length("title") + 1, F.length("line")), r"^[\s:.,-]+", "")).otherwise(F.col("line"))
    return made.join(sections.withColumn("line", own).select("doc_id", "section_id", "line"), ["doc_id", "section_id"], "left")


def record_material(picked: DataFrame, notes: DataFrame, sections: DataFrame, most_sections: int = 60, most_chars: int = 1500, most_turns: int = 4) -> DataFrame:
    """tag, place, line: a record's texts T1.., their sections T1.1.. (60 at most, titled ones) and notes 1.., one line each.

    picked: pick_notes(); sections: doc_id, section_id, title, pos. Limits belong to the prompt that is made of it.
    """
    texts = picked.groupBy("doc_id").agg(F.min("place").alias("first"))
    texts = texts.withColumn("t", F.row_number().over(Window.orderBy("first")))
    t_rows = texts.select(F.concat(F.lit("T"), "t").alias("tag"), F.struct(F.lit(0).alias("k"), F.col("t").alias("a"), F.lit(0).alias("b")).alias("place"), F.concat(F.lit("text "), "doc_id").alias("line"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    some = sections.where("title <> ''").join(texts, "doc_id").withColumn("n", n)
    all_n = F.row_number().over(Window.orderBy("t", "n"))
    some = some.withColumn("_all", all_n).where(F.col("_all") <= most_sections)
    s_rows = some.select(F.concat(F.lit("T"), "t", F.lit("."), "n").alias("tag"), F.struct(F.lit(1).alias("k"), F.col("t").alias("a"), F.col("n").alias("b")).alias("place"), F.col("title").alias("line"))
    turns = F.array_join(F.transform(F.slice("thread", 1, most_turns), lambda x: F.concat(x["q"], F.lit(" "), x["takeaway"])), " / ")
    words = F.coalesce(F.nullif(F.trim(F.coalesce("text", F.lit(""))), F.lit("")), F.nullif(turns, F.lit("")), F.col("quote"))
    noted = notes.join(picked.select("doc_id", "note_id", F.col("place").alias("n")), ["doc_id", "note_id"])
    n_rows = noted.select(F.col("n").cast("string").alias("tag"), F.struct(F.lit(2).alias("k"), F.col("n").alias("a"), F.lit(0).alias("b")).alias("place"), F.substring(words, 1, most_chars).alias("line"))
    return t_rows.unionByName(s_rows).unionByName(n_rows)


def reading_record(read: DataFrame, questions: DataFrame, own_words: DataFrame, marks: DataFrame, overview: str = "") -> DataFrame:
    """part, doc_id, ord, line, topic: the whole record as ordered lines: read, asked, wrote, marked, an overview first.

    A line's topic is the line itself up to ten words, else its first clause of five words or fewer, else its first three words.
    """
    parts = [
        read.select(F.lit(1).alias("part"), "doc_id", F.lit("").alias("ord"), F.coalesce("line", F.lit("")).alias("line")),
        questions.select(F.lit(2).alias("part"), "doc_id", F.concat_ws("-", "note_id", "turn").alias("ord"), F.concat_ws(" ", "question", "answer_line").alias("line")),
        own_words.select(F.lit(3).alias("part"), "doc_id", F.col("note_id").alias("ord"), F.col("words").alias("line")),
        marks.select(F.lit(4).alias("part"), "doc_id", F.col("section_id").alias("ord"), F.col("quotes").alias("line")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if overview:
        out = out.unionByName(read.sparkSession.createDataFrame([(0, None, "", overview)], out.schema))
    n = F.regexp_count("line", F.lit(r"[^ ]+"))
    clause = F.trim(F.regexp_extract("line", r"^([^,;:.]*)", 1))
    head = F.array_join(F.slice(F.split(F.trim("line"), " +"), 1, 3), " ")
    topic = F.when(n <= 10, F.col("line")).when((F.regexp_count(clause, F.lit(r"[^ ]+")) <= 5) & (clause != ""), clause).otherwise(head)
    return out.withColumn("topic", topic)


def record_prompts(material: DataFrame, templates: DataFrame) -> DataFrame:
    """name, words, prompt: one prompt a template over the record's material, its length by the number of texts.

    templates: name, instruction. words is min(600, 90 + 70 * texts).
    """
    lines = material.agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("["), "tag", F.lit("] "), "line").alias("l")))).getField("l"), "\n").alias("body"),
        F.count(F.when(F.col("place.k") == 0, 1)).alias("texts"),
    )
    words = F.least(F.lit(600), F.lit(90) + F.lit(70) * F.col("texts"))
    # A record has one row of material, so every template meets one row.
    joined = templates.withColumn("_one", F.lit(1)).join(lines.withColumn("_one", F.lit(1)), "_one")
    return joined.select("name", words.alias("words"), F.concat("instruction", F.lit("\n\n"), "body").alias("prompt"))


def notes_calendar(notes: DataFrame, tz: str = "UTC") -> DataFrame:
    """doc_id (null: all texts), day, notes: notes by local day, and by text and day."""
    return notes.select("doc_id", local_day("created", tz).alias("day")).groupingSets([["doc_id", "day"], ["day"]], "doc_id", "day").agg(
        F.count(F.lit(1)).alias("notes")
    )


def day_ranges(notes: DataFrame, tz: str = "UTC") -> DataFrame:
    """first_day, last_day, label: runs of days with notes; a whole month is named as such."""
    days = notes.select(local_day("created", tz).alias("day")).distinct()
    run = F.date_sub("day", F.row_number().over(Window.orderBy("day")))  # as many rows as days
    spans = days.withColumn("run", run).groupBy("run").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day")).drop("run")
    whole = (F.col("first_day") == F.trunc("first_day", "month")) & (F.col("last_day") == F.last_day("first_day"))
    label = F.when(whole, F.date_format("first_day", "yyyy-MM")).when(F.col("first_day") == F.col("last_day"), F.col("first_day").cast("string")).otherwise(F.concat_ws("/", "first_day", "last_day"))
    return spans.withColumn("label", label)
