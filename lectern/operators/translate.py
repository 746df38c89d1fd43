"""Translations of units: batches, assembly, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def translation_batches(units: DataFrame, target: int = 6_500) -> DataFrame:
    """doc_id, section_id, pos, batch: a section's units in k = ceil(size / target) runs of near-equal size, in order.

    units: doc_id, section_id, pos, size. A run ends where half of the next unit would pass its share; the cut moves one
    batch at a time, by a fold over the section's sizes.
    """
    rows = units.groupBy("doc_id", "section_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("size").cast("double").alias("size")))).alias("x"), F.sum("size").alias("total"))
    k = F.greatest(F.ceil(F.col("total") / target), F.lit(1))
    share = F.col("total") / F.col("k")
    state = F.struct(F.lit(0.0).alias("upto"), F.lit(0).alias("b"), F.array().cast("array<int>").alias("out"))

    def step(s, x):
        passes = (s["upto"] + x["size"] / 2 > (s["b"] + 1) * share) & (s["b"] + 1 < F.col("k")) & (F.size(s["out"]) > 0)
        b = F.when(passes, s["b"] + 1).otherwise(s["b"])
        return F.struct((s["upto"] + x["size"]).alias("upto"), b.alias("b"), F.concat(s["out"], F.array(b)).alias("out"))

    cut = rows.withColumn("k", k).withColumn("b", F.aggregate("x", state, step, lambda s: s["out"]))
    return cut.select("doc_id", "section_id", F.explode(F.arrays_zip(F.col("x.pos").alias("pos"), F.col("b").alias("batch"))).alias("y")).select("doc_id", "section_id", "y.pos", "y.batch")


def assemble_translations(replies: DataFrame, units: DataFrame, atom: str = r"⟦(a\d+)[^⟧]*⟧", stop: str = ".") -> DataFrame:
    """doc_id, pos, lang, sentences, takeaway, key, ev, lost: replies fitted one to one to the units' sentences.

    replies: doc_id, pos, lang, sentences, takeaway, reason; units: doc_id, pos, sentences, ev. A short reply is padded
    with empty sentences, a long one's tail is joined to its last; evidence is cut to the length; a missing takeaway is
    the first sentence; lost counts marks of formulas and citations that did not come back.
    """
    u = units.select("doc_id", "pos", F.col("sentences").alias("src"), "ev")
    j = replies.join(u, ["doc_id", "pos"]).withColumn("sentences", F.coalesce("sentences", F.array().cast("array<string>")))
    n, m = F.size("src"), F.size("sentences")
    fitted = (
        F.when(m < n, F.concat("sentences", F.array_repeat(F.lit(""), n - m)))
        .when(m > n, F.concat(F.slice("sentences", F.lit(1), n - 1), F.array(F.array_join(F.slice("sentences", n, m - n + 1), " "))))
        .otherwise(F.col("sentences"))
    )
    j = j.withColumn("fitted", fitted)
    marks = lambda c: F.regexp_extract_all(F.array_join(c, " "), F.lit(atom), F.lit(1))
    take = F.coalesce(F.nullif(F.trim(F.coalesce("takeaway", F.lit(""))), F.lit("")), F.get("fitted", F.lit(0)), F.lit(""))
    reason = F.trim(F.coalesce("reason", F.lit("")))
    key = F.concat(take, F.lit(stop), F.when(reason != "", F.concat(F.lit(" "), reason, F.lit(stop))).otherwise(F.lit("")))
    return j.select(
        "doc_id", "pos", "lang", F.col("fitted").alias("sentences"), take.alias("takeaway"), key.alias("key"),
        F.filter("ev", lambda e: e < F.size("fitted")).alias("ev"), F.size(F.array_except(marks("src"), marks("fitted"))).alias("lost"),
    )


def translation_gaps(units: DataFrame, translations: DataFrame, langs: list[str]) -> DataFrame:
    """doc_id, section_id, pos, lang: units with more than one word character that lack a row in a language asked for."""
    some = units.where(F.regexp_count("text", F.lit(r"[\p{L}\p{N}_]")) > 1)
    wanted = some.select("doc_id", "section_id", "pos", F.explode(F.array(*[F.lit(x) for x in langs])).alias("lang"))
    return wanted.join(translations.select("doc_id", "pos", "lang"), ["doc_id", "pos", "lang"], "left_anti").select("doc_id", "section_id", "pos", "lang")


def title_gaps(sections: DataFrame, docs: DataFrame, section_titles: DataFrame, doc_titles: DataFrame, langs: list[str]) -> DataFrame:
    """doc_id, section_id (null: the document), lang: titles not translated; a document's also when it is unchanged."""
    each = F.explode(F.array(*[F.lit(x) for x in langs])).alias("lang")
    s = sections.where("title <> ''").select("doc_id", "section_id", each).join(section_titles.select("doc_id", "section_id", "lang"), ["doc_id", "section_id", "lang"], "left_anti")
    made = doc_titles.select("doc_id", "lang", F.col("title").alias("_t"))
    dgap = docs.select("doc_id", "title", each).join(made, ["doc_id", "lang"], "left").where("_t IS NULL OR _t = title")
    return s.select("doc_id", "section_id", "lang").unionByName(dgap.select("doc_id", F.lit(None).cast("string").alias("section_id"), "lang"))
