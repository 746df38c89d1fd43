"""Links between units: cross-references and argument links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RELATIONS = ("supports", "qualifies", "contrasts", "details")


def cross_refs(atoms: DataFrame, targets: DataFrame, captions: DataFrame | None = None) -> DataFrame:
    """doc_id, f, t, tk, rel, via: references in units resolved to what they name, in reading order, repeats dropped.

    atoms: doc_id, unit_id, pos, atom, href; targets: doc_id, href, target, kind (unit, figure, equation, section, bib).
    Figures go to their caption's unit (captions: doc_id, target, unit_id). Works cited, self references and a caption's
    own figure are dropped.
    """
    found = atoms.join(targets, ["doc_id", "href"]).where("kind <> 'bib'")
    if captions is not None:
        c = captions.select("doc_id", "target", F.col("unit_id").alias("_cap"))
        found = found.join(c, ["doc_id", "target"], "left").withColumn("target", F.coalesce("_cap", "target"))
    rows = found.where("target <> unit_id").groupBy("doc_id", F.col("unit_id").alias("f"), F.col("target").alias("t")).agg(
        F.min(F.struct("pos", "atom", "kind")).alias("x")
    )
    kind = F.when(F.col("x.kind") == "figure", "unit").otherwise(F.col("x.kind"))
    return rows.select("doc_id", "f", "t", kind.alias("tk"), F.lit("ref").alias("rel"), F.col("x.atom").alias("via"))


def link_prompts(lines: DataFrame, most: int = 400, lead: int = 24) -> DataFrame:
    """doc_id, part, links, prompt: each document's one-line takeaways in near-equal parts, numbered.

    lines: doc_id, pos, role, takeaway. Every part but the first begins with the first 24 abstract lines. The links to
    ask for are max(20, n / 2), shared by size, eight at least.
    """
    w = Window.partitionBy("doc_id")
    # Lines without a takeaway go behind the windows: a filter before them would be pushed below the fold and compute it many times over.
    has = F.col("takeaway") != ""
    counted = lines.select("doc_id", "pos", "role", "takeaway").withColumns({"n": F.count(F.when(has, 1)).over(w), "i": F.count(F.when(has, 1)).over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - 1})
    numbered = counted.where(has)
    size = F.ceil(F.col("n") / F.ceil(F.col("n") / most))
    parts = numbered.withColumn("part", F.floor(F.col("i") / size).cast("int")).withColumn("parts", F.ceil(F.col("n") / size).cast("int"))
    head = parts.where("role = 'abstract'").withColumn("k", F.row_number().over(w.orderBy("pos"))).where(F.col("k") <= lead)
    again = head.where("parts > 1").withColumn("to", F.explode(F.sequence(F.lit(1), F.col("parts") - 1))).where("to <> part")
    cols = ["doc_id", "part", "i", "n", "takeaway"]
    rows = parts.select(*cols).unionByName(again.withColumn("part", F.col("to")).select(*cols))
    line = F.concat(F.lit("["), "i", F.lit("] "), "takeaway")
    made = rows.groupBy("doc_id", "part").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("here"), F.array_sort(F.collect_list(F.struct("i", line.alias("l")))).alias("x"))
    links = F.greatest(F.lit(8), F.round(F.greatest(F.lit(20), F.floor(F.col("n") / 2)) * F.col("here") / F.col("n")).cast("int"))
    return made.select("doc_id", "part", links.alias("links"), F.array_join("x.l", "\n").alias("prompt"))


def merge_links(replies: DataFrame, units: DataFrame, refs: DataFrame, per_source: int = 3) -> DataFrame:
    """doc_id, f, t, rel, via: argument links that hold up, and the plain references with other ends.

    replies: doc_id, seq, f, t, rel with places of units; units: doc_id, pos, unit_id, section_id; refs as cross_refs().
    Kept in reply order: known places, a known relation, no self link, no neighbours of one section, no repeat, three a
    source at most.
    """
    a = units.select("doc_id", F.col("pos").alias("f"), F.col("unit_id").alias("fu"), F.col("section_id").alias("fs"))
    b = units.select("doc_id", F.col("pos").alias("t"), F.col("unit_id").alias("tu"), F.col("section_id").alias("ts"))
    good = replies.where(F.col("rel").isin(*RELATIONS) & (F.col("f") != F.col("t"))).join(a, ["doc_id", "f"]).join(b, ["doc_id", "t"])
    good = good.where((F.col("fs") != F.col("ts")) | (F.abs(F.col("f") - F.col("t")) != 1))
    pair = F.row_number().over(Window.partitionBy("doc_id", "f", "t").orderBy("seq"))
    once = good.withColumn("_k", pair).where("_k = 1")
    mine = F.row_number().over(Window.partitionBy("doc_id", "f").orderBy("seq"))
    kept = once.withColumn("_n", mine).where(F.col("_n") <= per_source)
    made = kept.select("doc_id", F.col("fu").alias("f"), F.col("tu").alias("t"), "rel", F.lit(None).cast("string").alias("via"))
    rest = refs.join(made.select("doc_id", "f", "t"), ["doc_id", "f", "t"], "left_anti").select("doc_id", "f", "t", "rel", "via")
    return made.unionByName(rest)
