"""The library: list, groups, folders, times, trash."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import drop_settled, settle


def latest_layers(layers: DataFrame) -> DataFrame:
    """The newest version of each (doc_id, lang)."""
    n = F.row_number().over(Window.partitionBy("doc_id", "lang").orderBy(F.desc("version")))
    return layers.withColumn("_n", n).where("_n = 1").drop("_n")


def library_list(docs: DataFrame, layers: DataFrame, notes: DataFrame) -> DataFrame:
    """doc_id, title, languages, updated, notes, pending: one row a document; sides are aggregated before they are joined.

    docs: doc_id, title, lang, added; layers: doc_id, lang, version, base, made_at. Own language first in languages.
    """
    newest = latest_layers(layers)
    own = docs.select("doc_id", F.col("lang").alias("own"))
    by_doc = newest.join(own, "doc_id").groupBy("doc_id").agg(
        F.max("made_at").alias("made"),
        F.array_join(F.array_sort(F.collect_list(F.struct((F.col("lang") != F.col("own")).alias("k"), "lang"))).getField("lang"), ",").alias("languages"),
    )
    counts = notes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    pending = freshness(layers, docs).groupBy("doc_id").agg(F.bool_or("stale").alias("pending"))
    out = docs.join(by_doc, "doc_id", "left").join(counts, "doc_id", "left").join(pending, "doc_id", "left")
    return out.select(
        "doc_id", "title", F.coalesce("languages", "lang").alias("languages"), F.coalesce("made", "added").alias("updated"),
        F.coalesce("n", F.lit(0)).alias("notes"), F.coalesce("pending", F.lit(False)).alias("pending"),
    )


def freshness(layers: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, lang, version, stale: each translation's newest layer, stale if its base is not the text's newest version.

    docs: doc_id, lang. The text's own layers have its language.
    """
    newest = latest_layers(layers)
    own = docs.select("doc_id", F.col("lang").alias("own"))
    base = newest.join(own, "doc_id").where("lang = own").select("doc_id", F.col("version").alias("now"))
    return newest.join(own, "doc_id").where("lang <> own").join(base, "doc_id", "left").select(
        "doc_id", "lang", "version", (F.col("base") != F.coalesce("now", F.lit(0))).alias("stale")
    )


def library_groups(listed: DataFrame, now: Column, order: str = "opened") -> DataFrame:
    """listed (key, added, opened, updated) with kind by its key and a recency group by added or opened."""
    kind = (
        F.when(F.col("key").startswith("record-"), "record").when(F.col("key").rlike(r"^\d{4}\.\d{4,5}"), "paper").when(F.col("key").startswith("wiki-"), "wiki")
        .when(F.col("key").startswith("gh-"), "github").when(F.col("key").startswith("web-"), "web").otherwise("document")
    )
    at = F.coalesce("opened", "added", "updated") if order == "opened" else F.coalesce("added", "updated")
    days = F.date_diff(now, at)
    group = F.when(days <= 0, "today").when(days < 7, "week").when(days < 30, "month").otherwise("older")
    return listed.withColumns({"kind": kind, "recency": group})


def _climbed(tree: DataFrame) -> tuple[DataFrame, bool]:
    """tree (folder_id, parent, n) as folder_id, up, depth, documents, and whether some folder never meets a top.

    Pointers double: each round a folder's pointer becomes its ancestor's, so 2^k levels are climbed in k rounds, and a folder adds what
    the folders that point to it have gathered. A round is a join, an aggregate and a written table. Folders that still point
    somewhere after more steps than there are folders stand in a loop or below one; their pointers are the loops' members.
    """
    first = F.when(F.col("parent").isNotNull(), 1).otherwise(0).alias("depth")
    now = settle(tree.select("folder_id", F.col("parent").alias("up"), first, F.col("n").alias("documents")))
    total, steps = now.count(), 1
    while steps <= 2 * total:
        if not now.where("up IS NOT NULL").take(1):
            return now, False
        above = now.select(F.col("folder_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        below = now.where("up IS NOT NULL").groupBy(F.col("up").alias("folder_id")).agg(F.sum("documents").alias("_more"))
        met = now.join(above, "up", "left").join(below, "folder_id", "left")
        after = settle(met.select(
            "folder_id", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
            (F.col("documents") + F.coalesce("_more", F.lit(0))).alias("documents"),
        ))
        drop_settled(now)
        now, steps = after, 2 * steps
    return now, True


def folder_tree(folders: DataFrame, placements: DataFrame) -> DataFrame:
    """folder_id, parent, depth, documents: the tree with each folder's documents and those of all below it.

    Folders whose parent is missing, or that stand in a loop, are taken to the top. Trees may be of any depth (see _climbed); each
    round is one row a folder.
    """
    there = folders.select(F.col("folder_id").alias("parent"), F.lit(True).alias("known"))
    own = placements.groupBy("folder_id").agg(F.count(F.lit(1)).alias("n"))
    known = folders.join(there, "parent", "left").select("folder_id", F.when(F.col("known"), F.col("parent")).alias("parent"))
    tree = settle(known.join(own, "folder_id", "left").fillna(0, ["n"]))
    climbed, looped = _climbed(tree)
    if looped:
        loops = climbed.where("up IS NOT NULL").select(F.col("up").alias("folder_id"), F.lit(True).alias("looped")).distinct()
        healed = tree.join(loops, "folder_id", "left").select("folder_id", F.when(F.col("looped").isNull(), F.col("parent")).alias("parent"), "n")
        tree = settle(healed)
        climbed, _ = _climbed(tree)
    return tree.select("folder_id", "parent").join(climbed.select("folder_id", "depth", "documents"), "folder_id")


def apply_folder_changes(changes: DataFrame) -> DataFrame:
    """tree, folder_id, name, parent of the folders that stand after changes in order: new, rename, nest, delete.

    changes: tree, seq, op, folder_id, name, parent. Each change meets the state before it: one that names no standing
    folder is refused, as is a nest into itself or below itself; what a deleted folder held moves to its parent. A tree is
    one reader's folders, so its changes are replayed in one group; trees are independent.
    """

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        names: dict[str, str] = {}
        parents: dict[str, str | None] = {}
        for op, folder, name, parent in pdf.sort_values("seq")[["op", "folder_id", "name", "parent"]].itertuples(index=False):
            parent = parent if isinstance(parent, str) else None
            if parent is not None and parent not in parents:
                continue
            if op == "new" and folder not in parents:
                names[folder], parents[folder] = name, parent
            elif folder not in parents:
                continue
            elif op == "rename":
                names[folder] = name
            elif op == "nest":
                above = parent
                while above is not None and above != folder:
                    above = parents[above]
                if above is None:
                    parents[folder] = parent
            elif op == "delete":
                up = parents.pop(folder)
                for other, own in parents.items():
                    if own == folder:
                        parents[other] = up
        out = pd.DataFrame([(f, names[f], p) for f, p in parents.items()], columns=["folder_id", "name", "parent"])
        out.insert(0, "tree", pdf["tree"].iloc[0])
        return out

    kind = changes.schema["tree"].dataType.simpleString()
    return changes.groupBy("tree").applyInPandas(replay, f"tree {kind}, folder_id string, name string, parent string")


def library_times(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, added, opened: the oldest time a document was seen, kept once set, and when it was opened last."""
    seen = events.groupBy("doc_id").agg(F.min("ts").alias("first"), F.max(F.when(F.col("event") == "opened", F.col("ts"))).alias("opened"))
    if known is None:
        return seen.withColumnRenamed("first", "added")
    return seen.join(known.select("doc_id", F.col("added").alias("set")), "doc_id", "full").select("doc_id", F.coalesce("set", "first").alias("added"), "opened")


def trash(events: DataFrame, now: Column, keep_days: int = 30) -> DataFrame:
    """doc_id, deleted, erased: documents whose last deletion was not undone, and whether they are past their days.

    events: doc_id, event (deleted, restored), ts, seq.
    """
    last = events.where("event IN ('deleted', 'restored')").groupBy("doc_id").agg(F.max_by(F.struct("event", "ts"), F.struct("ts", "seq")).alias("x"))
    return last.where("x.event = 'deleted'").select("doc_id", F.col("x.ts").alias("deleted"), (F.date_diff(now, F.col("x.ts")) > keep_days).alias("erased"))


def placement_history(events: DataFrame, live: DataFrame) -> DataFrame:
    """doc_id, folder_id now: a document's folder leaves with it and comes back with it, if the folder still stands.

    events: doc_id, event (placed, deleted, restored), folder_id, ts, seq; live: folder_id.
    """
    w = Window.partitionBy("doc_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    last_place = F.last(F.when(F.col("event") == "placed", F.col("folder_id")), ignorenulls=True).over(w)
    state = events.withColumn("place", last_place).groupBy("doc_id").agg(F.max_by(F.struct("event", "place"), F.struct("ts", "seq")).alias("x"))
    here = state.where("x.event <> 'deleted'").select("doc_id", F.col("x.place").alias("folder_id"))
    stands = live.select("folder_id").distinct().withColumn("_ok", F.lit(True))
    return here.join(stands, "folder_id", "left").select("doc_id", F.when(F.col("_ok"), F.col("folder_id")).alias("folder_id"))
