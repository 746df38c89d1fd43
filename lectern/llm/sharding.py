"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards within quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BUCKET_ROWS, MOST_BUCKETS, drop_settled, running_start, settle, spread_join

SHARDS = 40
#: Rounds after which propagation is taken for stuck. Each round raises the number of links inside shards, so it ends; a
#: group larger than a shard takes about a round for each shard that it fills.
MOST_ROUNDS = 1000


def sizes_of(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and link: documents with equal texts are linked and share a link value."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(F.concat(F.when(F.col("text").isNull(), F.lit("n")).otherwise(F.lit("t")), text))).alias("link"),
    )


def propagate(members: DataFrame, capacity: dict[int, int], max_rounds: int = MOST_ROUNDS) -> DataFrame:
    """Move linked documents together. members: link, shard, n (how many of the link's documents are in the shard).

    The links between documents of one group are all alike, so a round works on counts: a group's documents outside the
    shard that has most of them want to go there, as each then gains as many links as that shard holds. Only shards with
    room are targets. What wants to enter a shard is ordered by the binary order of its gain, then by hash, and let in up
    to its quota, a group's last part if need be. Rounds end when nothing moves; running out of max_rounds is an error, not
    a partial answer. At most len(capacity) rows a group, so a group of any size stays small.
    """
    spark = members.sparkSession
    now = settle(members)
    shards = spark.createDataFrame(sorted(capacity.items()), "shard int, capacity long")
    for _ in range(max_rounds):
        load = now.groupBy("shard").agg(F.sum("n").alias("load"))
        room = settle(shards.join(load, "shard", "left").selectExpr("shard", "capacity - coalesce(load, 0) AS room"))
        free = now.join(F.broadcast(room), "shard")
        best = free.where("room > 0").groupBy("link").agg(F.max_by("shard", F.struct("n", -F.col("shard"))).alias("target"), F.max("n").alias("gain"))
        level = F.floor(F.log2(F.col("gain") + 1)).alias("level")
        moves = settle(
            now.join(best, "link").where("shard <> target AND (n < gain OR n = gain AND shard > target)")
            .select("link", "shard", "target", level, "n")
        )
        wanting = moves.count()
        if not wanting:
            for table in (moves, room):
                drop_settled(table)
            return now
        # What goes before a mover: all of higher levels, then those of its own level that come before it.
        levels = moves.groupBy("target", "level").agg(F.sum("n").alias("s")).collect()  # shards times 64 rows at most
        above = [(x.target, x.level, sum(y.s for y in levels if y.target == x.target and y.level > x.level)) for x in levels]
        quota = room.select(F.col("shard").alias("target"), "room")
        higher = spark.createDataFrame(above, "target int, level long, above long").join(F.broadcast(quota), "target")
        ranked = running_start(moves, ["target", "level"], [F.col("link"), F.col("shard")], "n", "start", wanting)
        let_in = ranked.join(F.broadcast(higher), ["target", "level"]).withColumn("k", F.expr("least(n, room - above - start)")).where("k > 0")
        change = let_in.select("link", F.col("target").alias("shard"), F.col("k").alias("n")).unionByName(
            let_in.select("link", "shard", (-F.col("k")).alias("n"))
        )
        after = settle(now.unionByName(change).groupBy("link", "shard").agg(F.sum("n").alias("n")).where("n > 0"))
        for table in (moves, room, now):
            drop_settled(table)
        now = after
    raise RuntimeError(f"linked documents still moved after {max_rounds} rounds")


def _spans(parts: Column, start: Column, n: Column) -> Column:
    """array<struct<shard, n>>: how much of [start, start + n) falls in each of parts (array<struct<upto, shard>>, sorted)."""
    low = F.transform(parts, lambda p, i: F.struct(p["shard"].alias("shard"), F.when(i > 0, F.get(parts, i - 1)["upto"]).otherwise(0).alias("lo"), p["upto"].alias("hi")))
    take = lambda p: F.least(p["hi"], start + n) - F.greatest(p["lo"], start)
    return F.filter(F.transform(low, lambda p: F.struct(p["shard"].alias("shard"), take(p).alias("n"))), lambda p: p["n"] > 0)


def shard_documents(docs: DataFrame, shards: int = SHARDS, max_rounds: int = MOST_ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs; the law is `rows`.

    Shards hold counts at most one apart: row counts are divided evenly and the first shards take the rest. Documents
    with equal texts are links. They start where their doc_id puts them and are drawn together by propagate() within
    what a shard may hold; documents without links then fill each shard to its exact count. Slots count up from 0 in each
    shard. Null texts have no bytes and are linked with each other; null ids and repeated rows are documents like others;
    repeated rows are one row with a count until the end. A group larger than a shard is drawn together until no part of it
    can move to a shard with more of it and room left. Texts of any length count by their bytes; further columns are
    ignored; an empty table gives no rows.
    """
    names = ["doc_id", "size", "text_crc32", "link"]
    items = settle(sizes_of(docs).groupBy(*names).agg(F.count(F.lit(1)).alias("n")))
    total = items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    capacity = {s: total // shards + (s < total % shards) for s in range(shards)}
    start = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard")
    counts = items.groupBy("link", start).agg(F.sum("n").alias("n"))
    groups = settle(items.groupBy("link").agg(F.sum("n").alias("members"), F.count(F.lit(1)).alias("_n")).where("members > 1"))
    linked = propagate(_fit(counts.join(groups.select("link"), "link", "left_semi"), capacity), capacity, max_rounds)

    # A linked document takes the shard in whose part of its group its rank falls. A group's parts are one for each of its
    # shards, so at most `shards`. A third of all rows may have one link.
    part = F.array_sort(F.collect_list(F.struct("shard", "n")))
    upto = F.transform(part, lambda p, i: F.struct(F.aggregate(F.slice(part, 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("upto"), p["shard"].alias("shard")))
    # A group has as many buckets as its size asks for, so that their sums are few rows.
    buckets = F.least(F.greatest(F.floor(F.col("_n") / BUCKET_ROWS), F.lit(1)), F.lit(MOST_BUCKETS)).alias("buckets")
    parts = groups.join(linked.groupBy("link").agg(upto.alias("parts")), "link").select("link", "parts", buckets, "_n")
    known = spread_join(items, parts.drop("_n"), parts.select("link", "_n"), "link", total, F.xxhash64("doc_id", "size"), "left")
    marked = settle(known)
    order = [F.col("doc_id"), F.col("size")]
    bucket = F.pmod(F.xxhash64(*order), F.col("buckets"))
    ranked = running_start(marked.where("parts IS NOT NULL"), ["link"], order, "n", "start", total, bucket)
    placed = ranked.select("doc_id", "size", "text_crc32", F.inline(_spans(F.col("parts"), F.col("start"), F.col("n"))))

    # The others fill what is left, shard after shard, by a rank over all of them.
    used = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    ends, at = [], 0
    for s in range(shards):
        at += capacity[s] - used.get(s, 0)
        ends.append(F.struct(F.lit(at).cast("long").alias("upto"), F.lit(s).alias("shard")))
    alone = running_start(marked.where("parts IS NULL").drop("parts", "buckets"), [], [F.col("link"), *order], "n", "start", total)
    filled = alone.select("doc_id", "size", "text_crc32", F.inline(_spans(F.array(*ends), F.col("start"), F.col("n"))))
    everyone = settle(placed.unionByName(filled))
    slots = running_start(everyone, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "n", "first", total // shards)
    slot = F.explode(F.sequence(F.col("first"), F.expr("first + n - 1"))).alias("slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"))


def _fit(counts: DataFrame, capacity: dict[int, int]) -> DataFrame:
    """counts with no shard over capacity: where linked documents alone overfill one, its surplus goes to where room is.

    Starting places are dealt by hash, so this moves a few rows, and only when nearly all documents are linked.
    """
    load = {r["shard"]: (r["n"], r["rows"]) for r in counts.groupBy("shard").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}
    over = {s: n - capacity[s] for s, (n, _) in load.items() if n > capacity[s]}
    if not over:
        return counts
    spark, rows = counts.sparkSession, sum(r for _, r in load.values())
    surplus = F.create_map(*[F.lit(x) for s, n in over.items() for x in (s, n)])
    full = running_start(counts.where(F.col("shard").isin(*over)), ["shard"], [F.col("link")], "n", "start", rows)
    cut = settle(full.withColumn("out", F.least(F.col("n"), surplus[F.col("shard")] - F.col("start"))).where("out > 0").drop("start"))
    cut = running_start(cut, [], [F.col("link"), F.col("shard")], "out", "first", rows)
    room, at = [], 0
    for s, c in sorted(capacity.items()):
        if c > load.get(s, (0, 0))[0]:
            at += c - load.get(s, (0, 0))[0]
            room.append(F.struct(F.lit(at).cast("long").alias("upto"), F.lit(s).alias("shard")))
    moved = cut.select("link", F.inline(_spans(F.array(*room), F.col("first"), F.col("out"))))
    lost = cut.select("link", "shard", (-F.col("out")).alias("n"))
    every = counts.select("link", "shard", "n").unionByName(moved).unionByName(lost)
    return every.groupBy("link", "shard").agg(F.sum("n").alias("n")).where("n > 0")
