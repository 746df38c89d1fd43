"""Helpers that several operators share: shared-folder tables, joins and ranks without hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import drop_settled, settle, shared_dir

__all__ = ["bucket_count", "drop_settled", "running_start", "settle", "shared_dir", "spread_join"]

#: Rows of a bucket that a rank aims at, and the most buckets that it makes.
BUCKET_ROWS = 100
MOST_BUCKETS = 65_536
#: A key with more than this share of all rows is dealt to several tasks; at most as many keys can have it.
HOT_SHARE = 2_000
#: A key with fewer rows than this is never dealt.
HOT_ROWS = 500


def spread_join(many: DataFrame, few: DataFrame, counts: DataFrame, key: str, total: int, deal: Column, how: str = "inner") -> DataFrame:
    """many joined with few (one row a key) on `key`, hot keys dealt to several tasks by the column `deal`.

    counts: key and `_n`, its rows in many. Keys with over a HOT_SHARE-th of `total` rows, of which there can be HOT_SHARE
    at most, are broadcast with their number of parts; their row of few is copied to each part.
    """
    limit = max(HOT_ROWS, total // HOT_SHARE)
    hot = F.broadcast(counts.where(F.col("_n") > limit).select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    left = many.join(hot, key, "left").withColumn("_part", F.pmod(deal, parts)).drop("_parts")
    right = few.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [key, "_part"], how).drop("_part")


def bucket_count(rows: int) -> int:
    """Buckets among which `rows` rows are dealt when they are ranked."""
    return min(max(1, rows // BUCKET_ROWS), MOST_BUCKETS)


def running_start(
    df: DataFrame, groups: list[str], order: list[Column], weight: str, out: str, rows: int, buckets: Column | None = None
) -> DataFrame:
    """Add to each row the sum of `weight` over the rows before it in its group: 0, w1, w1 + w2, ...

    No single task sees a whole group: rows are dealt to hash buckets of `order`; a bucket starts where those before it in
    its group end, and a window adds up inside a bucket only. Buckets come in order of their number, rows in a bucket by
    `order`. Rows with equal `order` columns meet in one bucket, so they should be one row with a weight. buckets: the
    bucket of a row instead, such as the leading bits of a hash that the order begins with, which keeps the order.
    """
    keyed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(bucket_count(rows))) if buckets is None else buckets)
    keys = [*groups, "_bucket"]
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy(*keys).agg(F.sum(weight).alias("_sum"))
    starts = starts.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = F.sum(weight).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    joined = keyed.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(starts, keys)
    return joined.withColumn(out, (F.col("_start") + F.col("_inside")).cast("long")).drop("_bucket", "_start", "_inside")
