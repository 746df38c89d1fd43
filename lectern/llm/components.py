"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_settled, settle, spread_join


def _rooted(pairs: DataFrame, total: int, larger_only: bool) -> DataFrame:
    """One star step over (a, b): link the neighbours of a to the least of them and a. A star's centre may hold most rows."""
    own = pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("_n"))
    joined = spread_join(pairs, own.drop("_n"), own.drop("m"), "a", total, F.xxhash64("b"))
    if larger_only:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(joined.where("a <> m").select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a long, b long) links to (node long, root long): root is the least node that node reaches.

    Nodes without links do not appear. Self links and repeats are ignored, rows with a null end too; an empty table gives
    an empty result. Each round turns every link set into stars around its least node (large-star, then small-star) and is
    written to the shared folder. Rounds end when the links no longer change; running out of max_rounds is an error, not a
    partial answer.
    """
    edges = settle(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    digest = [F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))]
    before = None
    for _ in range(max_rounds):
        now = tuple(edges.agg(*digest).first())
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = settle(_rooted(both, 2 * now[0], larger_only=True).where("a <> b"))
        ends = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        after = settle(_rooted(ends, now[0], larger_only=False))
        for done in (edges, large):
            drop_settled(done)
        edges, before = after, now
    raise RuntimeError(f"links did not settle in {max_rounds} rounds")
