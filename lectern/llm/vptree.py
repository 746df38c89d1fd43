"""Nearest neighbours by vantage-point trees, one per shard, pruned by the triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_settled, settle

#: Vectors in one shard's tree, and queries that are put to a tree together.
SHARD_ROWS = 16_384
QUERY_ROWS = 4_096
#: Bytes of query vectors that are broadcast at a time.
BROADCAST_BYTES = 16_000_000
#: Vectors in a leaf, compared in one matrix product.
LEAF = 128


class VantageTree:
    """A vantage-point tree over the rows of x, in preorder: each inner node splits its rows at a vantage's median."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x = x
        self.order = np.arange(len(x))
        self.norms = np.einsum("ij,ij->i", x, x)
        self.nodes: list[tuple[int, int, int, float, int]] = []  # start, end, vantage or -1, radius, outer node
        self._build(0, len(x), leaf)

    def packed(self, ids: np.ndarray) -> dict[str, bytes]:
        """ids, vectors and nodes as bytes, rows in the order of the leaves, so that a leaf is one slice."""
        place = np.empty(len(self.order), np.int64)
        place[self.order] = np.arange(len(self.order))
        ends = [(lo, hi, int(place[v]) if v >= 0 else -1, outer) for lo, hi, v, _, outer in self.nodes]
        radii = np.array([n[3] for n in self.nodes], np.float64)
        return {
            "ids": ids[self.order].astype(np.int64).tobytes(), "vectors": self.x[self.order].astype(np.float64).tobytes(),
            "ends": np.array(ends, np.int64).tobytes(), "radii": radii.tobytes(),
        }

    @classmethod
    def unpacked(cls, size: int, vectors: bytes, ends: bytes, radii: bytes) -> VantageTree:
        """A tree made by packed(), without building it again."""
        tree = cls.__new__(cls)
        tree.x = np.frombuffer(vectors, np.float64).reshape(-1, size)
        tree.order = np.arange(len(tree.x))
        tree.norms = np.einsum("ij,ij->i", tree.x, tree.x)
        rows = zip(np.frombuffer(ends, np.int64).reshape(-1, 4).tolist(), np.frombuffer(radii, np.float64).tolist())
        tree.nodes = [(lo, hi, v, r, outer) for (lo, hi, v, outer), r in rows]
        return tree

    def _build(self, lo: int, hi: int, leaf: int) -> None:
        todo = [(lo, hi, -1)]
        while todo:
            lo, hi, parent = todo.pop()
            at = len(self.nodes)
            if parent >= 0:
                s, e, v, r, _ = self.nodes[parent]
                self.nodes[parent] = (s, e, v, r, at)
            if hi - lo <= leaf:
                self.nodes.append((lo, hi, -1, 0.0, -1))
                continue
            rows = self.order[lo:hi]
            far = np.sqrt(((self.x[rows] - self.x[rows[0]]) ** 2).sum(1))
            v = int(rows[np.argmax(far)])  # a row at the rim separates better than one in the middle
            d = np.sqrt(((self.x[rows] - self.x[v]) ** 2).sum(1))
            radius = float(np.median(d))
            inner = d <= radius
            if inner.all():  # all rows are equally far, such as copies: nothing to split
                self.nodes.append((lo, hi, -1, 0.0, -1))
                continue
            self.order[lo:hi] = np.concatenate([rows[inner], rows[~inner]])
            mid = lo + int(inner.sum())
            self.nodes.append((lo, hi, v, radius, -1))
            todo.append((mid, hi, at))
            todo.append((lo, mid, -1))

    def search(self, q: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, factor: float):
        """For each row of q its k nearest rows by (distance, id), without the row whose id is own."""
        n = len(q)
        best_d = np.full((n, k), np.inf)
        best_id = np.full((n, k), np.iinfo(np.int64).max)
        qn = np.einsum("ij,ij->i", q, q)
        todo = [(0, np.arange(n), np.zeros(n))]
        while todo:
            at, active, bound = todo.pop()
            # The k-th distance has shrunk since this branch was put off. Rounding must not drop a tie.
            keep = bound * factor <= best_d[active, -1] * (1 + 1e-9) + 1e-9
            active = active[keep]
            if not len(active):
                continue
            lo, hi, v, radius, outer = self.nodes[at]
            if v < 0:
                self._leaf(lo, hi, q, qn, active, own, ids, best_d, best_id, k)
                continue
            gap = np.sqrt(((q[active] - self.x[v]) ** 2).sum(1)) - radius
            low = np.maximum(bound[keep], np.abs(gap))
            near_in = gap <= 0
            # Later in the list is searched earlier: the side that holds the query comes first.
            todo.append((outer, active[near_in], low[near_in]))
            todo.append((at + 1, active[~near_in], low[~near_in]))
            todo.append((at + 1, active[near_in], bound[keep][near_in]))
            todo.append((outer, active[~near_in], bound[keep][~near_in]))
        return best_d, best_id

    def _leaf(self, lo, hi, q, qn, active, own, ids, best_d, best_id, k) -> None:
        for s in range(lo, hi, 4096):
            rows = self.order[s : min(hi, s + 4096)]
            for t in range(0, len(active), 1024):
                part = active[t : t + 1024]
                scale = qn[part][:, None] + self.norms[rows][None, :]
                rough = scale - 2 * (q[part] @ self.x[rows].T)
                limit = best_d[part, -1] ** 2
                i, j = np.nonzero(rough <= (limit * (1 + 1e-9))[:, None] + 1e-9 * scale + 1e-12)
                other = ids[rows[j]] != own[part[i]]
                i, j = i[other], j[other]
                if not len(i):
                    continue
                # Only those that may count are measured exactly.
                d = np.sqrt(((q[part[i]] - self.x[rows[j]]) ** 2).sum(1))
                r = part[i]
                who = np.concatenate([np.repeat(np.unique(r), k), r])
                seen = np.unique(r)
                dist = np.concatenate([best_d[seen].ravel(), d])
                name = np.concatenate([best_id[seen].ravel(), ids[rows[j]]])
                order = np.lexsort((name, dist, who))
                first = np.searchsorted(who[order], seen)
                pick = order[first[:, None] + np.arange(k)]
                best_d[seen], best_id[seen] = dist[pick], name[pick]


def grown(vectors: DataFrame) -> DataFrame:
    """(size, shard, ids, vectors, ends, radii): one packed tree for each shard of vectors (vec_id, embedding, shard, size)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        size = table.column("size")[0].as_py()
        x = np.stack(table.column("embedding").to_numpy()).astype(np.float64)
        made = VantageTree(x).packed(table.column("vec_id").to_numpy())
        yield pa.RecordBatch.from_pydict({"size": [size], "shard": [table.column("shard")[0].as_py()], **{k: [v] for k, v in made.items()}})

    schema = "size long, shard long, ids binary, vectors binary, ends binary, radii binary"
    return vectors.groupBy("shard", "size").applyInArrow(build, schema)


def blocks_of(queries: DataFrame, blocks: int) -> DataFrame:
    """(size, block, own, asked): queries (vec_id, embedding, size) in `blocks` blocks a size, as bytes."""
    given = queries.select("vec_id", "embedding", F.col("size").cast("long"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        x = np.stack(table.column("embedding").to_numpy()).astype(np.float64)
        own = table.column("vec_id").to_numpy().astype(np.int64)
        one = {k: [table.column(k)[0].as_py()] for k in ("size", "block")}
        yield pa.RecordBatch.from_pydict({**one, "own": [own.tobytes()], "asked": [x.tobytes()]})

    return given.groupBy("block", "size").applyInArrow(pack, "size long, block long, own binary, asked binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest vectors by Euclidean distance, ties to the smaller vec_id.

    vectors and queries hold vec_id and embedding; further columns are ignored. Vectors are shuffled three times: for repeated
    rows, for equal vectors, and to shards of about SHARD_ROWS; each shard's tree is built once and written. Queries are blocks of
    about QUERY_ROWS, which are broadcast to the trees, BROADCAST_BYTES of them at a time: a tree meets all blocks of a round
    in one call, and no vector moves again. The shards' answers are merged.
    A branch is skipped when `factor` times the least distance that the triangle inequality allows exceeds the k-th best
    found so far: 1 is exact, more skips more. Rows whose vector is null, zero or has null or non-finite parts take no
    part, nor do null ids; a row never finds its own vec_id. Vectors of another length than a query's are not compared.
    Of equal vectors only the k + 1 with the smallest ids are kept, as no other can be among a query's k nearest. Repeated
    rows count once. Fewer than k candidates give fewer rows; empty tables give none.
    """
    good = "vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0"
    parts = "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    usable = f"{good} AND {parts} AND exists(embedding, x -> x <> 0)"

    def clean(df: DataFrame) -> DataFrame:
        chosen = df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(usable)
        return chosen.withColumn("size", F.size("embedding").cast("long"))

    # One vector may stand in a third of all rows: its ranks are limited before they are shuffled, and again behind.
    rank = F.row_number().over(Window.partitionBy(F.xxhash64("embedding"), "embedding").orderBy("vec_id"))
    held = settle(clean(vectors).distinct().withColumn("_n", rank).where(F.col("_n") <= k + 1).drop("_n"))
    asked = settle(clean(queries).distinct())
    shards = max(1, -(-held.count() // SHARD_ROWS))
    found = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(8 * (F.col("size") + 1)), F.lit(0))).first()
    blocks, rounds = max(1, -(-found[0] // QUERY_ROWS)), max(1, -(-found[1] // BROADCAST_BYTES))
    trees = settle(grown(held.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))))
    packs = settle(blocks_of(asked, max(blocks, rounds)))
    drop_settled(held)
    drop_settled(asked)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                size, ids, *packed = (batch.column(n)[i].as_py() for n in ("size", "ids", "vectors", "ends", "radii"))
                tree, ids = VantageTree.unpacked(size, *packed), np.frombuffer(ids, np.int64)
                for of in batch.column("blocks")[i]:
                    block = of.as_py()
                    own = np.frombuffer(block["own"], np.int64)
                    q = np.frombuffer(block["asked"], np.float64).reshape(-1, size)
                    d, near = tree.search(q, own, ids, k, factor)
                    i_, j_ = np.nonzero(np.isfinite(d))
                    out = [pa.array(own[i_]), pa.array(near[i_, j_]), pa.array(d[i_, j_])]
                    yield pa.RecordBatch.from_arrays(out, ["query_id", "vec_id", "score"])

    local = None
    for r in range(rounds):  # a round's blocks are one share of the queries, of bounded size: one array that every tree meets once
        some = packs.where(F.pmod("block", F.lit(rounds)) == r).groupBy("size").agg(F.collect_list(F.struct("own", "asked")).alias("blocks"))
        one = trees.join(F.broadcast(some), "size").mapInArrow(answer, "query_id long, vec_id long, score double")
        local = one if local is None else local.unionByName(one)
    # A repeated id with two vectors is found at its nearer place.
    best = local.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
