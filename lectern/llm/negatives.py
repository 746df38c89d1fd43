"""Hard negatives: rows of other labels that score a little below an anchor's positives, found by spanning-tree bounds.

The anchors of a block are joined by a minimum spanning tree. The root scores all candidates of a chunk. A child's score of a
candidate differs from its parent's by the edge's length times the candidate's norm at most, so the parent's scores give
intervals for the child; only candidates whose interval meets the child's window are scored, and what was scored tightens
the intervals of the children below.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Candidates in a chunk, anchors that share a tree, and bytes of anchors that are broadcast at a time.
CHUNK_ROWS = 16_384
BLOCK_ANCHORS = 256
BROADCAST_BYTES = 16_000_000
#: Scores below this are exact in double precision, whatever the order of the sum.
EXACT = 2.0**52
#: Percent of a positive's score between which a negative's must lie.
LEAST, MOST = 80, 100


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """order, parent, length: the minimum spanning tree of the rows of x from row 0, parents before children."""
    n = len(x)
    order, parent, length = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
    near, via, done = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, bool)
    at = 0
    for k in range(n):
        order[k], done[at] = at, True
        gap = np.sqrt(((x - x[at]) ** 2).sum(1))
        closer = ~done & (gap < near)
        near[closer], via[closer] = gap[closer], at
        if k + 1 < n:
            at = int(np.argmin(np.where(done, np.inf, near)))
            parent[at], length[at] = via[at], near[at]
    return order, parent, length


class Chunk:
    """Candidates in the order of their labels: ids, labels, vectors of whole numbers, their norms."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.argsort(labels, kind="stable")
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.x, self.x))

    def scores(self, rows: np.ndarray | slice, anchor: np.ndarray) -> np.ndarray:
        """Inner products, exact: in doubles if they are small enough, else in whole numbers."""
        if self.norms.max(initial=0.0) * np.sqrt(anchor @ anchor) < EXACT:
            return (self.x[rows] @ anchor).astype(np.int64)
        exact = [sum(int(a) * int(b) for a, b in zip(row, anchor)) for row in self.x[rows]]
        if any(abs(s) >= 1 << 63 for s in exact):
            raise OverflowError("a score does not fit into 64 bits")
        return np.array(exact, np.int64)


def around(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubles that enclose whole scores, also those that a double cannot hold."""
    return scores - np.abs(scores) * 2.0**-50, scores + np.abs(scores) * 2.0**-50


def walk(chunk: Chunk, anchors: np.ndarray, tree, need: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple]:
    """Yields (anchor, rows, scores): the rows for which need(anchor, lo, hi) holds, exactly scored.

    lo and hi bound the anchor's score of each candidate. An anchor's bounds are kept until its last child has used them.
    """
    order, parent, length = tree
    children = np.bincount(parent[parent >= 0], minlength=len(parent))
    bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for a in order.tolist():
        p = int(parent[a])
        if p < 0:
            lo, hi = around(chunk.scores(slice(None), anchors[a]))
        else:
            slack = length[a] * chunk.norms * (1 + 1e-9) + 1  # rounding may not narrow an interval
            lo, hi = bounds[p][0] - slack, bounds[p][1] + slack
            children[p] -= 1
            if not children[p]:
                del bounds[p]
        rows = np.flatnonzero(need(a, lo, hi))
        scores = chunk.scores(rows, anchors[a])
        lo[rows], hi[rows] = around(scores)
        if children[a]:
            bounds[a] = lo, hi
        yield a, rows, scores


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by (score down, id up)."""
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value; minus infinity if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def positives(chunk: Chunk, block: dict, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, rows, scores): each anchor's k best other rows of its label in the chunk.

    A row is out if k rows of the label certainly score higher.
    """
    starts = np.searchsorted(chunk.labels, block["labels"], side="left")
    ends = np.searchsorted(chunk.labels, block["labels"], side="right")

    def need(a: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        wanted, own = np.zeros(len(lo), bool), slice(starts[a], ends[a])
        other = chunk.ids[own] != block["ids"][a]
        wanted[own] = other & (hi[own] >= kth(lo[own][other], k))
        return wanted

    for a, rows, scores in walk(chunk, block["x"], block["tree"], need):
        best = first(scores, chunk.ids[rows], k)
        yield a, rows[best], scores[best]


def windows(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole score of a negative for each positive's score p: LEAST p <= 100 s <= MOST p, in exact arithmetic."""
    return np.array([-(-LEAST * int(p) // 100) for p in scores], np.int64), np.array([MOST * int(p) // 100 for p in scores], np.int64)


def negatives(chunk: Chunk, block: dict, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor, place of its positive, rows, scores): for each window the k best rows of another label in the chunk.

    A row is out of a window if its interval misses it, or if k rows that certainly lie in it certainly score higher.
    """
    ranges = [windows(p) for p in block["positives"]]

    def need(a: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        other, wanted = chunk.labels != block["labels"][a], np.zeros(len(lo), bool)
        for least, most in zip(*ranges[a]):
            if least <= most:
                sure = lo[other & (lo >= least) & (hi <= most)]
                wanted |= (hi >= max(float(least), kth(sure, k))) & (lo <= most)
        return wanted & other

    for a, rows, scores in walk(chunk, block["x"], block["tree"], need):
        for place, (least, most) in enumerate(zip(*ranges[a])):
            inside = np.flatnonzero((scores >= least) & (scores <= most))
            best = inside[first(scores[inside], chunk.ids[rows[inside]], k)]
            yield a, place, rows[best], scores[best]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of whole numbers."""
    return np.floor(256 * np.stack(column.to_numpy()).astype(np.float64))


def _packed(rows: DataFrame, key: str) -> DataFrame:
    """(size, key, ids, labels, vectors): the rows of each chunk as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        ids, labels = (table.column(c).to_numpy().astype(np.int64).tobytes() for c in ("vec_id", "label"))
        one = {"size": [table.column("size")[0].as_py()], key: [table.column(key)[0].as_py()], "ids": [ids], "labels": [labels]}
        yield pa.RecordBatch.from_pydict({**one, "vectors": [_matrix(table.column("x")).tobytes()]})

    schema = f"size long, {key} long, ids binary, labels binary, vectors binary"
    return rows.select("size", key, "vec_id", "label", "x").groupBy("size", key).applyInArrow(pack, schema)


def _blocks(anchors: DataFrame) -> DataFrame:
    """(size, block, of): anchors (row, vec_id, label, x, size, block, positives) of each block with their tree, as one struct."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        x = _matrix(table.column("x"))
        order, parent, length = spanning_tree(x)
        ids, labels, rows = (table.column(c).to_numpy().astype(np.int64).tobytes() for c in ("vec_id", "label", "row"))
        scores = [np.array([p["score"] for p in ps], np.int64) for ps in table.column("positives").to_pylist()]
        made = {
            "rows": rows, "ids": ids, "labels": labels, "vectors": x.tobytes(), "order": order.astype(np.int64).tobytes(),
            "parent": parent.astype(np.int64).tobytes(), "length": length.tobytes(),
            "scores": np.concatenate([np.zeros(0, np.int64), *scores]).tobytes(),
            "counts": np.array([len(s) for s in scores], np.int64).tobytes(),
        }
        one = {"size": [table.column("size")[0].as_py()], "block": [table.column("block")[0].as_py()]}
        yield pa.RecordBatch.from_pydict({**one, **{k: [v] for k, v in made.items()}})

    names = ["rows", "ids", "labels", "vectors", "order", "parent", "length", "scores", "counts"]
    schema = "size long, block long, " + ", ".join(f"{n} binary" for n in names)
    given = anchors.select("size", "block", "row", "vec_id", "label", "x", "positives")
    return given.groupBy("size", "block").applyInArrow(pack, schema).select("size", "block", F.struct(*names).alias("of"))


def _block(of: dict, size: int) -> dict:
    """A block as arrays."""
    whole = {k: np.frombuffer(of[k], np.int64) for k in ("rows", "ids", "labels", "order", "parent", "scores", "counts")}
    tree = whole["order"], whole["parent"], np.frombuffer(of["length"], np.float64)
    positives = np.split(whole["scores"], np.cumsum(whole["counts"])[:-1])
    return {**whole, "x": np.frombuffer(of["vectors"], np.float64).reshape(-1, size), "tree": tree, "positives": positives}


def _met(chunks: DataFrame, blocks: DataFrame, rounds: int, look: Callable[[Chunk, dict], Iterator[tuple]]) -> DataFrame:
    """(row, place, vec_id, score): what look finds for every chunk and block of one vector length.

    A round's blocks, a share of bounded size, are one array that is broadcast: a chunk meets them all in one call.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                size, ids, labels, vectors = (batch.column(n)[i].as_py() for n in ("size", "ids", "labels", "vectors"))
                x = np.frombuffer(vectors, np.float64).reshape(-1, size)
                chunk = Chunk(np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), x)
                for of in batch.column("blocks")[i]:
                    block = _block(of.as_py(), size)
                    found = [(np.full(len(r), block["rows"][a]), np.full(len(r), p), chunk.ids[r], s) for a, p, r, s in look(chunk, block)]
                    columns = [np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*found)]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["row", "place", "vec_id", "score"])

    met = None
    for r in range(rounds):
        some = blocks.where(F.pmod("block", F.lit(rounds)) == r).groupBy("size").agg(F.collect_list("of").alias("blocks"))
        one = chunks.join(F.broadcast(some), "size").mapInArrow(run, "row long, place long, vec_id long, score long")
        met = one if met is None else met.unionByName(one)
    return met


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", order).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of vectors where is_anchor holds.

    vectors holds vec_id, label and embedding. A component x counts as floor(256 x); a score is the whole inner product with
    the anchor, exactly; order is by score downwards, then by vec_id. An anchor's positives are its first n_positives rows of
    its label with another vec_id. A positive's negatives are the first n_negatives rows of other labels that score between
    LEAST and MOST percent of the positive; ranks count from 1.

    Candidates are shuffled for repeated rows and to chunks of about CHUNK_ROWS, which serve both passes; anchors are blocks of about
    BLOCK_ANCHORS, broadcast BROADCAST_BYTES at a time. Each chunk gives an anchor's few best, which are merged. Rows with a null
    vec_id, label or vector, an empty vector or a null or non-finite component take no part; vectors of another length than an
    anchor's are not compared. Rows that are equal in vec_id, label and vector count once; rows that share a vec_id only are rows
    of their own, but never each other's positives. Fewer candidates give fewer rows, empty tables none. Further columns are
    ignored. A score beyond 64 bits fails the job.
    """
    parts = "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    named = vectors.select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"), is_anchor.alias("anchor")
    )
    usable = named.where(f"vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0 AND {parts}")
    whole = usable.withColumnRenamed("embedding", "x").distinct()
    rows = settle(whole.withColumn("size", F.size("x").cast("long")).withColumn("row", F.xxhash64("vec_id", "label", "x")))
    chunks = max(1, -(-rows.count() // CHUNK_ROWS))
    held = settle(_packed(rows.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks))), "chunk"))
    chosen = rows.where("anchor")
    count, size = chosen.agg(F.count(F.lit(1)), F.coalesce(F.sum(8 * (F.col("size") + 16)), F.lit(0))).first()
    rounds = max(1, -(-size // BROADCAST_BYTES))
    blocks = max(rounds, -(-count // BLOCK_ANCHORS))
    chosen = chosen.withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)))

    def of_label(chunk: Chunk, block: dict) -> Iterator[tuple]:
        return ((a, 0, rows, scores) for a, rows, scores in positives(chunk, block, n_positives))

    def of_others(chunk: Chunk, block: dict) -> Iterator[tuple]:
        return negatives(chunk, block, n_negatives)

    bare = settle(_blocks(chosen.withColumn("positives", F.expr("CAST(array() AS array<struct<place: int, score: bigint>>)"))))
    top = settle(_best(_met(held, bare, rounds, of_label), ["row"], n_positives).selectExpr("row", "rank - 1 AS place", "vec_id AS positive_id", "score AS positive_score"))
    listed = top.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", F.col("positive_score").alias("score")))).alias("positives"))
    known = settle(_blocks(chosen.join(listed, "row")))
    found = _best(_met(held, known, rounds, of_others), ["row", "place"], n_negatives)
    named = found.join(top, ["row", "place"]).join(chosen.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return named.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
