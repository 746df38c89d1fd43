"""SimHash near-duplicates: fingerprints of word shingles, compared exactly tile by tile."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_settled, settle, spread_join
from .components import components

SEED = 42
#: Sub-blocks of the fingerprint whose population counts name a tile.
BLOCKS = 4
#: Fingerprints in one cell of a tile; larger tiles are several cells.
CELL = 8192
#: Rows of a cell that are compared with another cell at a time.
STRIP = 128
#: Bits of 256 within which two texts are compared shingle by shingle: a pair with a Jaccard similarity of 0.8 differs in
#: 39 on average, with a standard deviation of 6.
RADIUS = 66
#: Shingles in one block of texts that are measured with another block.
BLOCK_SHINGLES = 1 << 16
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def _shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each run of `width` lower-cased words, or of all words if there are fewer; no word, no hash."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=">u8")
    digest, join = xxhash.xxh64_digest, b" ".join
    runs = zip(*(words[i:] for i in range(width))) if len(words) >= width else [words]
    return np.frombuffer(b"".join([digest(join(r), SEED) for r in runs]), dtype=">u8")


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Further 64 bits of a shingle: its hash through the splitmix64 finaliser; lane 0 is the hash itself."""
    if not lane:
        return h.astype(">u8")
    with np.errstate(over="ignore"):
        z = h.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(lane)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (z ^ (z >> np.uint64(31))).astype(">u8")


def _fingerprint(h: np.ndarray, lanes: int) -> bytes:
    """Bits set in over half of the hashes, most significant first; no hash gives zero."""
    out = []
    for lane in range(lanes):
        cols = np.ascontiguousarray(_mixed(h, lane)).view(np.uint8).reshape(len(h), 8)
        counts = np.concatenate([np.bincount(cols[:, k], minlength=256) @ _ONES for k in range(8)])
        out.append(np.packbits(2 * counts > len(h)).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, width: int, lanes: int, distinct: bool) -> DataFrame:
    """(doc_id, text_key, fp binary of 8 * lanes bytes, n_shingles) per row of docs. distinct: each shingle of a text counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes = [], []
            for text in batch.column(2):
                h = _shingle_hashes(text.as_py(), width)
                if distinct:
                    h = np.unique(h)
                fps.append(_fingerprint(h, lanes))
                sizes.append(len(h))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(fps, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "text_key", "fp", "n_shingles"]
            )

    given = docs.select(F.col("doc_id").cast("long"), _text_key(), "text")
    return given.mapInArrow(run, "doc_id long, text_key long, fp binary, n_shingles long")


def _text_key() -> Column:
    """Tells rows that share a doc_id but not their text."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def _linked(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> list[tuple[int, int]]:
    """Links that join all fingerprints of two cells within the radius, without naming every pair.

    a and b hold one row of 64-bit words per fingerprint. A row of a that is near rows of b is linked to the nearest row
    of each set that is not joined with it yet, and to its nearest row: at most a forest and one link a row.
    """
    n, dense, out = len(a), min(3, a.shape[1]), []
    root = np.arange(n + (0 if same else len(b)))
    base = 0 if same else n
    for lo in range(0, n, STRIP):
        # A distance over some lanes is at most that over all, so this loses nothing; three lanes fit a byte.
        near = np.bitwise_count(a[lo : lo + STRIP, None, 0] ^ b[None, :, 0])
        for lane in range(1, dense):
            near += np.bitwise_count(a[lo : lo + STRIP, None, lane] ^ b[None, :, lane])
        rows, cols = np.nonzero(near <= radius)
        keep = cols < rows + lo if same else slice(None)
        rows, cols = rows[keep], cols[keep]
        dist = near[rows, cols].astype(np.int64)
        for lane in range(dense, a.shape[1]):
            dist += np.bitwise_count(a[rows + lo, lane] ^ b[cols, lane])
        ok = dist <= radius
        rows, cols, dist = rows[ok], cols[ok], dist[ok]
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        for s, e in zip(starts, [*starts[1:], len(rows)]):
            i = int(rows[s]) + lo
            j, d = cols[s:e], dist[s:e]
            order = np.argsort(d, kind="stable")
            out.append((i, int(j[order[0]])))
            roots, at = np.unique(root[j[order] + base], return_index=True)
            for r, k in zip(roots.tolist(), at.tolist()):
                if r != root[i]:
                    out.append((i, int(j[order[k]])))
                    low, high = min(r, root[i]), max(r, root[i])
                    root[root == high] = low
    return list(dict.fromkeys(out))


def links(nodes: DataFrame, lanes: int, radius: int, by_size: float | None = None) -> DataFrame:
    """(node long, fp binary, n_shingles long) to links (a long, b long) that join all fingerprints within the radius.

    A tile holds the fingerprints with equal population counts in each of BLOCKS parts (by_size None), or with sizes
    between two powers of `by_size`, for similarity of sets at least 1 / by_size. Two tiles whose counts differ by more
    than the radius in all, or whose sizes are not in neighbouring ranges, cannot hold a link and are never paired.
    """
    if by_size is None:
        if lanes != 1:
            raise ValueError("population-count tiles are for fingerprints of 64 bits")
        step, bits = 64 // BLOCKS, F.conv(F.hex("fp"), 16, -10).cast("long")
        part = [F.shiftrightunsigned(bits, k * step).bitwiseAND(F.lit((1 << step) - 1)) for k in range(BLOCKS)]
        tile = F.array(*[F.bit_count(x) for x in part])
        reach = _offsets(BLOCKS, radius)
    else:
        tile = F.array(F.floor(F.log(F.greatest(F.col("n_shingles"), F.lit(1))) / math.log(by_size)).cast("int"))
        reach = [[-1], [0], [1]]
    placed = nodes.select("node", "fp", tile.alias("tile"))
    # A cell is a bounded part of a tile: rows are dealt by hash, so a full tile is spread over several cells. There are
    # 17 ** 4 different tiles of population counts, and some dozens of sizes, so the table of the full ones is bounded.
    full = placed.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("cells")).where("cells > 1")
    cell = F.pmod(F.xxhash64("node"), F.coalesce("cells", F.lit(1))).alias("cell")
    dealt = placed.join(F.broadcast(full), "tile", "left").select("node", "fp", "tile", cell)
    # A node of one lane is its fingerprint; it is not shipped twice.
    row = F.col("node") if lanes == 1 else F.struct("node", "fp")
    cells = settle(dealt.groupBy("tile", "cell").agg(F.sort_array(F.collect_list(row)).alias("rows")))
    keys = cells.select("tile", "cell")
    offsets = F.explode(F.array(*[F.array(*[F.lit(x) for x in o]) for o in reach]))
    ahead = keys.select("tile", "cell", offsets.alias("o")).select(
        F.col("tile").alias("tile_a"), F.col("cell").alias("cell_a"), F.zip_with("tile", "o", lambda x, y: x + y).alias("tile_b")
    )
    other = keys.select(F.col("tile").alias("tile_b"), F.col("cell").alias("cell_b"))
    pairs = ahead.join(other, "tile_b").where("struct(tile_a, cell_a) <= struct(tile_b, cell_b)")
    left = cells.select(F.col("tile").alias("tile_a"), F.col("cell").alias("cell_a"), F.col("rows").alias("rows_a"))
    right = cells.select(F.col("tile").alias("tile_b"), F.col("cell").alias("cell_b"), F.col("rows").alias("rows_b"))
    work = (
        pairs.join(left, ["tile_a", "cell_a"])
        .join(right, ["tile_b", "cell_b"])
        .select(F.expr("struct(tile_a, cell_a) = struct(tile_b, cell_b)").alias("same"), "rows_a", "rows_b")
    )

    def unpack(cell: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        rows = cell.values
        if lanes == 1:
            node = rows.to_numpy(zero_copy_only=False)
            return node, node.astype(np.int64).view(np.uint64).reshape(-1, 1)
        fp = np.frombuffer(b"".join(rows.field("fp").to_pylist()), dtype=">u8").astype(np.uint64)
        return rows.field("node").to_numpy(zero_copy_only=False), fp.reshape(-1, lanes)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, ra, rb in zip(*(batch.column(k) for k in range(3))):
                na, fa = unpack(ra)
                nb, fb = unpack(rb)
                found = _linked(fa, fb, same.as_py(), radius)
                if found:
                    i, j = np.array(found).T
                    yield pa.RecordBatch.from_arrays([pa.array(na[i]), pa.array(nb[j])], ["a", "b"])

    return work.mapInArrow(compare, "a long, b long")


def _offsets(parts: int, radius: int) -> list[list[int]]:
    """All differences of population counts over the parts that add up to the radius at most."""
    out = [[]]
    for _ in range(parts):
        out = [[*o, x] for o in out for x in range(-radius, radius + 1) if sum(map(abs, o)) + abs(x) <= radius]
    return out


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    lanes: int = 4,
    radius: int = RADIUS,
    distinct: bool = True,
    min_similarity: float | None = 0.8,
) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text and any other columns).

    Fingerprints of 64 * lanes bits are taken over shingles of `width` words. Equal fingerprints are one node, so copies
    are never expanded. Nodes within `radius` bits are linked. With min_similarity a link also needs that Jaccard
    similarity of the two texts' shingle sets, measured on the whole texts, and tiles are ranges of set sizes; without
    it tiles are population counts. component_id is the least doc_id that a row reaches, its own included.

    Null or empty texts have no shingle and fingerprint zero, linked like any other (with min_similarity: only with each
    other). A null doc_id is kept and never chosen unless its whole component has none. Repeated rows stay. An empty
    table gives an empty result.
    """
    grouped = _grouped(docs, width, lanes, radius, distinct, min_similarity)
    return grouped.select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame, width: int, lanes: int, radius: int, distinct: bool, min_similarity: float | None) -> DataFrame:
    """doc_id, text_key, fp, component (the least node of the row's component) and component_id for every row of docs."""
    prints = settle(fingerprints(docs, width, lanes, distinct))
    node = F.conv(F.hex("fp"), 16, -10).cast("long") if lanes == 1 else F.xxhash64("fp")
    members = prints.withColumn("node", node)
    nodes = settle(
        members.groupBy("node", "fp").agg(
            F.min("doc_id").alias("doc_id"), F.min_by("text_key", F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("text_key"),
            F.max("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("_n"),
        )
    )
    if min_similarity is None:
        found = links(nodes, lanes, radius)
    else:
        found = _verified(docs, nodes, lanes, radius, width, min_similarity)
    roots = components(found)
    labelled = nodes.join(roots, "node", "left").select("node", "_n", "doc_id", F.coalesce("root", "node").alias("component"))
    labelled = settle(labelled)
    # A component may hold most nodes and a node most rows: both joins deal such keys.
    sizes = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    total, rows = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    named = spread_join(labelled.select("node", "component"), sizes.drop("_n"), sizes.drop("component_id"), "component", total, F.xxhash64("node"))
    counts = labelled.select("node", "_n")
    return spread_join(members, named, counts, "node", rows, F.xxhash64("doc_id", "text_key"))


def _similar(a: list[np.ndarray], b: list[np.ndarray] | None, share: float) -> list[tuple[int, int]]:
    """Links that join all sets of a and b (b None: of a) with at least that Jaccard similarity, without naming every pair.

    Every pair is measured unless links found before join its sets already.
    """
    n, right = len(a), a if b is None else b
    ids = np.unique(np.concatenate([*a, *(b or [])]), return_inverse=True)[1]
    ends_a, sizes = np.cumsum([len(x) for x in a]), np.array([len(x) for x in right])
    ids_b = ids if b is None else ids[ends_a[-1] :]
    starts = np.cumsum(sizes) - sizes
    root, base, out = np.arange(n if b is None else n + len(b)), 0 if b is None else n, []
    mark = np.zeros(int(ids.max()) + 1, dtype=np.int32)
    for i in range(n):
        upto = i if b is None else len(right)
        rest = np.flatnonzero(root[base : base + upto] != root[i])
        if not len(rest):
            continue
        mine = ids[ends_a[i] - len(a[i]) : ends_a[i]]
        mark[mine] = 1
        if 4 * len(rest) < upto:
            common = np.array([mark[ids_b[starts[j] : starts[j] + sizes[j]]].sum() for j in rest])
        else:
            end = starts[upto - 1] + sizes[upto - 1]
            common = np.add.reduceat(mark[ids_b[:end]], starts[:upto])[rest]
        mark[mine] = 0
        for j in rest[common >= (len(mine) + sizes[rest] - common) * share].tolist():
            if root[base + j] != root[i]:
                out.append((i, j))
                low, high = sorted((root[base + j], root[i]))
                root[root == high] = low
    return out


def _verified(docs: DataFrame, nodes: DataFrame, lanes: int, radius: int, width: int, share: float) -> DataFrame:
    """Links that join all nodes within reach whose texts' shingle sets have at least that Jaccard similarity.

    The links by bits only say which nodes may be alike: all pairs inside one of their components are measured, so a
    link that fails hides no other. A component is dealt to blocks of about BLOCK_SHINGLES shingles, and each pair of
    its blocks is measured on its own.
    """
    near = components(links(nodes.where("n_shingles > 0"), lanes, radius, by_size=1 / share))
    groups = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct())
    wanted = groups.join(nodes, "node").select("node", "root", "doc_id", "text_key", "n_shingles")
    wanted = settle(wanted)
    sizes = settle(wanted.groupBy("root").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).alias("cells"), F.count(F.lit(1)).alias("_n")))
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    dealt = spread_join(wanted, sizes.drop("_n"), sizes.drop("cells"), "root", total, F.xxhash64("node"))
    wanted = dealt.select("node", "root", "cells", F.col("doc_id").alias("_id"), "text_key", F.pmod(F.xxhash64("node"), "cells").alias("block"))
    # The text that gave the node its print, and no other with the same doc_id.
    own = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("text_key") == F.col("_text_key"))
    given = docs.select(F.col("doc_id").cast("long"), "text", _text_key().alias("_text_key"))
    texts = given.join(wanted, own)

    def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(_shingle_hashes(t.as_py(), width)).astype(np.uint64).view(np.int64) for t in batch.column(4)]
            names = ["root", "cells", "block", "node", "set"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sets, pa.list_(pa.int64()))], names)

    given = texts.select("root", "cells", "block", "node", "text")
    sets = given.mapInArrow(shingle_sets, "root long, cells long, block long, node long, set array<long>")
    sets = sets.groupBy("root", "cells", "block", "node").agg(F.first("set").alias("set"))
    blocks = settle(sets.groupBy("root", "cells", "block").agg(F.sort_array(F.collect_list(F.struct("node", "set"))).alias("rows")))

    def unpack(block: pa.Scalar) -> tuple[np.ndarray, list[np.ndarray]]:
        rows = block.values
        return rows.field("node").to_numpy(zero_copy_only=False), [x.values.to_numpy() for x in rows.field("set")]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in zip(*batch.columns):
                na, sa = unpack(rows[0])
                nb, sb = unpack(rows[1]) if len(rows) > 1 else (na, None)
                found = _similar(sa, sb, share)
                if found:
                    i, j = np.array(found).T
                    yield pa.RecordBatch.from_arrays([pa.array(na[i]), pa.array(nb[j])], ["a", "b"])

    inside = blocks.select("rows").mapInArrow(measure, "a long, b long")
    many = blocks.where("cells > 1")
    a = many.select("root", F.col("block").alias("block_a"), F.col("rows").alias("rows_a"))
    b = many.select("root", F.col("block").alias("block_b"), F.col("rows").alias("rows_b"))
    pairs = a.select("root", "block_a").join(b.select("root", "block_b"), "root").where("block_a < block_b")
    work = pairs.join(a, ["root", "block_a"]).join(b, ["root", "block_b"]).select("rows_a", "rows_b")
    return inside.unionByName(work.mapInArrow(measure, "a long, b long"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """One row of docs for each group of near duplicates: the one with the least doc_id; all columns stay as they are.

    Rows with a null doc_id stay, as they cannot be named. Rows that share a doc_id but not their text are documents of
    their own: each stays or goes with its group. Of equal doc_ids in one group the text with the least hash stays; of rows
    that share both, the one whose other columns come first as JSON. Texts are compared whole; an empty table gives no rows.
    """
    defaults = {"width": 5, "lanes": 4, "radius": RADIUS, "distinct": True, "min_similarity": 0.8}
    grouped = _grouped(docs, **(defaults | how)).where("doc_id = component_id")
    chosen = grouped.groupBy("component", "doc_id").agg(F.min("text_key").alias("text_key"))
    packed = docs.where("doc_id IS NOT NULL").select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), _text_key())
    kept = packed.join(chosen.select("doc_id", "text_key").distinct(), ["doc_id", "text_key"], "left_semi")
    rest = [F.col("doc")[c].alias(c) for c in docs.columns if c != "text"]
    order = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})
    once = kept.groupBy("doc_id", "text_key").agg(F.min_by("doc", order).alias("doc"))
    return once.select("doc.*").unionByName(docs.where("doc_id IS NULL"))
