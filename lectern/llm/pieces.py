"""Sampled SentencePiece encoding: forward filtering, backward sampling over the piece lattice; lossless decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sharpness of the weights of pieces; larger values come nearer to the one best segmentation.
THETA = 0.3
#: Segments whose lattices a worker keeps, and code points that are sampled at a time.
KEPT = 200_000
BLOCK = 1 << 19
#: Segments whose lattices are made at a time, which bounds what that takes besides.
NEW = 30_000
#: Bits of a chance, and of a code point in a key.
_CHANCE_BITS, _CHAR_BITS = 36, 21
_SEGMENT = re.compile(r" *[^ ]+| +")
_GOLDEN, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(z: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a counter becomes 64 random bits."""
    z = (z ^ (z >> np.uint64(30))) * _MIX1
    z = (z ^ (z >> np.uint64(27))) * _MIX2
    return z ^ (z >> np.uint64(31))


class Pieces:
    """A SentencePiece model's pieces with the weight of each, and its byte pieces for what no piece spells.

    The model's blank (U+2581) is a space here, so a text's own U+2581 is spelled in bytes and stays apart. No piece has
    a blank behind another character, so lattices of segments (blanks, then the rest up to the next blank) are
    independent and a text's lattice is their chain.
    """

    def __init__(self, path: str, theta: float = THETA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes = {}
        self.spelled: dict[int, bytes] = {}
        self.weight: dict[str, tuple[int, float]] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.spelled[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = piece.replace("▁", " ")
                # Scores are ranks of merges, the more frequent the nearer to zero: weights fall with the rank.
                rank = max(0.0, -model.get_score(i)) if model.get_score(i) > -1e8 else float(n)
                self.weight[text] = (i, (rank + 2.0) ** -theta)
                self.spelled[i] = text.encode("utf-8")
        self.rare = (2.0 * n) ** -theta
        each = [self.spelled.get(i, b"") for i in range(n)]
        #: The pieces' bytes end to end, and where each begins.
        self.table = np.frombuffer(b"".join(each), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        self.first_char_code = n  # an emission of n + c spells code point c in bytes
        self.longest = max(map(len, self.weight))
        if any(" " in p.lstrip(" ") for p in self.weight):
            raise ValueError("a piece has a blank behind another character")
        self._trie()

    def _trie(self) -> None:
        """The pieces as a trie: sorted (state, code point) keys, the states they lead to, and the pieces that end there."""
        steps: dict[tuple[int, int], int] = {}
        ends: dict[int, str] = {}
        for text in self.weight:
            state = 0
            for c in text:
                state = steps.setdefault((state, ord(c)), len(steps) + 1)
            ends[state] = text
        keys = sorted((s << _CHAR_BITS | c, to) for (s, c), to in steps.items())
        self.keys, self.to = (np.array(x, np.int64) for x in zip(*keys))
        #: The first step, from the root, by code point; -1 where no piece begins so.
        self.first_step = np.full(max(c for s, c in steps if not s) + 2, -1, np.int64)
        for (state, c), to in steps.items():
            if not state:
                self.first_step[c] = to
        self.piece_at = np.full(len(steps) + 1, -1, np.int64)
        self.weight_at = np.zeros(len(steps) + 1)
        for state, text in ends.items():
            self.piece_at[state], self.weight_at[state] = self.weight[text]

    def edges(self, points: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
        """All pieces in texts laid end to end: (position, length, emission, weight), by end position, then position.

        left: for each position how many code points its text has from there on.
        """
        at, state = np.arange(len(points)), np.zeros(len(points), np.int64)
        found: list[tuple[np.ndarray, ...]] = []
        for d in range(self.longest):
            going = left[at] > d
            at, state = at[going], state[going]
            if not d:
                step = self.first_step[np.minimum(points, len(self.first_step) - 1)]
                known = step >= 0
                at, state = at[known], step[known]
            else:
                key = state << _CHAR_BITS | points[at + d]
                k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                known = self.keys[k] == key
                at, state = at[known], self.to[k[known]]
            whole = self.piece_at[state] >= 0
            found.append((at[whole], np.full(int(whole.sum()), d + 1), self.piece_at[state[whole]], self.weight_at[state[whole]]))
            if not d:  # a character that is no piece is spelled
                odd = np.ones(len(points), bool)
                odd[at[whole]] = False
                odd = np.flatnonzero(odd)
                found.append((odd, np.ones(len(odd), np.int64), points[odd] + self.first_char_code, np.full(len(odd), self.rare)))
        pos, size, emit, weight = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((pos, pos + size))
        return pos[order], size[order], emit[order], weight[order]


class Sampler:
    """Lattices of the segments met so far, as arrays over all their nodes, and sampling over them."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._clear()

    def _clear(self) -> None:
        self.end_of: dict[str, int] = {}
        self.nodes = self.edges = 0
        #: By edge, sorted by end node: cumulated chance within the node, where it comes from, and its emission; and for
        #: each node its first edge.
        self.upto = np.zeros(0, np.int64)
        self.prev = np.zeros(0, np.int32)
        self.emit = np.zeros(0, np.int32)
        self.first = np.zeros(0, np.int32)

    def _add(self, segments: list[str]) -> tuple[np.ndarray, ...]:
        """Forward filtering of new segments, all of them at once: at each node the chance of each piece that ends there.

        Returns what they add to first, upto, prev and emit.

        A chance depends on its segment only, and is kept as a whole number of 2 ** -_CHANCE_BITS.
        """
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        first = np.cumsum(size) - size
        points = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(segments)), size)
        inside = np.arange(len(points)) - first[owner]
        pos, length, emit, weight = self.pieces.edges(points, size[owner] - inside)
        # Nodes: one before each character and one at the end of each segment.
        start = pos + owner[pos]
        end = start + length
        depth = inside[pos] + length
        head = np.flatnonzero(np.diff(end, prepend=-1))  # the first edge into each node
        rank = np.arange(len(end)) - np.repeat(head, np.diff(head, append=len(end)))
        alpha = np.ones(len(points) + len(segments))
        chance = np.empty(len(end))
        by_depth = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[by_depth], np.arange(1, int(size.max()) + 2))
        for j in range(1, int(size.max()) + 1):
            e = by_depth[cuts[j - 1] : cuts[j]]
            new = np.flatnonzero(rank[e] == 0)
            which = np.repeat(np.arange(len(new)), np.diff(new, append=len(e)))
            part = alpha[start[e]] * weight[e]
            upto, total = np.empty(len(e)), np.zeros(len(new))
            live, r = np.arange(len(e)), 0
            while len(live):  # edge after edge of each node, so that sums do not depend on what else is at hand
                now = live[rank[e[live]] == r]
                total[which[now]] += part[now]
                upto[now] = total[which[now]]
                live, r = live[rank[e[live]] > r], r + 1
            chance[e] = upto / total[which]
            nodes = end[e[new]]
            alpha[nodes] = total
            if j % 16 == 0:  # only ratios count: lift the nodes that a piece can still start from
                for k in range(min(j, self.pieces.longest)):
                    alpha[nodes - k - 1] /= total
                alpha[nodes] = 1.0
        last = np.append(head[1:] - 1, len(end) - 1)
        whole = np.floor(chance * (1 << _CHANCE_BITS)).astype(np.int64)
        whole[last] = 1 << _CHANCE_BITS
        first_edge = np.zeros(len(alpha), np.int32)
        first_edge[end[head]] = head + self.edges
        self.edges += len(end)
        made = first_edge, whole, (start + self.nodes).astype(np.int32), emit.astype(np.int32)
        ends = first + size + np.arange(len(segments)) + self.nodes
        self.end_of.update(zip(segments, ends.tolist()))
        self.nodes += len(alpha)
        return made

    def ends(self, segments: list[str]) -> np.ndarray:
        """End node of each segment."""
        if len(self.end_of) > KEPT:
            self._clear()
        new = list({s: None for s in segments if s not in self.end_of})
        if new:
            made = [self._add(new[k : k + NEW]) for k in range(0, len(new), NEW)]
            kept = self.first, self.upto, self.prev, self.emit
            self.first, self.upto, self.prev, self.emit = (np.concatenate(x) for x in zip(kept, *made))
        return np.fromiter(map(self.end_of.__getitem__, segments), np.int64, len(segments))

    def sample(self, segments: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Emissions of all segments one after the other, and how many each has. keys: 64 random bits a segment."""
        at = self.ends(segments)
        stop = at - np.fromiter(map(len, segments), np.int64, len(segments))
        who, live = np.arange(len(segments)), at
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        counts = np.zeros(len(segments), np.int64)
        t = 0
        while len(who):
            u = (_mix(keys[who] + _GOLDEN * np.uint64(t + 1)) >> np.uint64(64 - _CHANCE_BITS)).astype(np.int64)
            edge = self.first[live]
            over = np.flatnonzero(self.upto[edge] <= u)
            while len(over):  # nodes have few edges, so steps from the first are nearer than a search among all
                edge[over] += 1
                over = over[self.upto[edge[over]] <= u[over]]
            steps.append((who, self.emit[edge]))
            counts[who] += 1
            live = self.prev[edge].astype(np.int64)
            going = live != stop[who]
            who, live = who[going], live[going]
            t += 1
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        for back, (who, emitted) in enumerate(steps):  # the first piece sampled is a segment's last
            out[ends[who] - 1 - back] = emitted
        return out, counts

    def expand(self, emitted: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids, with spelled characters as byte pieces, and how many each segment has."""
        odd = np.flatnonzero(emitted >= self.pieces.first_char_code)
        if not len(odd):
            return emitted.astype(np.int32), counts
        spelled = [chr(e - self.pieces.first_char_code).encode("utf-8", "surrogatepass") for e in emitted[odd].tolist()]
        width = np.ones(len(emitted), np.int64)
        width[odd] = [len(s) for s in spelled]
        out = np.repeat(emitted, width)
        starts = np.cumsum(width) - width
        for k, s in zip(starts[odd].tolist(), spelled):
            out[k : k + len(s)] = [self.pieces.bytes[b] for b in s]
        owner = np.repeat(np.arange(len(counts)), counts)
        return out.astype(np.int32), np.bincount(owner, weights=width, minlength=len(counts)).astype(np.int64)


def encode_texts(texts: list[str], seeds: np.ndarray, sampler: Sampler) -> list[np.ndarray]:
    """Piece ids of each text. A segment's random bits depend on its text's seed and its place in the text only."""
    segments: list[str] = []
    sizes = []
    for t in texts:
        cut = _SEGMENT.findall(" " + t) if t else []
        segments += cut
        sizes.append(len(cut))
    sizes = np.array(sizes, np.int64)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(segments), dtype=np.int64) - np.repeat(first, sizes)
    keys = _mix(np.repeat(seeds, sizes) ^ _mix(place.astype(np.uint64) * _GOLDEN + np.uint64(1)))
    ids, counts = sampler.expand(*sampler.sample(segments, keys))
    upto = np.concatenate([[0], np.cumsum(counts)])
    cuts = upto[np.concatenate([first, [len(segments)]])]
    return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def lossless(flat: np.ndarray, sizes: np.ndarray, texts: list[str], table: tuple[np.ndarray, np.ndarray]) -> list[bool]:
    """Whether the ids of each text, laid end to end, decode to it. table: the bytes of all pieces and where each begins."""
    data, starts = table
    length = (starts[1:] - starts[:-1])[flat]
    ends = np.cumsum(length)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[flat] - (ends - length), length)
    decoded = data[at].tobytes()
    wanted = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    if decoded == b"".join(wanted):
        return [True] * len(texts)
    cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    return [decoded[a:b] == w for a, b, w in zip(cuts, cuts[1:], wanted)]


def decode_ids(ids, spelled: dict[int, bytes]) -> str:
    """The text of piece ids: pieces joined, without the blank that encoding puts in front."""
    return b"".join([spelled[i] for i in ids]).decode("utf-8", "surrogatepass")[1:]


@lru_cache(maxsize=2)
def _sampler(path: str, theta: float) -> Sampler:
    return Sampler(Pieces(path, theta))


def row_seeds(ids: pa.Array, seed: int) -> np.ndarray:
    """64 bits for each row key; null keys share one."""
    keys = np.array([0x5EED if i is None else i & 0xFFFFFFFFFFFFFFFF for i in ids.to_pylist()], np.uint64)
    return _mix(_mix(keys + _GOLDEN) ^ np.uint64(seed & 0xFFFFFFFFFFFFFFFF))


def encode(docs: DataFrame, model_path: str, seed: int = 7, theta: float = THETA) -> DataFrame:
    """(doc_id, ids array<int>, n_pieces, n_chars, lossless) per row of docs: a segmentation sampled for its doc_id and seed.

    A segmentation's chance is the product of its pieces' weights over the sum for all segmentations of the text; it is
    drawn exactly, by filtering forward and sampling backward. The same doc_id, text, model and seed give the same ids on
    any cluster. The ids are decoded again; lossless says whether the text came back. Null and empty texts have no ids. Rows
    with a null doc_id share a seed; repeated rows get equal ids. Further columns are ignored, whatever their names; an empty
    table gives no rows. Whole texts are encoded; a segment without blanks takes a step for each of its characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(model_path, theta)
        with np.errstate(over="ignore"):
            for batch in batches:
                column, seeds = batch.column(1), row_seeds(batch.column(0), seed)
                upto = np.cumsum(pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
                lo = 0
                while lo < batch.num_rows:  # about BLOCK code points at a time, a longer text alone
                    before = upto[lo - 1] if lo else 0
                    hi = max(lo + 1, int(np.searchsorted(upto, before + BLOCK, side="right")))
                    texts = [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
                    ids = encode_texts(texts, seeds[lo:hi], sampler)
                    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
                    chars = pa.array([len(t) for t in texts], pa.int64())
                    back = pa.array(lossless(flat, sizes, texts, sampler.pieces.table), pa.bool_())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(lo, hi - lo), lists, pa.array(sizes), chars, back],
                        ["doc_id", "ids", "n_pieces", "n_chars", "lossless"],
                    )
                    lo = hi

    given = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    return given.mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, n_chars long, lossless boolean")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of encoded rows (doc_id, ids and any other columns). Null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = _sampler(model_path, THETA).pieces.spelled
        for batch in batches:
            texts = [None if ids is None else decode_ids(ids, spelled) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
