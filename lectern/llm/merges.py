"""Byte-level BPE by replaying merges over a block of words.

The words that are new to a task are laid end to end, one symbol a byte, with a border between words. An inverted index goes
from the rank of a pair's merge to the positions where the pair stands. The merges are applied in rank order, each at all its
positions at once; only the pairs that a merge touches are looked up and filed again. A rank that comes up again later (a
pair made by a merge of higher rank) is taken up at once, as the library does.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of texts whose new words are replayed together, and matches of one long text at a time.
BLOCK = 1 << 21
MATCHES = 1 << 18
#: Words, and ids of words, beyond which a worker forgets them and begins anew.
REMEMBERED = 400_000
REMEMBERED_IDS = 4_000_000
NONE = np.iinfo(np.int32).max


class Merges:
    """The merges of a rank file: every pair of tokens whose bytes together are a token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[p] for p in self.pairs.tolist()], np.int32)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        spelled = {rank: token for token, rank in self.ranks.items()}
        spelled = [spelled.get(rank, b"") for rank in range(max(spelled) + 1)]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(s) for s in spelled])])

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair merges to, or NONE. A border is -1 and merges with nothing."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], NONE).astype(np.int32)

    def replay(self, words: list[bytes], one_by_one: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of all words, end to end, and how many each word has. No word is empty.

        All positions of a rank are merged at once, from left to right where they overlap. Where this makes a pair of lower
        rank, which the library would merge before the next position of the word, the word is replayed again with one
        position of a word at a time (one_by_one).
        """
        sizes = np.array([len(w) for w in words], np.int64)
        border = np.concatenate([[0], np.cumsum(sizes + 1)])  # before each word, and at the end
        symbol = np.full(border[-1] + 1, -1, np.int32)
        inside = np.ones(len(symbol), bool)
        inside[border] = False
        symbol[inside] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, len(symbol) + 1), np.arange(-1, len(symbol) - 1)
        rank = np.full(len(symbol), NONE, np.int32)
        rank[:-1] = self.look_up(symbol[:-1], symbol[1:])
        index: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def file(at: np.ndarray) -> None:
            at = at[rank[at] != NONE]
            if not len(at):
                return
            at = at[np.argsort(rank[at], kind="stable")]
            cuts = np.flatnonzero(np.diff(rank[at])) + 1
            ends = [0, *cuts.tolist(), len(at)]
            for a, b, r in zip(ends, ends[1:], rank[at[ends[:-1]]].tolist()):
                if r not in index:
                    index[r] = []
                    heapq.heappush(waiting, r)
                index[r].append(at[a:b])

        file(np.arange(len(symbol)))
        again: set[int] = set()
        while waiting:
            r = heapq.heappop(waiting)
            found = index.pop(r)
            at = np.sort(np.concatenate(found))
            fresh = rank[at] == r  # what a merge has changed is filed elsewhere
            fresh[1:] &= at[1:] != at[:-1]
            at = at[fresh]
            if not len(at):
                continue
            if one_by_one:
                first = np.unique(np.searchsorted(border, at), return_index=True)[1]
                file(np.delete(at, first))
                at = at[first]
            else:
                joined = np.concatenate([[False], after[at[:-1]] == at[1:]])
                if joined.any():  # aaaa: every other position of a chain
                    place = np.arange(len(at))
                    at = at[(place - np.maximum.accumulate(np.where(joined, 0, place))) % 2 == 0]
            gone = after[at]
            if not one_by_one and (near := after[gone[:-1]] == at[1:]).any():  # the pair that stands until the next one merges
                between = self.look_up(np.full(int(near.sum()), r), symbol[at[1:][near]]) < r
                again.update((np.searchsorted(border, at[1:][near][between]) - 1).tolist())
            symbol[at], symbol[gone], rank[gone] = r, -1, NONE
            after[at] = after[gone]
            before[after[at]] = at
            left = before[at]
            apart = left != -1
            apart[1:] = left[1:] != at[:-1]  # a merged neighbour stands in `at` itself
            touched = np.concatenate([left[apart], at])
            rank[touched] = self.look_up(symbol[touched], symbol[after[touched]])
            file(touched)
            if not one_by_one and (early := rank[touched] < r).any():
                again.update((np.searchsorted(border, touched[early]) - 1).tolist())
        live = np.flatnonzero(symbol >= 0)
        ids, counts = symbol[live], np.diff(np.searchsorted(live, border))
        if again:
            redo = sorted(again)
            new, some = self.replay([words[w] for w in redo], one_by_one=True)
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for w, part in zip(redo, np.split(new, np.cumsum(some)[:-1])):
                parts[w] = part
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, counts

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of token ids."""
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.starts) - 1:
            raise ValueError("an id is not in the rank file")
        size = self.starts[ids + 1] - self.starts[ids]
        ends = np.cumsum(size)
        return self.spelled[np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - size), size)].tobytes()


class Encoder:
    """Merges, the pattern that cuts texts to words, and the words met so far: where each one's ids lie and how many they are."""

    def __init__(self, path: str, pattern: str):
        self.merges = Merges(path)
        self.pattern = regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def learn(self, words: list[str]) -> None:
        """Add words: those that are one token as such, all others replayed together."""
        spelled = [w.encode("utf-8", "surrogatepass") for w in words]
        whole = np.array([self.merges.ranks.get(s, -1) for s in spelled], np.int32)
        counts = np.ones(len(words), np.int64)
        other = np.flatnonzero(whole < 0)
        ids = whole
        if len(other):
            flat, counts[other] = self.merges.replay([spelled[k] for k in other.tolist()])
            ids = np.empty(int(counts.sum()), np.int32)
            replayed = np.repeat(whole < 0, counts)
            ids[replayed], ids[~replayed] = flat, whole[whole >= 0]
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])

    def cut(self, text: str) -> Iterator[list[str]]:
        """The words of a text, MATCHES at a time if it is long."""
        if len(text) <= BLOCK:
            yield self.pattern.findall(text)
            return
        matches = self.pattern.finditer(text)
        while some := [m.group() for m in islice(matches, MATCHES)]:
            yield some

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, end to end, and how many each word has."""
        if len(self.place) > REMEMBERED or len(self.ids) > REMEMBERED_IDS:
            self.forget()
        if new := [w for w in set(words) if w not in self.place]:
            self.learn(new)
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        starts, counts = self.ends[at], self.ends[at + 1] - self.ends[at]
        ends = np.cumsum(counts)
        return self.ids[np.arange(int(counts.sum())) + np.repeat(starts - (ends - counts), counts)], counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and how many each text has."""
        flat, numbers, words, parts, size = [], np.zeros(len(texts), np.int64), [], [], 0

        def flush() -> None:
            ids, counts = self.tokens(words)
            upto = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *(n for _, n in parts)])]
            np.add.at(numbers, [k for k, _ in parts], np.diff(upto))
            flat.append(ids)
            words.clear()
            parts.clear()

        for k, text in enumerate(texts):
            for some in self.cut(text):
                words += some
                parts.append((k, len(some)))
                size += min(len(text), BLOCK)
                if size >= BLOCK:
                    flush()
                    size = 0
        if parts:
            flush()
        return np.concatenate([np.zeros(0, np.int32), *flat]), numbers


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) per row of docs: the tokens of its whole text, as the library of the rank file gives them.

    Each match of pattern is encoded by itself, without special tokens. A word that is a token is that token; the other words
    that are new to a task are replayed together, block by block, and remembered. The words of a task, not of all
    documents, are the corpus that is replayed: ids then need no shuffle and no table that grows with the input. Null texts
    have no ids. Null doc_ids and repeated rows make no difference, further columns are ignored whatever their names, an empty
    table gives no rows. Long texts are cut to words 262,144 matches at a time; a word of any length is replayed whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(rank_file, pattern)
        for batch in batches:
            upto = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < batch.num_rows:  # about BLOCK code points at a time, a longer text alone
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + BLOCK, side="right")))
                some = batch.slice(lo, hi - lo)
                ids, counts = encoder.encode([t or "" for t in some.column(1).to_pylist()])
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([some.column(0), listed], ["doc_id", "ids"])
                lo = hi

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """(doc_id, ids, decoded binary) per row of encoded (doc_id, ids): the bytes of its ids. Null ids give null.

    An id that the rank file lacks fails the job. Further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _encoder(rank_file, "").merges
        for batch in batches:
            texts = [merges.decode(ids.values.to_numpy(zero_copy_only=False)) if ids.is_valid else None for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    given = encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))
    return given.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
