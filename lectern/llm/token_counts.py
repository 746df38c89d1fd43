"""Token counts by a compiled finite-state tokenizer.

The byte-level BPE tokenizer is compiled to two transducers. The boundary machine reads code-point classes and says where a
pre-token begins; its transitions carry the offsets of the boundaries they decide. A text is cut into chunks of equal length.
Every chunk is run from the start state, and from each other state only until both runs meet, which gives the chunk's map
from entry state to exit state. A prefix scan composes the maps, which fixes each chunk's entry state and with it all
boundaries.

The token machine reads the bytes of one pre-token. Its state behind a prefix is the last token of that prefix's encoding.
A transition reads one more token and emits one; it exists if the merge rules, applied to the two tokens' bytes together,
leave both as they are. Rules that build each token once, from tokens built before, make this exact: a row of tokens is an
encoding if all its neighbours are, and a prefix has one encoding, so one transition alone enters each place. No merge is
replayed, and a pre-token of any length takes a number of steps that is linear in its length. Whole pre-tokens are the
machine's paths from the start state; the Lexicon remembers their counts.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Code points in a chunk.
CHUNK = 512
#: Code points that are tokenized at a time; bounds a worker's memory.
BLOCK = 1 << 20
#: Pre-tokens, and transitions, that a worker remembers.
REMEMBERED = 400_000
#: Code points beyond which a pre-token is not remembered.
LONG = 256

# Classes of code points. Letters that end a contraction have their own.
LETTER, NUMBER, OTHER, SPACE, WHITE, APOSTROPHE = range(6)
_TAILS = {c: 6 + k for k, c in enumerate("stmdrevl")}
CUT = 6 + len(_TAILS)  # stands between two texts: the machine starts anew behind it
CLASSES = CUT + 1
# States: what the open pre-token is. AP: an apostrophe that may begin a contraction; APR, APV, APL: with its next letter.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_SPACE, ONE_WHITE, SPACES, WHITES, AP, APR, APV, APL, DONE = range(13)
STATES = 13


def boundary_machine() -> tuple[np.ndarray, np.ndarray]:
    """next[state, class], and emitted[state, class]: bit k set means that a pre-token begins k code points back.

    It is the machine of  's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^ws L N]+|ws+(?!non-ws)|ws+ .
    """
    nxt, emit = np.zeros((STATES, CLASSES), np.uint8), np.zeros((STATES, CLASSES), np.uint8)
    tails = {v: k for k, v in _TAILS.items()}
    for s in range(STATES):  # a started contraction that did not end leaves its letter alone
        nxt[s, CUT], emit[s, CUT] = START, 2 if s in (APR, APV, APL) else 0
    for c in range(CUT):
        kind = LETTER if c in tails else c
        fresh = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, APOSTROPHE: AP, SPACE: ONE_SPACE, WHITE: ONE_WHITE}
        joined = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, APOSTROPHE: IN_OTHERS}  # after one space
        blank = kind in (SPACE, WHITE)
        for s in range(STATES):
            to, out = fresh[kind], 1
            if s == IN_LETTERS and kind == LETTER or s == IN_NUMBERS and kind == NUMBER:
                to, out = s, 0
            elif s in (IN_OTHERS, AP) and kind in (OTHER, APOSTROPHE):
                to, out = IN_OTHERS, 0
            elif s == AP and c in tails:
                t = tails[c]
                to, out = (DONE, 0) if t in "stmd" else ({"r": APR, "v": APV, "l": APL}.get(t), 0)
                if to is None:
                    to, out = IN_LETTERS, 1
            elif s in (APR, APV, APL):
                whole = tails.get(c) == {APR: "e", APV: "e", APL: "l"}[s]
                if whole:
                    to, out = DONE, 0
                elif kind == LETTER:
                    to, out = IN_LETTERS, 2  # the apostrophe stands alone, the letters begin one back
                else:
                    out = 1 | 2
            elif s in (ONE_SPACE, ONE_WHITE, SPACES, WHITES):
                if blank:
                    to, out = (SPACES if kind == SPACE else WHITES), 0
                elif s == ONE_SPACE:
                    to, out = joined[kind], 0
                elif s == SPACES:
                    to, out = joined[kind], 2  # the last space goes with what follows
                elif s == WHITES:
                    out = 1 | 2  # the last white space stands alone
            nxt[s, c], emit[s, c] = to, out
    return nxt, emit


NEXT, EMIT = boundary_machine()


@lru_cache(maxsize=2)
def class_table(path: str) -> np.ndarray:
    """Class of every code point, as the library's own pre-tokenizer treats it.

    Planes 4 to 16 have no letters, numbers or white space and are not asked about.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    table = np.full(0x110000, OTHER, np.uint8)
    points = [p for p in range(0x40000) if not 0xD800 <= p < 0xE000]
    for at in range(0, len(points), 1 << 15):
        part = points[at : at + (1 << 15)]
        text = "".join(f"!a{chr(p)}1" for p in part)
        starts = np.zeros(4 * len(part) + 1, bool)
        starts[[s for _, (s, _) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]] = True
        mark = starts[:-1].reshape(-1, 4)
        letter, number = ~mark[:, 2], mark[:, 2] & ~mark[:, 3]
        kinds = np.where(letter, LETTER, np.where(number, NUMBER, OTHER)).astype(np.uint8)
        table[part] = kinds
    for p in points:  # white space is never joined with what stands before it; few points can be
        if table[p] == OTHER and chr(p).isspace():
            cut = [s for _, (s, _) in tokenizer.pre_tokenizer.pre_tokenize_str(f"!{chr(p)}{chr(p)}!")]
            table[p] = WHITE if cut == [0, 1, 2, 3] or p == 0x20 else OTHER
    table[0x20], table[ord("'")] = SPACE, APOSTROPHE
    for c, k in _TAILS.items():
        table[ord(c)] = k
    return table


def boundaries(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Where pre-tokens begin, for the classes of texts with CUT behind each."""
    n = len(classes)
    if not n:
        return np.zeros(0, bool)
    rows = -(-n // chunk)
    padded = np.zeros(rows * chunk, np.uint8)
    padded[:n] = classes
    grid = padded.reshape(rows, chunk).T.copy()  # one column a chunk: a step reads a row
    states = np.zeros((chunk + 1, rows), np.uint8)
    flat_next, flat_emit = NEXT.ravel(), EMIT.ravel()
    for j in range(chunk):
        states[j + 1] = flat_next[states[j].astype(np.intp) * CLASSES + grid[j]]
    # Exit state for each entry state: as from the start state once the runs have met.
    exits = np.repeat(states[-1][None, :], STATES, axis=0)
    for s in range(1, STATES):
        lane, now = np.arange(rows), np.full(rows, s, np.uint8)
        for j in range(chunk):
            now = flat_next[now.astype(np.intp) * CLASSES + grid[j, lane]]
            apart = now != states[j + 1, lane]
            lane, now = lane[apart], now[apart]
            if not len(lane):
                break
        exits[s, lane] = now
    entry = _scan(exits)
    # The true runs differ from those of the start state up to the meeting point only.
    lane = np.flatnonzero(entry != START)
    now = entry[lane]
    for j in range(chunk):
        if not len(lane):
            break
        states[j, lane] = now
        now = flat_next[now.astype(np.intp) * CLASSES + grid[j, lane]]
        apart = now != states[j + 1, lane]
        lane, now = lane[apart], now[apart]
    if len(lane):
        states[chunk, lane] = now
    before = states[:-1].T.reshape(-1)[:n]
    out = flat_emit[before.astype(np.intp) * CLASSES + classes]
    mark = (out & 1).astype(bool)
    mark[:-1] |= (out[1:] & 2).astype(bool)
    return mark


def _scan(exits: np.ndarray) -> np.ndarray:
    """Entry state of each chunk: an exclusive prefix scan over the composition of the chunks' state maps."""
    rows = exits.shape[1]
    maps, step = exits.copy(), 1
    while step < rows:  # after each round a map spans twice as many chunks
        maps[:, step:] = np.take_along_axis(maps[:, step:], maps[:, :-step].astype(np.intp), axis=0)
        step *= 2
    return np.concatenate([[START], maps[START, :-1]]).astype(np.uint8)


class TokenMachine:
    """Transducer over the bytes of a pre-token: states are tokens, each transition emits one token.

    Tokens are numbered: bytes by their value, merged ones by 256 + rank. A token that the rules never leave whole has no
    transition into it.
    """

    def __init__(self, merges: list, to_bytes: dict[str, int]):
        parts = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        known = dict(to_bytes)
        self.left, self.right = list(range(256)), list(range(256))
        #: Rank of the rule that builds a token of two others.
        self.ranks: dict[tuple[int, int], int] = {}
        spelled = [bytes([b]) for b in range(256)]
        for r, (a, b) in enumerate(parts):
            if a not in known or b not in known or a + b in known:
                raise ValueError(f"merge {r} must build a new token from tokens built before")
            x, y = known[a], known[b]
            known[a + b] = 256 + r
            self.ranks[x, y] = r
            self.left.append(x)
            self.right.append(y)
            spelled.append(spelled[x] + spelled[y])
        whole = [True] * 256
        for r, (x, y) in enumerate(zip(self.left[256:], self.right[256:])):
            whole.append(whole[x] and whole[y] and self.stay(x, y, r, r - 1))
        #: Transitions that were asked for: state and token to whether there is one.
        self.seen: dict[int, bool] = {}
        # Tokens by their bytes, as a tree: (node, byte) to node, and the token that ends at a node.
        self.step: dict[int, int] = {}
        self.token = [-1]
        for t, data in enumerate(spelled):
            node = 0
            for c in data:
                to = self.step.get(node << 8 | c)
                if to is None:
                    to = self.step[node << 8 | c] = len(self.token)
                    self.token.append(-1)
                node = to
            if whole[t]:
                self.token[node] = t

    def stay(self, x: int, y: int, x_until: int = 1 << 40, y_until: int = 1 << 40) -> bool:
        """Whether no rule merges across the border of two tokens that are built side by side.

        Goes back in time: the pair at the border is x, y from when the later of them was built until a rule takes one of
        them into a larger token. Of equal rules the one further left is applied first.
        """
        left, right, rank = self.left, self.right, self.ranks.get
        while True:
            r = rank((x, y))
            if r is not None and r < x_until and r <= y_until:
                return False
            if x > y and x > 255:
                x_until, x = x - 256, right[x]
            elif y > 255:
                y_until, y = y - 256, left[y]
            else:
                return True

    def count(self, data: bytes) -> int:
        """Tokens that the machine emits over the bytes of one pre-token."""
        n, step, token, stay, known = len(data), self.step.get, self.token, self.stay, self.seen.get
        state, emitted = array("i", [-1]) * (n + 1), array("i", [0]) * (n + 1)
        for i in range(n):
            node, last, out = 0, state[i], emitted[i] + 1
            for j in range(i, n):
                node = step(node << 8 | data[j])
                if node is None:
                    break
                t = token[node]
                if t >= 0 and state[j + 1] < 0:
                    if i and (may := known(last << 32 | t)) is None:
                        if len(self.seen) >= REMEMBERED:
                            self.seen.clear()
                        may = self.seen[last << 32 | t] = stay(last, t)
                    if not i or may:
                        state[j + 1], emitted[j + 1] = t, out
        return emitted[n]


class Lexicon(dict):
    """Pre-token to the number of tokens that the machine emits over it: paths from the start state that were run before."""

    def __init__(self, merges: list, to_bytes: dict[str, int]):
        super().__init__()
        self.machine = TokenMachine(merges, to_bytes)

    def __missing__(self, pretoken: str) -> int:
        n = self.machine.count(pretoken.encode("utf-8", "surrogatepass"))
        if len(pretoken) > LONG:
            return n
        if len(self) >= REMEMBERED:
            self.clear()
        self[pretoken] = n
        return n


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable bytes stand for themselves, the rest follow from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _lexicon(path: str) -> tuple[Lexicon, tuple[str, ...]]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = tuple(t["content"] for t in spec["added_tokens"])
    return Lexicon(spec["model"]["merges"], byte_letters()), special


def count_texts(texts: list[str], classes: np.ndarray, lexicon: Lexicon, special: tuple[str, ...]) -> list[int]:
    """Tokens of whole texts, run through the machine together. A special string is its one token and cuts the text."""
    counts, pieces, owner = [0] * len(texts), [], []
    for k, text in enumerate(texts):
        cut = [text]
        for s in special:
            parts = [p.split(s) for p in cut]
            counts[k] += sum(len(x) - 1 for x in parts)
            cut = [x for part in parts for x in part]
        pieces += cut
        owner += [k] * len(cut)
    joined = "\n".join([*pieces, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = classes[points]
    ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
    kinds[ends] = CUT
    mark = boundaries(kinds)
    mark[ends] = True
    at = np.flatnonzero(mark)
    lengths = np.where(kinds[at[:-1]] == CUT, 0, 1)
    number = list(map(lexicon.__getitem__, [joined[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]))
    total = np.concatenate([[0], np.cumsum(np.array(number, np.int64) * lengths)])
    upto = total[np.searchsorted(at, ends)]  # tokens that end at each piece's end
    for k, n in zip(owner, np.diff(upto, prepend=0).tolist()):
        counts[k] += n
    return counts


def _blocks(texts: list[str], most: int) -> Iterator[list[str]]:
    """Runs of texts of about `most` code points, a longer text alone."""
    block, size = [], 0
    for t in texts:
        if block and size + len(t) > most:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield block


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of docs, over whole texts.

    Counts are those of the library for a byte-level BPE file, without begin, end or added special tokens; a special
    string inside a text is its one token, as by the library's default. Null texts count as empty: no bytes, no tokens.
    Null doc_ids, repeated rows and further columns of docs make no difference; an empty table gives an empty table. Texts
    of a batch are run through the boundary machine together, separated by the start state, so short texts cost no more
    than long ones. A very long text is a block of its own, in memory some 30 bytes a code point.
    """
    classes = class_table(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, special = _lexicon(tokenizer_path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            whole = [t or "" for t in texts.to_pylist()]
            counts = [c for block in _blocks(whole, BLOCK) for c in count_texts(block, classes, lexicon, special)]
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in whole]
            n = pa.array(counts, pa.int64())
            over = pa.array([c > limit for c in counts], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), n, over], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    given = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    return given.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
