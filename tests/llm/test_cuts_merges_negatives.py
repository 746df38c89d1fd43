"""Operators 11 to 13 against brute force and the library, and their edge cases."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lectern.llm import merges, middle, negatives
from lectern.llm.queries import QUERIES, tokenizer_file

# --- 11: fill in the middle ---

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")


def ends_of(text: str) -> list[int]:
    return np.cumsum([0, *(len(t) for t in TOKEN.findall(text))]).tolist()


SETS = [
    "", "a", "1", "a b", "é", "ab1\U0001d11ecd", "x" * 70_000, "." * 70_000, "ab " * 30_000, ("x" * 999 + " ") * 90, "a1b" * 25_000,
    "x" * 65_535 + "y", "x" * 65_536 + ".", "." + "x" * 65_535, "word " * 9_000 + "z" * 70_000 + "!" * 70_000,
]


@pytest.mark.parametrize("text", SETS)
def test_boundary_sets(text):
    want = ends_of(text)
    found = middle.BoundarySet(text)
    assert len(found) == len(want)
    places = {0, len(want) - 1, *range(0, len(want), max(1, len(want) // 500))}
    assert all(found.select(k) == want[k] for k in places)


def test_all_kinds_of_containers_are_used():
    kinds = {type(c) for text in SETS for c in middle.BoundarySet(text).containers}
    assert kinds == {middle.ArrayContainer, middle.BitmapContainer, middle.RunContainer}


def cut_by_hand(doc_id, text: str) -> tuple:
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(tokens), "plain", None, None, text
    form = "spm" if h[3] % 100 < 20 else "psm"
    return doc_id, len(tokens), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    texts = [*SETS, None, "a <P> b", "<S>", "x <M", "<<P>", "<P<S", "S>x<", "café\n日本 \U0001d11e x\ty", "a<" * 40, "<S" * 40]
    rows = [(i, t, "c", "c") for i, t in enumerate(texts * 4)] + [(None, "no id", "c", "c"), (3, "a b", "c", "c"), (3, "a b", "c", "c")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n string, cut string")
    found = middle.fill_in_middle(docs).withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    want = [(*cut_by_hand(i, t or ""), t or "") for i, t, *_ in rows]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert middle.fill_in_middle(docs.where("false")).collect() == []
    assert {r.form for r in middle.fill_in_middle(docs, rate=0).collect()} == {"plain"}


# --- 12: byte-level BPE ---


@pytest.fixture(scope="module")
def rank_file():
    return tokenizer_file("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder(rank_file):
    return merges.Encoder(rank_file, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.merges.ranks, special_tokens={})


def hard_texts() -> list[str]:
    rng = np.random.default_rng(2)
    letters = ["ab", "aab c", "etaoin ", "日本語のтекстé", "  \n\t a", "0123 45'sllre", "!?.<>|=-_", "\U0001d11éa "]
    made = ["".join(rng.choice(list(letters[k % 8]), int(rng.integers(1, 60)))) for k in range(800)]
    return made + ["a" * k for k in range(1, 120)] + ["".join(map(chr, range(a, a + 200))) for a in range(0, 0x3000, 200)]


def test_merges_equal_the_library(encoder, library, monkeypatch):
    texts = hard_texts()
    want = [library.encode_ordinary(t) for t in texts]
    for limits in ((1 << 22, 600_000, 8_000_000), (100, 50, 8_000_000), (1, 600_000, 100)):  # long texts, words forgotten
        for name, value in zip(("BLOCK", "REMEMBERED", "REMEMBERED_IDS"), limits):
            monkeypatch.setattr(merges, name, value)
        monkeypatch.setattr(merges, "MATCHES", 7)
        ids, counts = encoder.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_one_position_at_a_time_gives_the_same(encoder):
    words = [t.encode() for t in hard_texts()]
    at_once, by_one = encoder.merges.replay(words), encoder.merges.replay(words, one_by_one=True)
    assert all(np.array_equal(a, b) for a, b in zip(at_once, by_one))


def greedy(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        rank, k = min((ranks.get(a + b, 1 << 30), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 30:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[p] for p in parts]


def test_merges_of_any_ranks_equal_the_greedy_loop(tmp_path):
    """Rank files in which a pair may come out lower than the merge that made it."""
    import base64

    rng = np.random.default_rng(8)
    late = 0
    for trial in range(60):
        tokens = {bytes([b]) for b in range(256)}
        while len(tokens) < 256 + 24:
            tokens.add(bytes(rng.choice([97, 98, 99], int(rng.integers(2, 6))).tolist()))
        longer = [t for t in tokens if len(t) > 1]
        ordered = [bytes([b]) for b in range(256)] + [longer[k] for k in rng.permutation(len(longer))]
        path = tmp_path / f"ranks{trial}"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for r, t in enumerate(ordered)))
        made = merges.Merges(str(path))
        words = [bytes(rng.choice([97, 98, 99], int(rng.integers(1, 40))).tolist()) for _ in range(60)]
        ids, counts = made.replay(words)
        want = [greedy(w, made.ranks) for w in words]
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
        calls = []
        plain = made.replay
        made.replay = lambda ws, one_by_one=False: calls.append(one_by_one) or plain(ws, one_by_one)
        plain(words)
        late += any(calls)
    assert late  # such words do occur


def test_a_word_of_a_million_letters(encoder, library):
    word = "".join(np.random.default_rng(1).choice(list("etaoinshr"), 1_000_000))
    ids, _ = encoder.encode([word])
    assert encoder.merges.decode(ids) == word.encode()
    assert ids[:500].tolist() == library.encode_ordinary(word)[:500]


def test_byte_bpe_on_rows(spark, library, rank_file):
    texts = [None, "", "one", "one", "café ▁ 日本 \U0001d11e  x\n\ty", "<|endoftext|> a", "x" * 5000, " ".join(["word"] * 3000)]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(None, "no id", "c"), (2, "one", "c")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids string")
    found = merges.decode(merges.encode(docs, rank_file, public_tokenizers.PATTERN), rank_file).collect()
    want = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows]
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in found), key=repr) == sorted(want, key=repr)
    assert merges.encode(docs.where("false"), rank_file, public_tokenizers.PATTERN).collect() == []
    none = spark.createDataFrame([(1, None)], "doc_id int, ids array<int>")
    assert merges.decode(none, rank_file).first().decoded is None


def test_byte_bpe_query_equals_the_library(spark, sf, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op12_byte_bpe"](spark, sf).collect():
        ids = library.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


# --- 13: hard negatives ---


def mined_by_hand(rows: list[tuple], is_anchor) -> list[tuple]:
    kept = {(i, label, tuple(x)) for i, label, x in rows if None not in (i, label, x) and x and all(v is not None and np.isfinite(v) for v in x)}
    kept = [(i, label, [int(np.floor(256.0 * v)) for v in x]) for i, label, x in kept]
    out = []
    for i, label, x in kept:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j, m == label) for j, m, y in kept if j != i and len(y) == len(x))
        for p, positive, _ in [s for s in scored if s[2]][:5]:
            fits = [(s, j) for s, j, same in scored if not same and 80 * -p <= 100 * -s <= 100 * -p][:5]
            out += [(i, positive, rank, j, -p, -s) for rank, (s, j) in enumerate(fits, 1)]
    return sorted(out)


def clustered(seed: int, n: int, dim: int = 6) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.4, (5, dim))
    x = (centres[rng.integers(0, 5, n)] + rng.normal(0, 0.05, (n, dim))).astype(np.float32)
    return [(k, int(rng.integers(0, 4)), [float(v) for v in row]) for k, row in enumerate(x)]


def test_hard_negatives(spark, monkeypatch):
    rows = clustered(3, 500)
    rows += [(600 + k, k % 3, rows[7][2]) for k in range(40)]  # ties
    rows += rows[:20]  # repeats
    rows += [(700, None, rows[0][2]), (701, 1, None), (702, 1, []), (703, 1, [None] * 6), (704, 1, [float("nan")] * 6), (None, 1, rows[0][2])]
    rows += [(705, 1, [float("inf")] + [0.0] * 5), (706, 1, [0.0] * 6), (710, 2, [1.0, 2.0]), (711, 2, [1.0, 1.5]), (712, 1, [0.9, 2.0])]
    rows += [(720, 1, [3e9, 2.0, 0.0, 0.0, 0.0, 1.0])]  # its scores leave the doubles' whole numbers
    table = spark.createDataFrame(rows, "vec_id int, label int, embedding array<double>").withColumn("row", F.lit("c")).withColumn("x", F.lit(1))
    want = mined_by_hand(rows, lambda i: i % 10 == 0)
    assert len(want) > 500
    for limits in ((16_384, 256, 16_000_000), (60, 7, 16_000_000), (100, 9, 2_000)):  # one chunk; many chunks and blocks; many rounds
        for name, value in zip(("CHUNK_ROWS", "BLOCK_ANCHORS", "BROADCAST_BYTES"), limits):
            monkeypatch.setattr(negatives, name, value)
        found = negatives.hard_negatives(table, F.col("vec_id") % 10 == 0).collect()
        assert sorted(map(tuple, found)) == want
    assert negatives.hard_negatives(table.where("false"), F.col("vec_id") % 10 == 0).collect() == []
    assert negatives.hard_negatives(table, F.lit(False)).collect() == []


def test_bounds_save_work_and_lose_nothing():
    """On clustered vectors the tree's bounds leave out most candidates, and what they leave out is no answer."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 60, (12, 32))
    x = np.floor(centres[rng.integers(0, 12, 4000)] + rng.normal(0, 1, (4000, 32)))
    labels = rng.integers(0, 6, 4000)
    chunk = negatives.Chunk(np.arange(4000), labels, x)
    a = rng.choice(4000, 80, replace=False)
    block = {"ids": a, "labels": labels[a], "x": x[a], "tree": negatives.spanning_tree(x[a])}
    scored = 0
    for k, rows, _ in negatives.walk(chunk, block["x"], block["tree"], lambda k, lo, hi: hi >= negatives.kth(lo, 5)):
        scored += len(rows)
        assert set(np.argsort(-(x @ x[a[k]])[np.argsort(labels, kind="stable")], kind="stable")[:5]) <= set(rows)
    assert scored < 0.5 * 80 * 4000


def test_spanning_tree_is_least():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(40, 3))
    order, parent, length = negatives.spanning_tree(x)
    seen = set()
    for a in order.tolist():
        assert parent[a] < 0 or int(parent[a]) in seen
        seen.add(a)
    edges = sorted((float(np.linalg.norm(x[i] - x[j])), i, j) for i in range(40) for j in range(i))
    root, total = list(range(40)), 0.0
    for w, i, j in edges:
        if root[i] != root[j]:
            root, total = [root[i] if r == root[j] else r for r in root], total + w
    assert np.isclose(length.sum(), total)
