"""Alignment of versions: anchors, chains and gaps against the matcher run over whole texts."""

from __future__ import annotations

import difflib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import revisions

COLS = "doc_id long, pos int, unit_id string, text string"


def whole(old: list[str], new: list[str]) -> list[tuple]:
    """(old place, new place, kind, at) of every old line, by one matcher over the whole text."""
    rows = []
    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        free = set(range(j1, j2)) if op == "replace" else set()
        for i in range(i1, i2):
            if op == "equal":
                rows.append((i, j1 + i - i1, "same", j1 + i - i1))
                continue
            best, score = None, revisions.ALIKE
            for j in sorted(free, key=lambda j: (abs(j - j1 - i + i1), j))[: revisions.NEAREST]:
                ratio = difflib.SequenceMatcher(None, old[i], new[j], autojunk=False).ratio()
                if ratio > score:
                    best, score = j, ratio
            free.discard(best)
            rows.append((i, best, "near" if best is not None else None, j1))
    return rows


def edited(rng: random.Random, n: int) -> tuple[list[str], list[str]]:
    """Numbered lines, and what is left of them after edits, drops and lines put in."""
    old = [f"{k} {rng.choice(['grain', 'stone', 'river', 'cloud'])} {rng.random():.6f}" for k in range(n)]
    new = []
    for k, line in enumerate(old):
        x = rng.random()
        new += [] if x < 0.12 else [line + " edited"] if x < 0.3 else [line, f"put in {k}"] if x < 0.4 else [line]
    return old, new


def frame(spark, texts: dict[int, list[str]], unit: str):
    return spark.createDataFrame([(d, p, f"{unit}{p}", x) for d, lines in texts.items() for p, x in enumerate(lines)], COLS)


def test_gaps_align_as_the_whole_text_does(spark):
    rng = random.Random(3)
    pairs = {d: edited(rng, n) for d, n in enumerate([0, 1, 2, 5, 17, 40, 40, 60, 90])}
    pairs[20] = (["only old", "x"], [])
    pairs[21] = ([], ["only new"])
    pairs[22] = (["same", "same", "a", "same"], ["same", "a", "same", "same"])
    old, new = (frame(spark, {d: p[k] for d, p in pairs.items()}, "uv"[k]) for k in (0, 1))
    found = {}
    for r in revisions.align_units(old, new).collect():
        found.setdefault(r.doc_id, []).append((int(r.old_id[1:]), r.new_id and int(r.new_id[1:]), r.kind, r.at))
    assert {d: sorted(rows) for d, rows in found.items()} == {d: sorted(whole(*p)) for d, p in pairs.items() if p[0]}


def test_edits_come_in_order_and_rebuild_the_new_text(spark):
    rng = random.Random(5)
    pairs = {d: edited(rng, 30) for d in range(6)}
    old, new = (frame(spark, {d: p[k] for d, p in pairs.items()}, "u").drop("unit_id") for k in (0, 1))
    found = {}
    for r in revisions.edit_places(old, new).collect():
        found.setdefault(r.doc_id, []).append((r.pos, r.was, r.now))
    for d, (a, b) in pairs.items():
        want = []
        for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            if op != "equal":
                want += revisions._word_places(list(enumerate(a))[i1:i2], list(enumerate(b))[j1:j2], 1_000_000)
        assert sorted(found.get(d, [])) == sorted(want)


def test_heaviest_chain():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(0, 8)
        js = rng.sample(range(20), n)
        blocks = [(1, i, j, rng.randint(1, 4)) for i, j in enumerate(js)]
        best = max(sum(b[3] for b in c) for k in range(n + 1) for c in itertools.combinations(blocks, k) if [b[2] for b in c] == sorted(b[2] for b in c))
        chain = revisions._chain(blocks)
        assert sum(b[3] for b in chain) == best
        assert [b[1:3] for b in chain] == sorted(b[1:3] for b in chain) and [b[2] for b in chain] == sorted(b[2] for b in chain)


def test_a_document_of_a_hundred_thousand_units(spark):
    """No group holds more than GAP_UNITS of a side, though one stretch is rewritten and another moved."""
    n = 100_000
    lines = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("pos"), F.concat(F.lit("u"), "id").alias("unit_id"), F.concat(F.lit("line "), "id").alias("text"))
    p = F.col("pos")
    moved = F.when(p < 500, p + n).otherwise(p)
    rewritten = (p >= 40_000) & (p < 46_000)
    text = F.when(rewritten, F.concat(F.lit("quite other words "), p * 7)).when(p % 1000 == 999, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    new = lines.select("doc_id", moved.alias("pos"), F.concat(F.lit("v"), p).alias("unit_id"), text.alias("text"))
    cut = revisions.gaps(lines, new)
    groups = cut.where("NOT stays").groupBy("gap", "part", "side").count()
    assert groups.agg(F.max("count")).first()[0] <= revisions.GAP_UNITS
    got = revisions.align_units(lines, new)
    counts = {r.kind: r.n for r in got.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts["same"] == n - 6000 - 500 - 94 + 0 and counts["near"] >= 94 and sum(counts.values()) == n
    assert got.where("kind = 'same' AND substring(old_id, 2) <> substring(new_id, 2)").count() == 0


def test_most_alike_equals_every_ratio():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab c") for _ in range(rng.randint(0, n)))
    for _ in range(3000):
        text = word(12)
        others = [rng.choice([word(12), text + word(4), word(4) + text, text[:6] + word(6) + text[6:], text]) for _ in range(rng.randint(0, 4))]
        scores = [difflib.SequenceMatcher(None, text, o, autojunk=False).ratio() for o in others]
        want = scores.index(max(scores)) if max(scores, default=0.0) > 0.5 else -1
        assert revisions._most_alike(text, others, 0.5) == want, (text, others)


def test_long_edited_lines_need_no_ratio(spark, monkeypatch):
    """Lines of 40,000 characters, edited at an end: their ratio is quadratic in Python (minutes a line) and not needed."""
    rng = random.Random(4)
    long = ["".join(rng.choice("abcdefg h") for _ in range(40_000)) for _ in range(2)]
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda m: pytest.fail("a ratio was computed"))
    assert revisions._most_alike(long[0], [long[0] + " revised", "x" * 40_000], 0.5) == 0
    assert revisions._most_alike(long[0], ["short", "put before " + long[0]], 0.5) == 1


def test_places_of_a_note_in_a_long_line(spark):
    """Every start of the words is asked, overlapping ones too, where they stand at the text's start, and with a pattern's marks in them."""
    line = "w " * 60_000
    rows = [("aXaXa tail end", "aXa", "aX", " tail end", 2), (line + r"\Ea.\Q (end)", r"\Ea.\Q", "", " (end)", 120_000), ("begin it all", "begin", "", " it", 0)]
    old = spark.createDataFrame([(k, 0, "u0", "gone") for k in range(len(rows))], "doc_id long, pos int, unit_id string, text string")
    new = spark.createDataFrame([(k, 0, "v0", r[0]) for k, r in enumerate(rows)], old.schema)
    notes = spark.createDataFrame([(k, "n", "u0", *r[1:4]) for k, r in enumerate(rows)], "doc_id long, note_id string, unit_id string, exact string, prefix string, suffix string")
    got = {r.doc_id: (r.start, r.size, r.state) for r in revisions.reanchor(notes, new, revisions.align_units(old, new)).collect()}
    assert got == {k: (r[4], len(r[1]), "found") for k, r in enumerate(rows)}


def test_an_edit_in_a_long_line_is_as_small_as_in_a_short_one(spark):
    """A line of 1,200 words with a word added behind and a line put in before it: over a million pairs of words."""
    line = "5> " + " ".join(f"word{k % 300}" for k in range(1200))
    old = spark.createDataFrame([(1, 8, "Before."), (1, 10, line), (1, 12, "Behind.")], "doc_id long, pos int, text string")
    new = spark.createDataFrame([(1, 8, "Before."), (1, 9, "Put-in4"), (1, 10, line + " revised"), (1, 12, "Behind.")], old.schema)
    assert {tuple(r) for r in revisions.edit_places(old, new).collect()} == {(1, 9, "", "Put-in4"), (1, 10, "", "revised")}


def test_long_runs_of_words_are_matched_as_difflib_does():
    rng = random.Random(7)
    for n in [*range(1, 12)] * 60 + [400]:
        a, b = ([rng.choice("abcde"[: rng.randint(1, 5)]) for _ in range(rng.randint(0, n))] for _ in range(2))
        b = rng.choice([b, [*a[: n // 2], "new", *a[n // 2 :]], [*b, *a, *b]])
        want = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
        assert revisions._word_opcodes(a, b, 0) == revisions._word_opcodes(a, b, 20) == want, (a, b)
