"""Hot keys and deep inputs: what all rows share gives no rows times rows, and depth costs rounds, not levels."""

from __future__ import annotations

import gc
import random
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import fold, library, links, pages, search, segment
from lectern.plans import QUERIES


def test_a_shingle_that_all_share_makes_no_candidates(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    hot = "this licence is shared by everyone"
    passages = [(k, f"{hot} {' '.join(word() for _ in range(12))}") for k in range(40)]
    docs = [(k, f"{hot} {' '.join(word() for _ in range(30))}") for k in range(300)]
    docs += [(1000 + k, f"x y z {p} q r") for k, p in passages[:5]] + [(2000, passages[7][1][: len(passages[7][1]) // 2]), (2001, None), (2002, "")]
    d, p = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "item_id long, text string")
    runs = lambda t: {tuple(w[i : i + 4]) for w in [(t or "").split()] for i in range(len(w) - 3)}
    want = {(i, j, len(runs(t) & runs(u)), len(runs(u))) for i, t in docs for j, u in passages if len(runs(t) & runs(u)) >= 0.6 * len(runs(u))}
    found = search.contains_passage(d, p)
    assert {tuple(r) for r in found.collect()} == want and len(want) >= 5
    search_limit, search.BROADCAST_SHINGLES = search.BROADCAST_SHINGLES, 0
    try:
        assert {tuple(r) for r in search.contains_passage(d, p).collect()} == want
    finally:
        search.BROADCAST_SHINGLES = search_limit


def test_deep_folders_and_long_loops(spark):
    chain = [(f"c{k}", f"c{k - 1}" if k else None) for k in range(5000)]
    loop = [(f"l{k}", f"l{(k + 1) % 1000}") for k in range(1000)] + [("below", "l0"), ("under", "below"), ("lost", "nowhere"), ("self", "self")]
    folders = spark.createDataFrame(chain + loop, "folder_id string, parent string")
    placed = folders.select("folder_id", F.lit(1).alias("doc_id"))
    got = {r.folder_id: (r.parent, r.depth, r.documents) for r in library.folder_tree(folders, placed).collect()}
    assert len(got) == 6004
    assert all(got[f"c{k}"] == (f"c{k - 1}" if k else None, k, 5000 - k) for k in range(5000))
    assert got["below"] == ("l0", 1, 2) and got["under"] == ("below", 2, 1) and got["l0"] == (None, 0, 3)
    assert all(got[f"l{k}"] == (None, 0, 1) for k in range(1, 1000)) and got["lost"] == got["self"] == (None, 0, 1)


def _tokenised(df):
    """How often a plan cuts texts into tokens."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(")


def test_prompts_fold_each_unit_once(spark):
    """A filter on a fold's column was pushed below it: the fold stood in the plan many times over."""
    docs = spark.createDataFrame([(1, "One two. Three.\n...\nFour five.\nSix.\n\t\nSeven.\nEight.", "T", "text")], "doc_id long, text string, title string, kind string")
    folded = fold.fold_local(segment.units_of(docs.select("doc_id", "text")))
    prompts, asked = fold.fold_prompts(folded, docs), links.link_prompts(folded)
    assert _tokenised(folded) == _tokenised(prompts) == _tokenised(asked) == 1
    got = {r.section_id: r.prompt for r in prompts.collect()}
    assert set(got) == {"s0", "s1"}
    assert all("Opening: One two. ...\n" in p for p in got.values())
    assert "Outline:\n> s0\n- s1\n" in got["s0"] and "Outline:\n- s0\n> s1\n" in got["s1"]
    assert asked.first().prompt.split("\n") == ["[0] One two", "[1] ...", "[2] Four five", "[3] Six", "[4] Seven", "[5] Eight"]


def test_folds_that_are_used_twice_are_made_once(spark, sf):
    """Both sides of the join, and the titles beside the levels, folded every unit again."""
    for name in ("x2_assemble_translations", "q3_find_at_takeaway"):
        assert _tokenised(QUERIES[name](spark, sf)) == 0, name  # what is kept is read


def test_the_ranges_hold_every_wide_character(spark):
    texts = [f"One two{c} Three four. Five." for c in (*T.CJK_STOPS, *T.DANDAS, "぀", "ヿ", "ㇰ", "㐀", "䶿", "一", "鿿", "豈", "﫿", "ｦ", "ﾟ")]
    rows = spark.createDataFrame([(x,) for x in texts], "text string").withColumn("toks", T.tokens(F.col("text")))
    assert rows.where(~T.sentence_ends(F.col("toks"), F.col("text")).eqNullSafe(T._ends_one_by_one(F.col("toks")))).count() == 0


def test_a_word_of_any_length_is_one_token(spark):
    """The pattern of words took a stack frame a letter."""
    text = "é" * 300_000 + " " + "a" * 300_000 + "-" + "b́" * 10_000 + " x."
    made = spark.createDataFrame([(text,)], "text string").select(F.transform(T.tokens(F.col("text")), lambda x: F.length(x["t"])).alias("n"), T.terms(F.lit("Uses ASS boss the C3P0s s as")).alias("terms"))
    row = made.first()
    assert row.n == [300_000, 320_001, 1, 1]
    assert row.terms == ["use", "ass", "boss", "", "c3p0", "s", ""]


class _Frame:
    """Hands out the function that Python workers would run."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run

    mapInPandas = mapInArrow


def test_pages_are_python_objects_a_few_at_a_time():
    """A worker held 10,000 pages as strings, and the elements of those that were read until Python looked for circles."""
    html = "".join(f"<p>Said {k}<sup><a href='#f{k}'>{k}</a></sup><span role='doc-footnote' id='f{k}'>Foot {k}</span></p>" for k in range(150))
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(600)), "html": [html] * 600})
    run = pages.inline_notes(_Frame())
    gc.disable()
    tracemalloc.start()
    try:
        rows = sum(len(out) for out in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        gc.enable()
    assert rows == 600 * 151 and peak < len(html) * 600 / 2
