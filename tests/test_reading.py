"""Literal cases and invariants of the reading operators."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.languages import languages
from lectern.operators.fold import document_at
from lectern.operators import cjk, fold, library, links, notes, pages, revisions, search, segment, structure, translate, turns
from lectern.plans import QUERIES, SQL
from lectern.sources import readers, sinks
from lectern.streaming import streams


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "text string").select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "text, n",
    [
        ("Dr. Smith et al. measured 3.14 units (see Fig. 2). Next we test it.", 2), ("Really?! Yes!", 2), ('He said, "It holds." Next we test it.', 2),
        ("A. Smith agrees. Next we test it.", 2), ("", 0), ("1.研究背景", 1), ("这是一句。那是二句！", 2), ("यह एक है। वह दो है।", 2), ("no stop", 1), ("lower. case goes on", 1),
    ],
)
def test_sentences(spark, text, n):
    df = segment.sentences(spark.createDataFrame([(1, 0, text)], "doc_id long, pos int, text string")).orderBy("sent").collect()
    assert len(df) == n
    assert all(a.tok_end == b.tok_start for a, b in zip(df, df[1:]))


def test_tokens(spark):
    assert [x.t for x in one(spark, "naïve été, 3.14% done.", T.tokens(F.col("text")))] == ["naïve", "été", ",", "3.14%", "done", "."]
    assert [x.t for x in one(spark, "पहला कदम 日本 don't", T.tokens(F.col("text")))] == ["पहला", "कदम", "日", "本", "don't"]


def test_fold_local(spark):
    u = spark.createDataFrame([(1, 0, "u0", "s0", "One two, three four. Next."), (1, 1, "u1", "s0", "..."), (1, 2, "u2", "s0", " ".join(f"w{i}" for i in range(20)))], "doc_id long, pos int, unit_id string, section_id string, text string")
    got = {r.pos: r for r in fold.fold_local(u).collect()}
    assert (got[0].takeaway, got[0].topic) == ("One two, three four", "One two, three")
    assert got[1].takeaway == "..." and got[1].topic == ""
    assert got[2].takeaway.split() == [f"w{i}" for i in range(14)]


@pytest.mark.parametrize(
    "text, code",
    [
        ("$x$ 1 2 3", "en"), ("这是一个关于机器学习的研究，我们发现了新的问题。", "zh"), ("這是一個關於機器學習的研究，我們發現了新的問題。", "zh-Hant"),
        ("これは新しい研究です。私たちはそれを調べました。", "ja"), ("der Hund und die Katze sind nicht von hier, das ist mit dem Haus", "de"),
        ("the cat and the dog are in the house of the man", "en"), ("Это новое исследование о языке и тексте", "ru"), ("Це нове дослідження їхньої мови і тексту є", "uk"), (None, None),
    ],
)
def test_language(spark, text, code):
    row = segment.detect_language(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert code is None or row.detected == code


def test_language_table(spark):
    rows = {r.code: r for r in languages(spark).collect()}
    assert len(rows) == 24 and rows["zh"].stop == "。" and rows["hi"].stop == "।" and rows["vi"].takeaway == 24


def test_reply_shapes(spark):
    unit = {"id": "U0", "role": "claim", "takeaway": "t", "topic": "x", "reason": "", "evidence": [0]}
    outs = [{"units": [unit]}, {"units": {"U0": unit}}, {"units": json.dumps([unit])}, {"units": [json.dumps(unit)]}]
    df = spark.createDataFrame([(i, json.dumps(o)) for i, o in enumerate(outs)] + [(9, "no"), (10, '{"units": 3}')], "k long, out string")
    got = fold.reply_units(fold.parse_replies(df)).collect()
    assert sorted((r.k, r.unit, r.takeaway, tuple(r.evidence)) for r in got) == [(i, "U0", "t", (0,)) for i in range(4)]


def test_topic_choice(spark):
    df = spark.createDataFrame([("zero-shot transfer", "Zero-shot Transfer works well here"), ("new phrase", "Something else is said"), ("a phrase that is far too long", "Something else is said")], "t string, k string")
    assert [r.x for r in df.select(fold.choose_topic(F.col("t"), F.col("k")).alias("x")).collect()] == ["Zero-shot Transfer", "new phrase", "Something else is"]


def test_a_failed_prompt_costs_itself_only(spark):
    bad = {3, 777, 778, 9_999}
    p = spark.range(10_000).select(F.col("id").cast("string").alias("cache_key"), F.when(F.col("id").isin(*bad), "bad").otherwise(F.concat(F.lit("p"), "id")).alias("prompt"))

    def answer(prompts):
        if "bad" in prompts:
            raise ValueError("no")
        return [x.upper() for x in prompts]

    for batch in (1, 64, 10_000):
        got = {int(r.cache_key): (r.out, r.error) for r in fold.complete(p, answer, batch=batch).collect()}
        assert got == {i: (None, "no") if i in bad else (f"P{i}", None) for i in range(10_000)}
    short = fold.complete(p.limit(3), lambda prompts: prompts[:-1], batch=2).collect()
    assert sorted((r.out is None, r.error) for r in short) == [(True, "0 replies to 1 prompts")] * 3


def test_the_reply_store_stays_where_it_lies(spark, tmp_path):
    prompts = spark.range(2000).select(F.md5(F.col("id").cast("string")).alias("cache_key"), F.lit("p").alias("prompt"))
    kept = spark.range(0, 2000, 2).select(F.md5(F.col("id").cast("string")).alias("cache_key"), F.when(F.col("id") % 10 == 0, "cut {").otherwise("{}").alias("out"))
    fold.save_replies(kept, "kept_replies", str(tmp_path / "store"), buckets=8)
    asked = fold.to_ask(prompts, spark.table("kept_replies"))
    assert asked.count() == 1200
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fold.to_ask(prompts, spark.table("kept_replies"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE kept_replies")
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above, level = [], depth(scan)
    for line in reversed(plan.splitlines()[: plan.splitlines().index(scan)]):
        if depth(line) < level:
            above.append(line)
            level = depth(line)
    assert "Join" in "".join(above) and not any("Exchange" in line for line in above)


def test_layers_are_read_by_language(spark):
    local = spark.createDataFrame([(d, p, f"k{p}", "t", "c", "local") for d in (1, 2) for p in (0, 1)], "doc_id long, pos int, key string, takeaway string, topic string, model string")
    rows = [(1, "en", 1, 0, "en1"), (1, "en", 2, 1, "en2"), (1, "de", 7, 0, "de"), (1, "de", 7, 1, "de"), (2, "de", 1, 0, "two")]
    layers = spark.createDataFrame([(*r, "t", "c", "m") for r in rows], "doc_id long, lang string, version int, pos int, key string, takeaway string, topic string, model string")
    read = lambda lang: {(r.doc_id, r.pos): r.key for r in sinks.read_layers(layers, local, spark.createDataFrame([(1, lang), (2, lang)], "doc_id long, lang string")).collect()}
    assert read("en") == {(1, 0): "k0", (1, 1): "en2", (2, 0): "k0", (2, 1): "k1"}
    assert read("de") == {(1, 0): "de", (1, 1): "de", (2, 0): "two", (2, 1): "k1"} and read("fr")[1, 0] == "k0"


@pytest.mark.parametrize(
    "text, first",
    [("Use e.g. this one. Next.", "Use e.g. this one."), ("Version 3.5 is out. Upgrade.", "Version 3.5 is out."), ("Call `a.b()` now. Then stop.", "Call `a.b()` now."), ("", ""), ("Stop? Yes.", "Stop?")],
)
def test_first_sentence(spark, text, first):
    assert one(spark, text, turns.first_sentences(F.col("text"), 1)) == first


@pytest.mark.parametrize("name", ["r1_first_sentence", "r2_fold_turns_gist", "r2_fold_turns_outline", "r2_fold_turns_short", "r3_fold_share", "r4_worth_folding"])
def test_queries_cut_behind_abbreviations_as_their_sql_does(spark, tmp_path, name):
    import duckdb

    texts = ["St. Anna is old. It stands.", "No. 5 is out. Next one.", "A. Smith agrees. Next one.", "Use e.g. this one. Next.", "Dr. Who?\nYes.", "Plain one. Two.", "no stop", "", None]
    texts += ["St. " + "word " * 80 + "end. Two.", "St. Anna " + "word " * 80 + "end. " + "more " * 20]
    turned = [(1, k, "user", x) for k, x in enumerate(texts)]
    spark.createDataFrame(turned, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert {tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()} == set(duckdb.sql(SQL[name]).fetchall())


def test_fold_turns(spark):
    text = "# Head\n\nFirst one. Second one. Third.\n\n- item a. More.\n  - inner\n- item b\n\n```\ncode\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |"
    df = spark.createDataFrame([(1, text)], "k long, text string")
    kinds = [r.kind for r in turns.markdown_blocks(df, ["k"]).orderBy("block").collect()]
    assert kinds == ["heading", "paragraph", "item", "item", "item", "code", "table"]
    shown = {n: turns.fold_turns(df, ["k"], n).first().shown for n in turns.FOLD_LEVELS}
    assert shown[2].startswith("# Head\n\nFirst one. Second one. …\n- item a. …\n- inner")
    assert "inner" not in shown[3] and shown[4] == "# Head\n\nFirst one. …" and shown[5] == "First one. …"


def test_cjk(spark):
    units = [(1, 0, "第一章 ......... 1"), (1, 1, "① 王某：《支付法》，法律出版社，第 12-14 页。"), (1, 2, "随着技术的发展，问题出现了。本文认为第三方支付应当受到统一监管，并且需要立法。")]
    df = spark.createDataFrame([(d, p, f"u{p}", "s0", t) for d, p, t in units], "doc_id long, pos int, unit_id string, section_id string, text string")
    got = {r.pos: r for r in cjk.fold_cjk(df).collect()}
    assert got[0].brief == "" and got[1].brief == "" and got[2].brief.startswith("本文认为")
    assert got[2].topic == cjk.topic_of(got[2].takeaway) and 2 <= len(got[2].topic) <= 13
    assert cjk.topic_of("首先，支付机构的性质。") == "支付机构的性质"
    parts = [(1, "s", 0, "para", "该条例的法律位阶为行政"), (1, "s", 1, "para", "① 注释。"), (1, "s", 2, "para", "法规，加强监管。"), (1, "s", 3, "para", "完整。")]
    tails = {r.pos: r.carried for r in cjk.carry_tail(spark.createDataFrame(parts, "doc_id long, section_id string, pos int, role string, text string")).collect()}
    assert tails == {0: "", 1: "", 2: "该条例的法律位阶为行政", 3: ""}
    lines = spark.createDataFrame([(1, "s", 0, "支付机构应当受到统一的监管", "支付机构应当受到统一监管。"), (1, "s", 1, "别的", "支付机构应当受到统一监管。")], "doc_id long, section_id string, pos int, takeaway string, section_line string")
    assert [r.repeats for r in cjk.repeats_section(lines).orderBy("pos").collect()] == [True, False]


@pytest.mark.parametrize(
    "lines, line, shown",
    [
        (["甲乙丙", "丁戊", "己庚", "辛壬"], None, [True, True, True, False]),
        (["甲乙", "!丙丁", "戊己", "庚辛", "壬癸"], None, [True, True, True, True, False]),
        (["甲", "《某办法》规定乙丙丁", "戊己"], None, [True, False, True]),
        (["甲", "2009 年规定乙丙丁", "2010 年本文认为戊"], None, [True, False, True]),
        (["甲", "《资本要求》：乙丙丁"], None, [True, True]),
        (["《某办法》规定甲", "乙"], None, [True, True]),
        (["!既有监管模式不适应第三方跨境支付发展", "!另有一点与摘要无关"], "既有监管模式不适应第三方跨境支付发展", [False, True]),
        (["甲乙", "", "丙", "丁", "戊"], None, [True, False, True, True, False]),
        (["One fact here.", "Another fact here.", "A third one.", "A fourth."], None, [True, True, True, True]),
    ],
)
def test_background_steps_down(spark, lines, line, shown):
    rows = [(1, "s", p, "claim" if x[:1] == "!" else "context", x.lstrip("!"), line) for p, x in enumerate(lines)]
    ladders = spark.createDataFrame(rows, "doc_id long, section_id string, pos int, role string, takeaway string, section_line string")
    docs = spark.createDataFrame([(1, True)], "doc_id long, is_cjk boolean")
    assert [r.shown for r in cjk.step_down_background(ladders, docs).orderBy("pos").collect()] == shown
    other = cjk.step_down_background(ladders, docs.withColumn("is_cjk", F.lit(False))).orderBy("pos").collect()
    assert [r.shown for r in other] == [x != "" for x in lines]  # a document in another language folds as it is


@pytest.mark.parametrize(
    "line, plumbing",
    [
        ("第一章 ……… 1", True), ("第一章 . . . 1" + "字" * 120, False), ("一句普通的话。", False), ("", True), ("① 王某：《支付法》，某出版社", True), ("王某：《支付法》，某出版社", False),
        ("② 《支付法》第 12 条", True), ("③ 参见前文", True), ("④ Ronald Mann, Charging Ahead", True), ("⑤ 这是正文中的一句", False), ("① 见 [EB/OL] 一文", True), ("①：第 12—15", True),
    ],
)
def test_apparatus(spark, line, plumbing):
    units = spark.createDataFrame([(1, 0, line)], "doc_id long, pos int, text string")
    assert fold.flag_apparatus(units).first().apparatus is plumbing


def test_sections_and_units(spark):
    rows = [(0, "paragraph", None, "Lead text."), (1, "heading", 2, "1 Introduction"), (2, "paragraph", None, "A."), (3, "heading", 3, "1.1 Scope"), (4, "item", 0, "- an item"), (5, "heading", 2, "Appendix A Proofs"), (6, "heading", 3, "Scope"), (7, "paragraph", None, "P."), (8, "heading", 2, "References"), (9, "paragraph", None, "Work one.")]
    b = spark.createDataFrame([(1, *r) for r in rows], "doc_id long, pos int, kind string, level int, text string")
    s = {r.section_id: r for r in structure.sections(b).collect()}
    assert list(sorted(s)) == ["abstract", "introduction", "proofs", "references", "scope", "scope-2"]
    assert s["scope"].parent == "introduction" and s["scope"].num == "1.1" and s["scope-2"].is_appendix and s["references"].is_references
    u = structure.units(b, structure.sections(b))
    assert {(r.pos, r.section_id, r.role) for r in u.collect()} == {(0, "abstract", "abstract"), (2, "introduction", "para"), (4, "scope", "item"), (7, "scope-2", "para"), (9, "references", "para")}
    prose, works = structure.split_references(u, structure.sections(b))
    assert prose.count() == 4 and [(r.bib, r.text) for r in works.collect()] == [("bib1", "Work one.")]


def test_page_markdown(spark):
    rows = [(1, p, f"# Journal of Things {p}\n\nWords commu- nication OCR- free {p}.\n\n{p}") for p in range(1, 5)]
    b = readers.read_page_markdown(spark.createDataFrame(rows, "doc_id long, page int, markdown string"))
    kept = structure.drop_running_heads(b).collect()
    assert sorted(r.text for r in kept) == [f"Words commu- nication OCR- free {p}." for p in range(1, 5)]
    joined = structure.rejoin(b.where("kind = 'paragraph'"), ["doc_id", "page"]).collect()
    assert any("communication OCR-free" in r.text for r in joined)
    title = spark.createDataFrame([(1, 1, 0, "heading", 1, "# A study of many things"), (1, 1, 1, "heading", 1, "# Short one"), (1, 1, 2, "heading", 2, "## 1 Introduction")], "doc_id long, page int, block int, kind string, level int, text string")
    assert structure.pick_title(title, spark.createDataFrame([(1, "short one")], "doc_id long, title string")).first().title == "Short one"


def test_front_matter(spark):
    texts = ['---\ntitle: "A: b" # c\nauthor:\n  - given: Ann\n    family: Lee\n  - given: Bo\n    family: Day\ndate: 2024-01-02\nlicense: CC-BY\n---\nBody', "---\ntitle: |\n  Two\n  lines\nauthors: [X, 'Y Z']\n---\n", "no head"]
    got = structure.front_matter(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert (got[0].fm_title, got[0].fm_authors, got[0].fm_date, got[0].fm_license) == ("A: b", ["Ann Lee", "Bo Day"], "2024-01-02", "CC-BY")
    assert (got[1].fm_title, got[1].fm_authors) == ("Two lines", ["X", "Y Z"]) and got[2].fm_authors == []


def test_captions_and_tables(spark):
    df = spark.createDataFrame([("Figure 3: The plot.",), ("Extended Data Fig. 1 | More",), ("表 2 数据",), ("Plain text.",)], "text string")
    assert [r.label for r in structure.caption_labels(df).collect()] == ["Figure 3", "Extended Data Fig. 1", "表 2", None]
    cells = [(1, "s", "t1", r, c, f"n{r}" if c == 0 else "a longer text of more than eight words in this cell", False) for r in range(4) for c in range(2)] + [(1, "s", "t2", r, c, "1", False) for r in range(4) for c in range(3)]
    kinds, texts = structure.classify_tables(spark.createDataFrame(cells, "doc_id long, section_id string, table_id string, row int, col int, text string, has_picture boolean"))
    assert {r.table_id: r.kind for r in kinds.collect()} == {"t1": "list", "t2": "data"} and texts.first().text.startswith("1 | 1 | 1\n")


def test_references(spark):
    refs = ["https://github.com/Own/Repo.git", "https://github.com/features/x", "arXiv:2401.01234v2", "10.48550/arXiv.2401.01234", "https://en.wikipedia.org/wiki/Spark", "10.1101/2020.01.01.123456", "PMC123", "10.1000/xyz", "http://a.example/", "nothing"]
    got = segment.classify_refs(spark.createDataFrame([(r,) for r in refs], "ref string"), "ref").collect()
    assert [r.kind for r in got] == ["github", "web", "arxiv", "arxiv", "wikipedia", "preprint", "europepmc", "doi", "web", "error"] and got[0].key == "own/repo"


def test_inline_notes_and_recipes(spark):
    html = '<article><p>Said<span class="sidenote">1. A note</span> so.<span role="tooltip">drop me</span></p><div class="ad">Buy</div></article><p>outside</p>'
    df = spark.createDataFrame([(1, "https://www.site.example/a", html)], "page_id long, url string, html string")
    rows = pages.inline_notes(df).collect()
    assert [(r.mark, r.words) for r in rows if r.n is not None] == [("1", "A note")] and [r.html_text for r in rows if r.n is None] == ["Said so. Buy outside"]
    rules = spark.createDataFrame([("site.example", "article", [".ad", "a:hover"], ["h1"])], "host string, article string, drop array<string>, content array<string>")
    read, hits = pages.apply_recipes(df, rules)
    assert read.first().text == "Said so." and [tuple(n) for n in read.first().notes] == [("1", "A note")] and {r.selector: r.hits for r in hits.collect()} == {"article": 1, ".ad": 1, "a:hover": 0, "h1": 0}


@pytest.mark.parametrize(
    "html, notes, text",
    [
        ('<p>A<sup><a id="r1" href="#f1">1</a></sup> b<span role="doc-footnote" id="f1">Words <a href="#r1">back</a></span>.</p>', [("1", "Words back")], "A b."),
        ('<p>A<a id="r1">[2]</a> b<span class="sidenote">Linked <a href="#r1">up</a></span>.</p>', [("[2]", "Linked up")], "A b."),
        ('<p>A <span class="marginnote">one</span><span class="marginnote">two <i class="sidenote">in</i></span></p>', [("1", "one"), ("2", "two in")], "A"),
        ('<section role="doc-endnotes"><div role="doc-endnote" id="x">Apart.</div></section>', [], "Apart."),
        ('<p>A <span class="tooltip">3. Told</span><span class="tooltip">lost</span></p>', [("3", "Told")], "A"),
        ("<p>A<d-footnote>x<script>no</script></d-footnote>" + "<b>" * 3000 + "deep", [("1", "x")], "Adeep"),
        ("", [], ""),
    ],
)
def test_notes_inside_sentences(spark, html, notes, text):
    rows = pages.inline_notes(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("n").collect()
    assert [(r.mark, r.words) for r in rows if r.n is not None] == notes and rows[0].html_text == text


def test_recipes_take_figures_and_notes(spark):
    html = (
        '<article><p>One<sup class="m">a</sup>, two<sup class="m">b</sup>.</p><aside class="n">First</aside><div class="fig" aria-label="Labelled"></div>'
        '<div class="fig"><h3>Headed</h3></div><div><div class="fig"></div><p class="caption">Beside</p></div><div class="fig"></div><aside class="n">Second</aside></article>'
    )
    rules = spark.createDataFrame(
        [("s.example", "article", [], [], [".fig"], [("sup.m", ".n")])],
        "host string, article string, drop array<string>, content array<string>, figures array<string>, notes array<struct<mark:string,note:string>>",
    )
    df = spark.createDataFrame([(1, "http://s.example/p#top", html)], "page_id long, url string, html string")
    r = pages.apply_recipes(df, rules)[0].first()
    assert [x.caption for x in r.figures] == ["Labelled", "Headed", "Beside", "↗"] and {x.link for x in r.figures} == {"http://s.example/p"}
    assert sorted((x.mark, x.words) for x in r.notes) == [("a", "Second"), ("b", "First")] and r.text == "One, two. Labelled Headed Beside ↗"
    assert r.hits == {"article": 1, ".fig": 4, "sup.m": 2, ".n": 2}


def test_visible_html(spark):
    html = "<p>a</p><!-- x --><script>s</script><span class='sr-only'>no</span><i style='display: none'>no</i><b hidden>no</b><p aria-hidden='true'>no</p><p>b</p>"
    assert pages.visible_html(spark.createDataFrame([(1, html)], "page_id long, html string")).first().visible == "<p>a</p><p>b</p>"


def test_citations_and_terms(spark):
    a = spark.createDataFrame([(1, 1, "x [[2, 9]] y [[?]] [[u2]]"), (2, 1, "plain")], "answer_id long, doc_id long, answer string")
    t = spark.createDataFrame([(1, 2, "u2")], "doc_id long, num int, target string")
    text, cites = search.resolve_citations(a, t)
    assert {r.answer_id: r.answer for r in text.collect()} == {1: "x [[u2]][[!9]] y [[?]] [[u2]]", 2: "plain"}
    assert [(r.answer_id, r.target, r.place) for r in cites.collect()] == [(1, "u2", 1)]
    assert one(spark, "What does D=4 mean for 第三方支付是什么", search.query_terms(F.col("text"))) == ["d=4", "第三", "三方", "方支", "支付", "付是"]


def test_folders(spark):
    f = spark.createDataFrame([("a", None), ("b", "a"), ("x", "nowhere"), ("l1", "l2"), ("l2", "l1")], "folder_id string, parent string")
    p = spark.createDataFrame([("b", 1), ("a", 2), ("l1", 3)], "folder_id string, doc_id long")
    got = {r.folder_id: (r.parent, r.depth, r.documents) for r in library.folder_tree(f, p).collect()}
    assert got == {"a": (None, 0, 2), "b": ("a", 1, 1), "x": (None, 0, 0), "l1": (None, 0, 1), "l2": (None, 0, 0)}
    c = [(1, "new", "a", "A", None), (2, "new", "b", "B", "a"), (3, "new", "c", "C", "b"), (4, "rename", "a", "AA", None), (5, "nest", "a", None, "c"), (6, "delete", "b", None, None)]
    c = [("t", *x) for x in c]
    c += [("u", 1, "new", "a", "A", None), ("u", 2, "new", "b", "B", None), ("u", 3, "nest", "a", None, "b"), ("u", 4, "nest", "b", None, "a"), ("u", 5, "new", "x", "X", "no")]
    c += [("v", 1, "new", "a", "A", None), ("v", 2, "delete", "a", None, None), ("v", 3, "new", "b", "B", "a"), ("v", 4, "new", "a", "again", None), ("v", 5, "nest", "a", None, "a")]
    out = library.apply_folder_changes(spark.createDataFrame(c, "tree string, seq int, op string, folder_id string, name string, parent string")).collect()
    assert {tuple(r) for r in out} == {("t", "a", "AA", None), ("t", "c", "C", "a"), ("u", "a", "A", "b"), ("u", "b", "B", None), ("v", "a", "again", None)}
    e = [(1, "placed", "a", 1, 1), (1, "deleted", None, 2, 2), (2, "placed", "b", 1, 3), (3, "placed", "a", 1, 4), (3, "deleted", None, 2, 5), (3, "restored", None, 3, 6)]
    live = spark.createDataFrame([("a",)], "folder_id string")
    got = library.placement_history(spark.createDataFrame(e, "doc_id long, event string, folder_id string, ts int, seq int"), live).collect()
    assert {(r.doc_id, r.folder_id) for r in got} == {(2, None), (3, "a")}


def test_revisions(spark):
    cols = "doc_id long, pos int, unit_id string, section_id string, text string"
    old = spark.createDataFrame([(1, 0, "u0", "a", "The first paragraph stands."), (1, 1, "u1", "a", "The second paragraph is edited a bit."), (1, 2, "u2", "b", "The third one goes."), (1, 3, "u3", "b", "The last one moves up.")], cols)
    new = spark.createDataFrame([(1, 0, "v0", "x", "The last one moves up."), (1, 1, "v1", "x", "The first paragraph stands."), (1, 2, "v2", "x", "The second paragraph was edited a bit.")], cols)
    a = revisions.align_units(old, new)
    assert {(r.old_id, r.new_id, r.kind) for r in a.collect()} == {("u0", "v1", "same"), ("u1", "v2", "near"), ("u2", None, None), ("u3", None, None)}
    got = {r.new_id: (r.unit_id, r.kept_section) for r in revisions.carry_ids(old, new, a).collect()}
    assert got == {"v0": ("u3", "a"), "v1": ("u0", "a"), "v2": ("u1", "a")}
    n = [(1, "n1", "u0", "first", "", ""), (1, "n2", "u1", "second paragraph", "The ", " is"), (1, "n3", "u3", "moves up", "one ", "."), (1, "n4", "u2", "third", "", "")]
    r = {x.note_id: (x.unit_id, x.start, x.state) for x in revisions.reanchor(spark.createDataFrame(n, "doc_id long, note_id string, unit_id string, exact string, prefix string, suffix string"), new, a).collect()}
    assert r == {"n1": ("v1", None, "kept"), "n2": ("v2", 4, "found"), "n3": ("v0", 13, "found"), "n4": (None, None, "lost")}
    edits = revisions.edit_places(old.where("pos = 1"), new.where("pos = 2").withColumn("pos", F.lit(1))).collect()
    assert [(x.was, x.now) for x in edits] == [("is", "was")]


def test_a_unit_put_in_between_changes_no_other(spark):
    old = spark.createDataFrame([(1, i, f"Line {i} stands here.") for i in range(5)] + [(2, 0, "one two three four"), (3, 0, "only old")], "doc_id long, pos int, text string")
    new = spark.createDataFrame([(1, 0, "Put before.")] + [(1, i + 1, f"Line {i} stands here.") for i in range(5)] + [(2, 0, "one 2 3 four"), (4, 0, "only new")], "doc_id long, pos int, text string")
    got = {tuple(r) for r in revisions.edit_places(old, new).collect()}
    assert got == {(1, 0, "", "Put before."), (2, 0, "two three", "2 3"), (3, 0, "only old", ""), (4, 0, "", "only new")}


def test_passages_are_found_between_their_contexts(spark):
    new = spark.createDataFrame([(1, 0, "v0", "He said that the whole plan was changed again today."), (1, 1, "v1", "Nothing here.")], "doc_id long, pos int, unit_id string, text string")
    a = spark.createDataFrame([(1, "u0", None, None, 0)], "doc_id long, old_id string, new_id string, kind string, at int")
    n = [(1, "n1", "u0", "old plan", "said that the ", " again today"), (1, "n2", "u0", "old plan", "the ", " agai"), (1, "n3", "u0", "old", "no such prefix ", " again today"), (1, "n4", "u0", "x", "He said that the ", " today.")]
    cols = "doc_id long, note_id string, unit_id string, exact string, prefix string, suffix string"
    got = {x.note_id: (x.unit_id, x.start, x.size, x.state) for x in revisions.reanchor(spark.createDataFrame(n, cols), new, a).collect()}
    assert got["n1"] == ("v0", 17, 22, "found") and got["n2"][3] == got["n3"][3] == "lost" and got["n4"] == ("v0", 17, 28, "found")


def test_find_and_record_citations(spark):
    lv = spark.createDataFrame([(1, 0, "The Élan is  the elan of all elan.", "The Élan is")], "doc_id long, pos int, full string, takeaway string")
    s = spark.createDataFrame([(1, 0, "Élan vital"), (1, 5, "Other")], "doc_id long, pos int, title string")
    assert {tuple(r) for r in search.find(lv, "ELAN", "takeaway", s).collect()} == {(1, 0, "takeaway", 4), (1, 0, "open", 16), (1, 0, "open", 28), (1, 0, "section", None)}
    assert {r.start for r in search.find(lv, "elan").collect()} == {4, 16, 28} and search.find(lv, "  ").count() == 0
    a = spark.createDataFrame([(1, 7, "a [3] b [T1.2] c [4][3] [x]"), (2, 7, "none")], "answer_id long, record_id long, answer string")
    tags = spark.createDataFrame([(7, "3", "n-3"), (7, "T1.2", "s2")], "record_id long, tag string, target string")
    text, cites = search.resolve_tags(a, tags)
    assert {r.answer_id: r.answer for r in text.collect()} == {1: "a [n-3] b [s2] c [n-3] [x]", 2: "none"}
    assert {tuple(r) for r in cites.collect()} == {(1, "n-3", 1), (1, "s2", 2)}


def test_readers(spark, tmp_path):
    (tmp_path / "a_file-name.md").write_bytes("﻿# Only head\n\ntext".encode())
    (tmp_path / "b.txt").write_bytes("中文内容".encode("gb18030"))
    (tmp_path / "c.txt").write_text("---\ntitle: 'Named'\n---\n# x\n# y")
    got = {r.path.rsplit("/", 1)[1]: (r.title, r.text) for r in readers.read_texts(spark, str(tmp_path)).collect()}
    assert got["a_file-name.md"] == ("Only head", "# Only head\n\ntext") and got["b.txt"] == ("b", "中文内容") and got["c.txt"][0] == "Named"
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "1.json").write_text(json.dumps({"format": "f/notes", "version": 1, "paper": {"id": "d1"}, "notes": [{"id": "n-1", "kind": "ask", "created": "2024-01-01T00:00:00Z", "ask": {"q": "why"}}, {"id": "n-2", "text": "t"}]}))
    (tmp_path / "n" / "2.json").write_text("{broken")
    rows = {r.note_id: r for r in readers.read_notes(spark, str(tmp_path / "n"), ["f/notes"]).collect()}
    assert set(rows) == {"n-1", "n-2"} and rows["n-1"].thread[0].q == "why" and rows["n-2"].thread == []
    item = {"key": "K", "meta": {"parsedDate": "2020-05"}, "data": {"itemType": "preprint", "title": "T", "creators": [{"creatorType": "author", "firstName": "A", "lastName": "B"}, {"creatorType": "editor", "lastName": "E"}], "url": "https://arxiv.org/abs/2001.00001", "extra": "Citation Key: b20"}}
    b = readers.read_bibliography(spark.createDataFrame([(json.dumps(item),), (json.dumps({"key": "N", "data": {"itemType": "note"}}),)], "json string")).collect()
    assert [(r.key, r.authors, r.year, r.citekey, r.arxiv) for r in b] == [("K", ["B, A"], "2020", "b20", "2001.00001")]
    xml = "<article><front><article-meta><article-id pub-id-type='doi'>10.1/x</article-id><title-group><article-title>On it</article-title></title-group><contrib-group><contrib contrib-type='author'><name><surname>Lee</surname><given-names>Ann</given-names></name></contrib></contrib-group><pub-date><month>3</month><year>2020</year></pub-date></article-meta></front></article>"
    j = readers.read_jats_meta(spark.createDataFrame([(xml,)], "xml string")).first()
    assert (j.title, j.authors, j.doi, j.date) == ("On it", ["Ann Lee"], "10.1/x", "2020-03")


def test_article_xml_is_parsed_once(spark):
    """Each of seven paths parsed the article again, and given names and surnames were paired by place."""
    meta = lambda b: f"<?xml version='1.0' encoding='ISO-8859-1'?><!DOCTYPE article PUBLIC 'x' 'y'><article><front><article-meta>{b}</article-meta></front><body><article-title>no</article-title></body></article>"
    name = lambda kind, x: f"<contrib contrib-type='{kind}'><name>{x}</name></contrib>"
    people = name("author", "<surname>Only</surname>") + name("editor", "<surname>E</surname>") + name("author", "<surname>T<!-- c -->U<sup>1</sup></surname><given-names>H</given-names>") + name("author", "")
    rows = [
        (0, None), (1, "<a/>"), (2, meta("<article-title> A <i>b</i> &amp; <![CDATA[<c]]> é𝒳</article-title><t><article-title>two</article-title></t>")),
        (3, meta("<article-id pub-id-type='pmc'>9</article-id><article-id pub-id-type='doi'>10.1/x</article-id><article-id pub-id-type='doi'>10.1/y</article-id>")),
        (4, meta("<pub-date><day>7</day><month>00</month></pub-date><pub-date><year>2025</year></pub-date>")), (5, meta(people)),
        (6, meta("<pub-date><year>0000</year><month>0</month><day>12</day></pub-date><l xlink:href='https://creativecommons.org/licenses/by/4.0/'/>")),
    ]
    made = readers.read_jats_meta(spark.createDataFrame(rows, "k int, xml string"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("article_meta(") == 1 and "xpath" not in plan.lower()
    got = [(r.title, r.authors, r.doi, r.date, r.license) for r in made.orderBy("k").collect()]
    assert got == [
        (None, None, None, "", None), ("", [], "", "", ""), ("A b & <c é𝒳", [], "", "", ""), ("", [], "10.1/x", "", ""), ("", [], "", "07", ""),
        ("", ["Only", "H TU"], "", "", ""), ("", [], "", "12", "https://creativecommons.org/licenses/by/4.0/"),
    ]


def test_sinks(spark, tmp_path):
    u = spark.createDataFrame([(1, 0, "u0", "s0", "One. Two."), (2, 0, "u0", "s0", "Three.")], "doc_id long, pos int, unit_id string, section_id string, text string")
    lv = fold.local_levels(u)
    sinks.write_markdown(lv, "takeaway", str(tmp_path / "md"))
    assert sinks.read_packed(spark, str(tmp_path / "md"), 1) == [document_at(lv, "takeaway").where("doc_id = 1").first().text]
    sinks.write_doc_json(lv, spark.createDataFrame([(1, "T", "en"), (2, "U", "en")], "doc_id long, title string, lang string"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_link_and_translation_rules(spark):
    u = spark.createDataFrame([(1, i, f"u{i}", "s0" if i < 3 else "s1") for i in range(6)], "doc_id long, pos int, unit_id string, section_id string")
    r = [(1, 0, 0, 1, "supports"), (1, 1, 0, 2, "supports"), (1, 2, 0, 2, "details"), (1, 3, 2, 3, "contrasts"), (1, 4, 4, 4, "details"), (1, 5, 5, 9, "details"), (1, 6, 5, 0, "odd")]
    refs = spark.createDataFrame([(1, "u0", "u2", "ref", "a1"), (1, "u1", "u4", "ref", "a2")], "doc_id long, f string, t string, rel string, via string")
    got = links.merge_links(spark.createDataFrame(r, "doc_id long, seq int, f int, t int, rel string"), u, refs).collect()
    assert {(x.f, x.t, x.rel) for x in got} == {("u0", "u2", "supports"), ("u2", "u3", "contrasts"), ("u1", "u4", "ref")}
    sizes = spark.createDataFrame([(1, "s", i, 100) for i in range(10)], "doc_id long, section_id string, pos int, size int")
    assert [x.n for x in translate.translation_batches(sizes, 400).groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()] in ([3, 4, 3], [3, 3, 4], [4, 3, 3])


def test_calendar_and_streams(spark, tmp_path):
    n = spark.sql("SELECT 1L AS doc_id, timestamp'2024-02-01 23:30:00' AS created UNION ALL SELECT 1L, timestamp'2024-02-02 10:00:00'")
    assert {(r.doc_id, str(r.day), r.notes) for r in notes.notes_calendar(n, "Europe/Berlin").collect()} == {(1, "2024-02-02", 2), (None, "2024-02-02", 2)}
    docs = spark.createDataFrame([(1, "en", "One. Two.", "2024-01-01 00:00:00"), (1, "en", "One. Two.", "2024-01-01 00:00:01")], "doc_id long, lang string, text string, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    docs.write.parquet(str(tmp_path / "in"))
    stream = readers.stream_docs(spark, str(tmp_path / "in"), docs.schema)
    streams.run_to_table(streams.fold_stream(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_both_ways_to_sentence_ends_agree(spark):
    import random

    rng = random.Random(3)
    parts = ["Foo", "bar", ".", ". ", "?", "! ", ")", ") ", '"', '" ', "’", "1", "1. ", "etc", "A", "(", " (", "[x] ", " ", "e.g. ", "“Ab ", "é", "Dr. ", "\t", "x,"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 14)))) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, text string").withColumn("toks", T.tokens(F.col("text")))
    both = df.select("text", T._ends_by_code(F.col("toks")).alias("a"), T._ends_one_by_one(F.col("toks")).alias("b"))
    assert [r for r in both.collect() if r.a != r.b] == []
    assert both.where("size(a) > 1").count() > 500


def test_topics_of_chinese_lines():
    got = {t: cjk.topic_of(t) for t in ("我国对于数据保护的规定很多", "1.研究背景与意义", "本文的创新之处主要有三点", "文中几位作者认为第三方支付", "图 1—1 市场结构图", "的")}
    assert got == {
        "我国对于数据保护的规定很多": "数据保护的规定很", "1.研究背景与意义": "研究背景与意义", "本文的创新之处主要有三点": "本文的创新之处",
        "文中几位作者认为第三方支付": "文中几位作者认为", "图 1—1 市场结构图": "市场结构图", "的": "",
    }


def test_all_prompts_failed_is_an_error(spark):
    rows = [("a", None, "down"), ("b", None, "down")]
    done = spark.createDataFrame(rows, "cache_key string, out string, error string")
    with pytest.raises(RuntimeError, match="all 2 prompts failed: down"):
        fold.require_answers(done)
    assert fold.require_answers(done.where("cache_key = 'a'").unionByName(done.where("cache_key = 'b'").withColumn("error", F.lit(None).cast("string")))).count() == 2
