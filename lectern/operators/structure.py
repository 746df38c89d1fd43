"""Documents to sections and units; page Markdown cleaned; tables, captions, atoms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Headings by which a section is told.
ABSTRACT_NAMES = ("abstract", "summary", "zusammenfassung", "résumé", "resumen", "resumo", "摘要", "要旨", "초록", "аннотация")
REFERENCE_NAMES = (
    "references", "bibliography", "works cited", "literature cited", "literatur", "literaturverzeichnis", "références", "bibliographie", "referencias",
    "bibliografía", "referências", "bibliografia", "参考文献", "參考文獻", "참고문헌", "литература", "список литературы", "literatuur", "referenser",
)
LINK_ONLY_NAMES = ("see also", "external links", "further reading", "siehe auch", "weblinks", "voir aussi", "liens externes", "véase también", "enlaces externos")


def heading_parts(title: Column) -> tuple[Column, Column]:
    """(number, rest) of a heading: 3.2 Methods, IV. Results, Appendix B Proofs, 第二章 …."""
    rx = r"^\s*((?:\d+(?:\.\d+)*\.?|[IVXLC]+\.|[A-Z]\.(?:\d+\.?)*|(?i:appendix)\s+[A-Z0-9]+[.:]?|第[一二三四五六七八九十百\d]+[章节部分]))\s+(?=\S)"
    return F.regexp_replace(F.regexp_extract(title, rx, 1), r"[.:]$", ""), F.trim(F.regexp_replace(title, rx, ""))


def sections(blocks: DataFrame) -> DataFrame:
    """doc_id, section_id, num, title, level, parent, pos, end, is_appendix, is_references of documents' headings.

    blocks: doc_id, pos, kind (heading or other), level, text. Ranks count from the highest heading, four at most; the
    number is split off; ids are slugs with -2, -3 on repeats; text before the first heading is the section abstract, as
    is a heading of that name when no text comes before it. An appendix is inherited by what stands below it.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    top = F.min(F.when(F.col("kind") == "heading", F.col("level"))).over(Window.partitionBy("doc_id"))
    b = blocks.withColumn("rank", F.least(F.col("level") - top + 1, F.lit(4)))
    first = b.groupBy("doc_id").agg(F.min(F.struct("pos", "kind")).alias("x"), F.max("pos").alias("last"))
    lead = first.where("x.kind <> 'heading'").select("doc_id", F.col("x.pos").alias("pos"), F.lit("").alias("text"), F.lit(1).alias("rank"), F.lit(True).alias("lead"))
    h = b.where("kind = 'heading'").select("doc_id", "pos", "text", "rank", F.lit(False).alias("lead")).unionByName(lead)
    num, rest = heading_parts(F.col("text"))
    h = h.withColumns({"num": num, "title": rest}).withColumn("no_lead", ~F.max("lead").over(Window.partitionBy("doc_id")))
    slug = F.regexp_replace(F.regexp_replace(F.lower("title"), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    is_abs = F.col("lead") | (F.col("no_lead") & F.lower("title").isin(*ABSTRACT_NAMES))
    h = h.withColumn("slug", F.when(is_abs, "abstract").when(slug == "", "section").otherwise(slug))
    n = F.row_number().over(Window.partitionBy("doc_id", "slug").orderBy("pos"))
    h = h.withColumn("section_id", F.when(n > 1, F.concat("slug", F.lit("-"), n)).otherwise(F.col("slug")))
    above = [F.last(F.when(F.col("rank") == k, F.struct("pos", "section_id")), ignorenulls=True).over(w) for k in (1, 2, 3)]
    h = h.withColumns({f"at{k}": a for k, a in enumerate(above, 1)})
    parent = F.array_max(F.array(*[F.when(F.col("rank") > k, F.col(f"at{k}")) for k in (1, 2, 3)]))
    own = F.regexp_like("text", F.lit(r"(?i)^\s*appendi(?:x|ces)\b|^\s*附录|^\s*anhang\b|^\s*annexe?\b"))
    h = h.withColumns({"parent": parent["section_id"], "own_appendix": own})
    root = F.last(F.when(F.col("rank") == 1, F.col("own_appendix")), ignorenulls=True).over(w)
    end = F.lead("pos").over(w)
    h = h.withColumns({"end": end, "is_appendix": F.col("own_appendix") | F.coalesce(root, F.lit(False)), "is_references": F.lower("title").isin(*REFERENCE_NAMES)})
    return h.join(first.select("doc_id", "last"), "doc_id").select(
        "doc_id", "section_id", "num", "title", F.col("rank").alias("level"), "parent", "pos", F.coalesce("end", F.col("last") + 1).alias("end"), "is_appendix", "is_references"
    )


def units(blocks: DataFrame, secs: DataFrame) -> DataFrame:
    """doc_id, pos, unit_id, section_id, role, marker, depth, text: paragraphs, items and captions of each section, by an interval join.

    Headings, code and rules are no units; loose text before any section joins the first.
    """
    some = blocks.where("kind NOT IN ('heading', 'code', 'rule')")
    spans = secs.select("doc_id", F.col("pos").alias("s"), "end", "section_id")
    joined = some.join(spans, "doc_id", "left").where("(pos >= s AND pos < end) OR s IS NULL")
    first = secs.groupBy("doc_id").agg(F.min_by("section_id", "pos").alias("first"))
    role = F.when(F.col("section_id") == "abstract", "abstract").when(F.col("kind") == "item", "item").when(F.regexp_like("text", F.lit(r"^(?:Figure|Fig\.|Table|图|表)\s*\S+")), "caption").otherwise("para")
    marker = F.when(F.col("kind") == "item", F.regexp_extract("text", r"^\s*([-*+•]|\d+[.)])\s+", 1))
    text = F.when(F.col("kind") == "item", F.regexp_replace("text", r"^\s*(?:[-*+•]|\d+[.)])\s+", "")).otherwise(F.col("text"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    return joined.join(first, "doc_id", "left").withColumns({"role": role, "marker": marker, "depth": F.when(F.col("kind") == "item", F.floor(F.col("level") / 2) + 1), "clean": text, "n": n}).select(
        "doc_id", "pos", F.concat(F.lit("u"), "n").alias("unit_id"), F.coalesce("section_id", "first").alias("section_id"), "role", "marker", "depth", F.col("clean").alias("text")
    )


def front_matter(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts with fm_title, fm_authors, fm_date, fm_license from a head block: strings, lists and name mappings; comments off."""
    head = F.regexp_replace(F.regexp_extract(text, r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n(?:---|\.\.\.)[ \t]*(?:\r?\n|\z)", 1), r"(?m)[ \t]+#.*$", "")
    bare = lambda c: F.trim(F.regexp_replace(F.trim(c), r"""^(["'])(.*)\1$""", "$2"))
    value = lambda key: F.regexp_extract("_head", rf"(?m)^(?i:{key}):[ \t]*(?![|>]-?\s*$)(.*)$", 1)
    block = lambda key: F.trim(F.regexp_replace(F.regexp_extract("_head", rf"(?m)^(?i:{key}):[ \t]*[|>]-?[ \t]*\n((?:[ \t]+.*(?:\n|$))+)", 1), r"\s+", " "))
    under = F.regexp_extract("_head", r"(?m)^(?i:authors?):[ \t]*\n((?:[ \t]*-.*(?:\n|$)|[ \t]+.*(?:\n|$))+)", 1)
    given = F.regexp_extract_all(under, F.lit(r"(?m)given:[ \t]*(.+?)[ \t]*$"), F.lit(1))
    family = F.regexp_extract_all(under, F.lit(r"(?m)family:[ \t]*(.+?)[ \t]*$"), F.lit(1))
    named = F.regexp_extract_all(under, F.lit(r"(?m)name:[ \t]*(.+?)[ \t]*$"), F.lit(1))
    plain = F.filter(F.regexp_extract_all(under, F.lit(r"(?m)^[ \t]*-[ \t]*(.+?)[ \t]*$"), F.lit(1)), lambda x: ~F.regexp_like(x, F.lit(r"^\w+:")))
    one = value("authors?")
    flow = F.split(F.regexp_replace(one, r"^\[|\]\s*$", ""), r"\s*,\s*")
    authors = (
        F.when(F.size(family) > 0, F.zip_with(given, family, lambda g, f: F.concat_ws(" ", bare(g), bare(f)))).when(F.size(named) > 0, F.transform(named, bare))
        .when(F.size(plain) > 0, F.transform(plain, bare)).when(one.startswith("["), F.transform(flow, bare)).when(F.trim(one) != "", F.array(bare(one))).otherwise(F.array().cast("array<string>"))
    )
    return texts.withColumn("_head", head).withColumns({
        "fm_title": F.coalesce(F.nullif(block("title"), F.lit("")), bare(value("title"))), "fm_authors": authors,
        "fm_date": bare(value("date")), "fm_license": bare(value("licen[cs]e")),
    }).drop("_head")


def rejoin(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks with words that a line broke rejoined, and headings set on two lines merged unless numbered or a known section.

    "communica- tion" joins; a hyphen after capitals only ("OCR- free") stays, without its space.
    """
    text = F.regexp_replace("text", r"(?<=\p{Ll})- (?=\p{Ll})", "")
    b = blocks.withColumn("text", F.regexp_replace(text, r"(?<=\p{Lu})- (?=\p{L})", "-"))
    w = Window.partitionBy(*keys).orderBy("block")
    body = F.regexp_replace("text", r"^#+\s*", "")
    known = F.lower(body).isin(*ABSTRACT_NAMES, *REFERENCE_NAMES) | F.regexp_like(body, F.lit(r"^(?:\d+(?:\.\d+)*\.?|[IVX]+\.)\s"))
    b = b.withColumns({"_k": known, "_b": body})
    joins = (F.col("kind") == "heading") & (F.lag("kind").over(w) == "heading") & (F.lag("level").over(w) == F.col("level")) & ~F.col("_k") & ~F.lag("_k").over(w)
    b = b.withColumn("_i", F.sum((~F.coalesce(joins, F.lit(False))).cast("int")).over(w))
    return b.groupBy(*keys, "_i").agg(
        F.min("block").alias("block"), F.min_by("kind", "block").alias("kind"), F.min_by("level", "block").alias("level"),
        F.array_join(F.array_sort(F.collect_list(F.struct("block", F.when(F.col("kind") == "heading", F.col("_b")).otherwise(F.col("text")).alias("t")))).getField("t"), " ").alias("text"),
    ).drop("_i")


def drop_running_heads(blocks: DataFrame, share: float = 0.5, least: int = 3, words: int = 20) -> DataFrame:
    """blocks (doc_id, page, block, text) without running heads, page numbers and preprint stamps.

    A page's first block of 20 words or fewer, digits as #, that begins at least max(3, half) of its document's pages goes.
    """
    shape = F.regexp_replace("text", r"\d+", "#")
    first = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("block")) == 1
    b = blocks.withColumns({"_shape": shape, "_first": first, "_n": F.regexp_count("text", F.lit(r"[^\s]+"))})
    pages = blocks.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    often = b.where(F.col("_first") & (F.col("_n") <= words)).groupBy("doc_id", "_shape").agg(F.count(F.lit(1)).alias("times"))
    heads = often.join(pages, "doc_id").where(F.col("times") >= F.greatest(F.lit(least), F.col("pages") * share)).select("doc_id", "_shape", F.lit(True).alias("_first"))
    number = F.regexp_like("text", F.lit(r"^\s*[-–]?\s*\d+\s*[-–]?\s*$"))
    stamp = F.regexp_like("text", F.lit(r"^\s*arXiv:\d{4}\.\d{4,5}(?:v\d+)?\s*\[[\w.-]+\]"))
    return b.join(heads, ["doc_id", "_shape", "_first"], "left_anti").where(~number & ~stamp).select(*blocks.columns)


def pick_title(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id, title: of page one's headings before the first section the one that shares 60 % of words with the file's title, else the highest and longest.

    blocks: doc_id, page, block, kind, level, text; files: doc_id, title. A title has 8 to 300 characters, two words or more,
    and most of them mostly letters.
    """
    body = F.trim(F.regexp_replace("text", r"^#+\s*", ""))
    h = blocks.where("page = 1 AND kind = 'heading'").withColumn("t", body)
    section = F.regexp_like("t", F.lit(r"^(?:\d+(?:\.\d+)*\.?|[IVX]+\.)\s")) | F.lower("t").isin(*ABSTRACT_NAMES, "introduction")
    w = Window.partitionBy("doc_id").orderBy("block")
    h = h.withColumn("_s", F.sum(section.cast("int")).over(w)).where("_s = 0")
    toks = F.filter(F.split("t", r"\s+"), lambda x: x != "")
    good = F.filter(toks, lambda x: F.regexp_count(x, F.lit(r"\p{L}")) >= 0.8 * F.length(x))
    fair = F.length("t").between(8, 300) & (F.size(toks) >= 2) & (F.size(good) >= 0.6 * F.size(toks))
    bag = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    j = h.where(fair).join(files.select("doc_id", F.col("title").alias("f")), "doc_id", "left").withColumns({"a": bag(F.col("t")), "b": bag(F.coalesce("f", F.lit("")))})
    like = F.size(F.array_intersect("a", "b")) >= 0.6 * F.size(F.array_union("a", "b"))
    return j.groupBy("doc_id").agg(F.min_by("t", F.struct((~like).cast("int").alias("k"), "level", (-F.length("t")).alias("n"), "block")).alias("title"))


def caption_labels(blocks: DataFrame) -> DataFrame:
    """blocks with label and caption: "Figure 3:", "Table S2.", "Extended Data Fig. 1 |", 图 1, 表 2 and the like split off."""
    rx = r"^\s*((?:(?:Extended Data|Supplementary|Supplemental)\s+)?(?:Figure|Fig\.?|Table|Tab\.?|Algorithm|Scheme|Box|Abbildung|Abb\.?|Tabelle|Figura|Tabla|Tableau|Cuadro)\s*[A-Z]?\d+(?:[.\-–—]\d+)*[a-z]?|[图表圖]\s*\d+(?:[.\-–—]\d+)*)\s*[:.|：．、]?\s*"
    return blocks.withColumns({"label": F.nullif(F.regexp_extract("text", rx, 1), F.lit("")), "caption": F.regexp_replace("text", rx, "")})


def split_references(units_: DataFrame, secs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prose units, doc_id, bib, text): reference and link-only sections set apart from prose; works are numbered bib1.. in order."""
    names = [*REFERENCE_NAMES, *LINK_ONLY_NAMES]
    apart = secs.where(F.lower("title").isin(*names)).select("doc_id", "section_id", F.lower("title").isin(*REFERENCE_NAMES).alias("works"))
    prose = units_.join(apart, ["doc_id", "section_id"], "left_anti")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    works = units_.join(apart.where("works"), ["doc_id", "section_id"], "left_semi").select("doc_id", F.concat(F.lit("bib"), n).alias("bib"), "text")
    return prose, works


def classify_tables(cells: DataFrame, most_chars: int = 1500, most_tables: int = 3) -> tuple[DataFrame, DataFrame]:
    """(doc_id, table_id, kind), (doc_id, section_id, table_id, text): layout, list or data; data as rows of " | ", cut at 1,500 characters, three a section.

    cells: doc_id, section_id, table_id, row, col, text, has_picture. Limits belong to the prompt the text goes to.
    """
    words = F.regexp_count("text", F.lit(r"[^\s]+"))
    t = cells.withColumn("n", words).groupBy("doc_id", "table_id").agg(
        (F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"), F.bool_or("has_picture").alias("pic"), F.max("n").alias("most"),
        F.max(F.when(F.col("col") == 0, F.col("n"))).alias("name"), F.avg(F.when(F.col("col") == 1, F.col("n"))).alias("def"),
    )
    kind = F.when((F.col("rows") <= 3) & (F.col("cols") <= 3) & (F.col("pic") | (F.col("most") >= 30)), "layout").when((F.col("cols") == 2) & (F.col("name") <= 6) & (F.col("def") >= 8), "list").otherwise("data")
    kinds = t.select("doc_id", "table_id", kind.alias("kind"))
    rows = cells.groupBy("doc_id", "section_id", "table_id", "row").agg(F.array_join(F.array_sort(F.collect_list(F.struct("col", "text"))).getField("text"), " | ").alias("r"))
    full = rows.groupBy("doc_id", "section_id", "table_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("row", "r"))).getField("r"), "\n").alias("text"))
    data = full.join(kinds.where("kind = 'data'"), ["doc_id", "table_id"], "left_semi")
    n = F.row_number().over(Window.partitionBy("doc_id", "section_id").orderBy("table_id"))
    cut = F.when(F.length("text") > most_chars, F.concat(F.substring("text", 1, most_chars), F.lit(" …"))).otherwise(F.col("text"))
    return kinds, data.withColumn("n", n).where(F.col("n") <= most_tables).select("doc_id", "section_id", "table_id", cut.alias("text"))


def atoms(units_: DataFrame) -> DataFrame:
    """doc_id, atom_id, pos, kind, alt: formulas, citations, references and notes of units, numbered in reading order."""
    rx = r"(\$[^$\n]+\$|\[\d+(?:[,–-]\s*\d+)*\]|\(#[\w.-]+\)|\[\^[\w-]+\])"
    found = units_.select("doc_id", "pos", F.posexplode(F.regexp_extract_all("text", F.lit(rx), F.lit(1))).alias("i", "alt"))
    kind = F.when(F.col("alt").startswith("$"), "math").when(F.col("alt").startswith("[^"), "note").when(F.col("alt").startswith("["), "cite").otherwise("ref")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "i"))
    return found.select("doc_id", F.concat(F.lit("a"), n).alias("atom_id"), "pos", kind.alias("kind"), "alt")


def align_words(lines: DataFrame) -> DataFrame:
    """doc_id, pos, line_tok, source_tok: each written word's source word, by the longest common run of normalised words.

    lines: doc_id, pos, line, source (texts of one unit, so an Arrow batch holds whole units). Words are normalised by
    expressions; only the alignment itself, which is sequential, is Python.
    """
    import pandas as pd

    norm = lambda c: T.terms(F.col(c))

    def run(batches):
        for pdf in batches:
            rows = []
            for doc, pos, a, b in pdf[["doc_id", "pos", "a", "b"]].itertuples(index=False):
                a, b = list(a), list(b)
                best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
                for i in reversed(range(len(a))):
                    for j in reversed(range(len(b))):
                        hit = a[i] != "" and a[i] == b[j]
                        best[i][j] = best[i + 1][j + 1] + 1 if hit else max(best[i + 1][j], best[i][j + 1])
                i = j = 0
                while i < len(a) and j < len(b):
                    if a[i] != "" and a[i] == b[j]:
                        rows.append((doc, pos, i, j))
                        i, j = i + 1, j + 1
                    elif best[i + 1][j] >= best[i][j + 1]:
                        i += 1
                    else:
                        j += 1
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "line_tok", "source_tok"])

    made = lines.select("doc_id", "pos", norm("line").alias("a"), norm("source").alias("b"))
    return made.mapInPandas(run, "doc_id long, pos int, line_tok int, source_tok int")
