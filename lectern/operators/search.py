"""Retrieval, search, citations, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Words and character pairs that say nothing about where an answer is.
QUERY_STOP = (
    "the a an of and or to in on for with by at from as is are was were be been this that these those it its we our their they"
    " which what who how why when where does do did can could would should may might not no than then there here into about"
    " over under also such only more most less very mean means meaning"
).split()
PAIR_STOP = (
    "什么 是什 么意 意思 么是 怎么 怎样 为什 如何 哪些 哪个 这个 那个 这里 这些 那些 是否 能否 可以 一下 解释 请问 指的 是指 含义"
    " 為什 甚麼 這個 這裡 とは 何で 何を どう どう いう 意味 です すか って 무엇 의미 뭐야 이것"
).split()
_WIDE = r"[぀-ヿ㐀-鿿가-힯]"
CITE = r"\[\[\s*([^\[\]]+?)\s*\]\]"


# Fixed value: what counts as a term of a question.
TERM = r"([a-z][a-z0-9]*(?:[=<>≤≥]\d+)?|\d+(?:\.\d+)?)"


def query_terms(text: Column) -> Column:
    """array<string>: the words a question can be matched on, with repeats: Latin words, numbers, forms as d=4, CJK pairs."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(1))
    latin = F.filter(found, lambda w: ~w.isin(*QUERY_STOP) & (F.length(w) > 1))
    runs = F.regexp_extract_all(text, F.lit(rf"({_WIDE}{{2,}})"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.concat(latin, F.filter(pairs, lambda p: ~p.isin(*PAIR_STOP)))


def retrieve(units: DataFrame, queries: DataFrame, k: int = 5, skip: DataFrame | None = None) -> DataFrame:
    """doc_id, query_id, pos, score, rank: each query's best units of its document by summed ln(n / df) of shared terms.

    units: doc_id, pos, text; queries: query_id, doc_id, query; skip: query_id, pos left out. Scores of zero are no hit;
    ties go by reading order. k is the feature's limit.
    """
    bags = units.select("doc_id", "pos", F.explode(F.array_distinct(query_terms(F.col("text")))).alias("term"))
    n = units.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    df = bags.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("df"))
    asked = queries.select("query_id", "doc_id", F.explode(F.array_distinct(query_terms(F.col("query")))).alias("term"))
    weighed = asked.join(df, ["doc_id", "term"]).join(n, "doc_id").withColumn("w", F.log(F.col("n") / F.col("df")))
    hits = weighed.join(bags, ["doc_id", "term"])
    if skip is not None:
        hits = hits.join(skip.select("query_id", "pos"), ["query_id", "pos"], "left_anti")
    scored = hits.groupBy("doc_id", "query_id", "pos").agg(F.round(F.sum("w"), 9).alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pos"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def fold_accents(text: Column) -> Column:
    """Lower case without accents, a character for a character."""
    plain = {"àáâãäåāăą": "a", "çćĉċč": "c", "ďđ": "d", "èéêëēĕėęě": "e", "ìíîïĩīĭįı": "i", "ñńņň": "n", "òóôõöøōŏő": "o", "ùúûüũūŭůűų": "u", "ýÿŷ": "y", "śŝşš": "s", "źżž": "z", "ĝğġģ": "g", "ţťŧ": "t", "ŕŗř": "r", "ĺļľŀł": "l"}
    return F.translate(F.lower(text), "".join(plain), "".join(v * len(k) for k, v in plain.items()))


def find(levels: DataFrame, query: str, level: str = "full", sections: DataFrame | None = None) -> DataFrame:
    """doc_id, pos, place, start: non-overlapping hits of a query, accents, case and runs of white space aside.

    levels: doc_id, pos, full and the level's column. place is the level for a hit in its text; `open` for one in
    the full text that the level leaves out; `section` for a section (doc_id, pos, title) whose title holds the query (start
    null). A hit of the full text counts as shown if the level's text stands in the full text and covers its start.
    """
    words = " ".join(query.split())
    if not words:
        return levels.select("doc_id", "pos", F.lit("").alias("place"), F.lit(0).alias("start")).where("false")
    needle = fold_accents(F.lit(words))
    flat = lambda c: fold_accents(F.regexp_replace(F.trim(c), r"\s+", " "))
    sides = [(level, level)] + ([("open", "full")] if level != "full" else [])
    folded = levels.select("doc_id", "pos", *[flat(F.col(c)).alias(f"_{p}") for p, c in sides])
    each = F.array(*[F.struct(F.lit(p).alias("place"), F.col(f"_{p}").alias("text")) for p, _ in sides])
    rows = folded.select("doc_id", "pos", F.instr("_open", F.col(f"_{level}")).alias("at") if level != "full" else F.lit(0).alias("at"), F.length(f"_{level}").alias("n"), F.explode(each).alias("x"))
    rows = rows.where(F.contains("x.text", needle)).withColumn("id", F.struct("doc_id", "pos", "x.place"))
    # A hit starts where the parts before it end; a running sum adds them up.
    parts = rows.select("id", "at", "n", F.posexplode(F.split("x.text", F.concat(F.lit("\\Q"), needle, F.lit("\\E")))).alias("i", "part"))
    upto = F.sum(F.length("part")).over(Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    hits = parts.withColumn("start", (upto + (F.col("i") - 1) * F.length(needle)).cast("int")).where("i > 0")
    covered = (F.col("at") > 0) & (F.col("start") >= F.col("at") - 1) & (F.col("start") < F.col("at") - 1 + F.col("n"))
    out = hits.where((F.col("id.place") == level) | ~covered).select("id.doc_id", "id.pos", "id.place", "start")
    if sections is None:
        return out
    titled = sections.where(F.contains(flat(F.col("title")), needle)).select("doc_id", "pos", F.lit("section").alias("place"), F.lit(None).cast("int").alias("start"))
    return out.unionByName(titled)


def search_library(docs: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows of docs in whose columns, read as one text, every word of the query occurs, accents and case aside."""
    hay = fold_accents(F.concat_ws(" ", *[F.col(c) for c in columns]))
    out = docs
    for word in query.split():
        out = out.where(hay.contains(fold_accents(F.lit(word))))
    return out


def filter_notes(notes: DataFrame, kind: str = "all", query: str = "", used: DataFrame | None = None, days: list[str] | None = None, tz: str = "UTC") -> DataFrame:
    """Notes by kind (all, new: in no record yet, ask, note, hl), by words in any of their texts, and by local day."""
    out = notes
    if kind == "new":
        if used is None:
            raise ValueError("new notes are those in no record: give the used ones")
        out = out.join(used.select("doc_id", "note_id").distinct(), ["doc_id", "note_id"], "left_anti")
    elif kind != "all":
        out = out.where(F.col("kind") == kind)
    if query:
        hay = fold_accents(F.concat_ws(" ", "text", "quote", "question", "answer", "title"))
        for word in query.split():
            out = out.where(hay.contains(fold_accents(F.lit(word))))
    if days is not None:
        out = out.where(F.to_date(F.from_utc_timestamp("created", tz)).cast("string").isin(*days))
    return out


def pack_context(units: DataFrame, most_tokens: int = 60_000, most_chars: int = 60_000, caps: tuple[int, ...] = (1_000_000, 12, 6, 3, 0)) -> DataFrame:
    """doc_id, whole, cap: whether a document fits in full, and else the most units a section whose map fits.

    units: doc_id, section_id, pos, text, line (the unit's short line). Sizes are the map's characters with its marks.
    """
    wide = F.regexp_count(F.col("text"), F.lit(_WIDE))
    sized = units.select("doc_id", "section_id", "pos", F.length("line").alias("n"), F.length("text").alias("len"), wide.alias("wide"))
    place = F.row_number().over(Window.partitionBy("doc_id", "section_id").orderBy("pos"))
    ranked = sized.withColumn("place", place)
    mark = F.length(F.col("pos").cast("string")) + 4
    chars = [F.sum(F.when(F.col("place") <= c, F.col("n") + mark).otherwise(0)).alias(f"c{k}") for k, c in enumerate(caps)]
    sums = ranked.groupBy("doc_id").agg(F.sum("wide").alias("wide"), F.sum("len").alias("len"), *chars)
    fits = F.array_compact(F.array(*[F.when(F.col(f"c{k}") <= most_chars, F.lit(c)) for k, c in enumerate(caps)]))
    tokens = F.col("wide") + F.floor((F.col("len") - F.col("wide")) / 4)
    return sums.select("doc_id", (tokens <= most_tokens).alias("whole"), F.coalesce(F.array_max(fits), F.lit(0)).alias("cap"))


def resolve_citations(answers: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answer_id, answer) with citations rewritten, and (answer_id, target, place) of what they cite, in first-cited order.

    answers: answer_id, doc_id, answer; targets: doc_id, num, target. [[12]] and [[a, b]] become [[target]] each; [[?]]
    stays; a number or id that names nothing becomes [[!n]].
    """
    rest = F.split("answer", CITE)
    cited = F.regexp_extract_all("answer", F.lit(CITE), F.lit(1))
    pieces = answers.select("answer_id", "doc_id", rest.alias("rest"), cited.alias("cited"))
    one = pieces.select("answer_id", "doc_id", F.posexplode_outer("cited").alias("i", "c"))
    names = one.select("answer_id", "doc_id", "i", F.posexplode_outer(F.split("c", r"[,;，；]\s*")).alias("j", "name"))
    names = names.withColumn("name", F.regexp_replace(F.trim("name"), "^#+", "")).where("name <> ''")
    by_num = targets.select("doc_id", F.col("num").cast("string").alias("name"), "target")
    by_id = targets.select("doc_id", F.col("target").alias("name"), "target")
    known = by_num.unionByName(by_id).dropDuplicates(["doc_id", "name"])
    found = names.join(known, ["doc_id", "name"], "left")
    shown = F.when(F.col("name") == "?", "[[?]]").when(F.col("target").isNull(), F.concat(F.lit("[[!"), "name", F.lit("]]"))).otherwise(F.concat(F.lit("[["), "target", F.lit("]]")))
    marks = found.groupBy("answer_id", "i").agg(F.array_join(F.array_sort(F.collect_list(F.struct("j", shown.alias("s")))).getField("s"), "").alias("s"))
    listed = marks.groupBy("answer_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "s"))).alias("m"))
    text = F.array_join(F.transform("rest", lambda r, i: F.concat(r, F.coalesce(F.get(F.transform(F.array(i), lambda x: F.try_element_at("m", x)), F.lit(0)), F.lit("")))), "")
    answered = pieces.join(listed, "answer_id", "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<int,string>")))
    cites = found.where("target IS NOT NULL").groupBy("answer_id", "target").agg(F.min(F.struct("i", "j")).alias("at"))
    place = F.row_number().over(Window.partitionBy("answer_id").orderBy("at"))
    return answered.select("answer_id", text.alias("answer")), cites.select("answer_id", "target", place.alias("place"))


def resolve_tags(answers: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answer_id, answer) with a record's own citations rewritten, and (answer_id, target, place) of what they name.

    answers: answer_id, record_id, answer; tags: record_id, tag, target. [3] names a picked note and [T1.3] a section of
    a text; each becomes [target], and one that names nothing is left out.
    """
    mark = r"\[(\d{1,3}|T\d{1,2}\.\d{1,3})\]"
    pieces = answers.select("answer_id", "record_id", F.split("answer", mark).alias("rest"), F.regexp_extract_all("answer", F.lit(mark), F.lit(1)).alias("cited"))
    named = pieces.select("answer_id", "record_id", F.posexplode("cited").alias("i", "tag")).join(tags.dropDuplicates(["record_id", "tag"]), ["record_id", "tag"])
    known = named.groupBy("answer_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "target"))).alias("m"))
    shown = lambda i: F.coalesce(F.concat(F.lit("["), F.try_element_at("m", i), F.lit("]")), F.lit(""))
    text = F.array_join(F.transform("rest", lambda r, i: F.concat(r, shown(i))), "")
    first = named.groupBy("answer_id", "target").agg(F.min("i").alias("i"))
    place = F.row_number().over(Window.partitionBy("answer_id").orderBy("i"))
    return pieces.join(known, "answer_id", "left").select("answer_id", text.alias("answer")), first.select("answer_id", "target", place.alias("place"))


def with_shingles(df: DataFrame, width: int = 4, chars: int = 6) -> DataFrame:
    """df with shingles: hashes of the distinct runs of four words of text, or of six characters where over a quarter is CJK.

    Lower case, single spaces; a text under four words has none. Words are a column of their own: inside a lambda they
    would be split anew for every run.
    """
    flat = df.withColumn("_s", F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))))
    cut = flat.withColumns({"_words": F.split("_s", " "), "_dense": F.replace("_s", F.lit(" "), F.lit(""))})
    run = F.transform(F.sequence(F.lit(1), F.size("_words") - width + 1), lambda i: F.xxhash64(F.array_join(F.slice("_words", i, F.lit(width)), " ")))
    piece = F.transform(F.sequence(F.lit(1), F.greatest(F.length("_dense") - chars + 1, F.lit(1))), lambda i: F.xxhash64(F.substring("_dense", i, F.lit(chars))))
    wide = F.regexp_count("_dense", F.lit(f"[{T.CJK}]")) > F.length("_dense") / 4
    some = F.when(wide, piece).when(F.size("_words") >= width, run).otherwise(F.array().cast("array<bigint>"))
    return cut.withColumn("shingles", F.array_distinct(some)).drop("_s", "_words", "_dense")


#: Passages' shingles up to which they are broadcast to the texts' ones.
BROADCAST_SHINGLES = 500_000


def contains_passage(docs: DataFrame, passages: DataFrame, share: float = 0.6) -> DataFrame:
    """doc_id, item_id, shared, total: documents that hold at least `share` of a passage's distinct shingles.

    A text that holds `share` of a passage's n shingles misses at most n - ceil(share n) of them, so it holds one of any
    n - ceil(share n) + 1. Of each passage its rarest so many, by the number of documents that hold them, are the index: only documents
    that hold one of these are candidates, and their shingles are compared as arrays. A shingle that all texts and passages share
    is no index entry unless a passage has no rarer ones. Shingles travel as hashes; those that are in no passage are dropped
    where they are made, as long as the passages' are few enough to be broadcast, else by a join.
    """
    # explode_outer: explode would bring a condition on the arrays, which would be made once more for it.
    listed = with_shingles(passages.select("item_id", "text")).select("item_id", F.explode_outer("shingles").alias("h")).where("h IS NOT NULL")
    theirs = listed.groupBy("item_id").agg(F.collect_list("h").alias("shingles"), F.count(F.lit(1)).alias("total"))
    asked = listed.select("h").distinct()
    asked = F.broadcast(asked) if listed.count() <= BROADCAST_SHINGLES else asked
    ours = with_shingles(docs.select("doc_id", "text")).select("doc_id", F.explode_outer("shingles").alias("h")).join(asked, "h", "left_semi")
    held = ours.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    rarest = F.row_number().over(Window.partitionBy("item_id").orderBy("df", "h"))
    total = F.count(F.lit(1)).over(Window.partitionBy("item_id"))
    # A shingle that no document holds is the rarest there is, and finds nothing.
    ranked = listed.join(held, "h", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumns({"_r": rarest, "_total": total})
    needed = F.col("_total") - F.ceil(F.lit(share) * F.col("_total")) + 1
    index = ranked.where((F.col("_r") <= needed) & (F.col("df") > 0)).select("h", "item_id")
    candidates = ours.join(index, "h").select("doc_id", "item_id").distinct()
    arrays = ours.groupBy("doc_id").agg(F.collect_list("h").alias("_ours"))
    both = candidates.join(arrays, "doc_id").join(theirs, "item_id").withColumn("shared", F.size(F.array_intersect("_ours", "shingles")).cast("long"))
    return both.where(F.col("shared") >= F.lit(share) * F.col("total")).select("doc_id", "item_id", "shared", "total")
