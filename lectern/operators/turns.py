"""Markdown blocks and the folding of chat turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# What a stop behind does not end a sentence.
REPLY_ABBREVIATIONS = "e.g i.e etc vs cf Dr Mr Mrs Ms Prof St Fig No".split()
FOLD_LEVELS = (2, 3, 4, 5)


def markdown_blocks(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, block, kind, level, text: heading, code, rule, table, quote, item, paragraph, by gaps and islands over lines.

    A fence opens and closes code; a paragraph ends at a blank line, an item, a heading or a table. level is a heading's
    depth or an item's indent.
    """
    w = Window.partitionBy(*keys).orderBy("ln")
    lines = df.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("ln", "line"))
    fence = F.regexp_like("line", F.lit(r"^\s*(```|~~~)"))
    lines = lines.withColumn("fence", fence).withColumn("fences", F.sum(F.col("fence").cast("int")).over(w))
    inside = (F.col("fences") % 2 == 1) | F.col("fence")
    table = F.regexp_like("line", F.lit(r"\|")) & F.regexp_like(F.coalesce(F.lead("line").over(w), F.lit("")), F.lit(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)+\|?\s*$"))
    kind = (
        F.when(inside, "code").when(F.trim("line") == "", "blank").when(F.regexp_like("line", F.lit(r"^#{1,6}\s")), "heading")
        .when(F.regexp_like("line", F.lit(r"^\s*([-*_])(\s*\1){2,}\s*$")), "rule").when(F.regexp_like("line", F.lit(r"^\s*>")), "quote")
        .when(F.regexp_like("line", F.lit(r"^\s*([-*+•]|\d+[.)])\s+")), "item").when(table | F.regexp_like("line", F.lit(r"^\s*\|.*\|\s*$")), "table").otherwise("text")
    )
    lines = lines.withColumn("kind", kind).withColumn("prev", F.lag("kind").over(w))
    # A text line goes on with the paragraph, item or quote before it.
    goes_on = (F.col("kind") == F.col("prev")) & F.col("kind").isin("code", "table", "quote", "text") | (F.col("kind") == "text") & F.col("prev").isin("item", "quote")
    opens = F.col("fence") & (F.col("fences") % 2 == 1)
    lines = lines.withColumn("block", F.sum((~F.coalesce(goes_on, F.lit(False)) | opens).cast("int")).over(w))
    made = lines.where("kind <> 'blank'").groupBy(*keys, "block").agg(
        F.min_by("kind", "ln").alias("kind"), F.array_join(F.array_sort(F.collect_list(F.struct("ln", "line"))).getField("line"), "\n").alias("text")
    )
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("text", r"^(#+)", 1))).when(F.col("kind") == "item", F.length(F.regexp_extract("text", r"^(\s*)", 1)))
    return made.select(*keys, "block", F.when(F.col("kind") == "text", "paragraph").otherwise(F.col("kind")).alias("kind"), level.alias("level"), "text")


def first_sentences(text: Column, n: int, every_stop: bool = False) -> Column:
    """The first n sentences: stops with closers before white space, or CJK stops; not in code spans or behind abbreviations.

    What is cut open (bold, code) is closed. every_stop: stops behind abbreviations and initials end a sentence too.
    """
    short = "|".join(a.replace(".", r"\.") for a in REPLY_ABBREVIATIONS)
    kept = "" if every_stop else rf"(?<![\p{{L}}.])(?:{short})\.|(?<=\s|^)\p{{Lu}}\.(?=\s)|"
    unit = rf"(?:`[^`]*`|{kept}[.!?]+(?![)\]\"'”’*_]*(?:\s|$))|[^.!?。！？])"
    one = rf"{unit}*+(?:[.!?]+[)\]\"'”’*_]*(?=\s|$)|[。！？]+[」』”’）)]*|$)"
    flat = F.trim(F.regexp_replace(text, r"\s*\n\s*", " "))
    head = F.trim(F.regexp_extract(flat, rf"^((?:\s*{one}){{1,{n}}})", 1))
    ticks = F.length(head) - F.length(F.replace(head, F.lit("`"), F.lit("")))
    bold = F.length(head) - F.length(F.replace(head, F.lit("**"), F.lit("*")))
    return F.concat(head, F.when(ticks % 2 == 1, F.lit("`")).otherwise(F.lit("")), F.when(bold % 2 == 1, F.lit("**")).otherwise(F.lit("")))


def fold_turns(turns: DataFrame, keys: list[str], level: int, every_stop: bool = False) -> DataFrame:
    """keys, shown: each turn folded. 2: two sentences a paragraph, each item's first; 3: one sentence, top items; 4: headings
    with the first sentence under each, or level 3 without headings; 5: the first sentence of all. " …" where more follows.

    Tables are whole; code of over 8 lines becomes a line that counts them. every_stop: as in first_sentences.
    """
    if level not in FOLD_LEVELS:
        raise ValueError("level is 2, 3, 4 or 5")
    w = Window.partitionBy(*keys).orderBy("block")
    b = markdown_blocks(turns, keys).withColumn("heads", F.sum((F.col("kind") == "heading").cast("int")).over(w))
    b = b.withColumn("any_head", F.max("heads").over(Window.partitionBy(*keys)))
    prose = F.col("kind").isin("paragraph", "quote", "item")
    under = F.sum(prose.cast("int")).over(Window.partitionBy(*keys, "heads").orderBy("block"))
    nth = F.sum(prose.cast("int")).over(w)
    b = b.withColumns({"under": under, "nth": nth})

    def cut(n: int) -> Column:
        head = first_sentences(F.col("text"), n, every_stop)
        whole = F.trim(F.regexp_replace("text", r"\s*\n\s*", " "))
        return F.when(head == whole, head).otherwise(F.concat(head, F.lit(" …")))

    lines = F.size(F.split("text", "\n"))
    code = F.when(lines > 10, F.concat(F.lit("["), (lines - 2).cast("string"), F.lit(" lines of code]"))).otherwise(F.col("text"))
    rest = F.when(F.col("kind") == "code", code).when(F.col("kind").isin("table", "heading"), F.col("text"))
    two = F.when(F.col("kind").isin("paragraph", "quote"), cut(2)).when(F.col("kind") == "item", cut(1)).otherwise(rest)
    three = F.when(F.col("kind").isin("paragraph", "quote"), cut(1)).when((F.col("kind") == "item") & (F.col("level") == 0), cut(1)).when(F.col("kind") != "item", rest)
    four = F.when(F.col("kind") == "heading", F.col("text")).when(prose & (F.col("under") == 1), cut(1))
    shown = {2: two, 3: three, 4: F.when(F.col("any_head") > 0, four).otherwise(three), 5: F.when(prose & (F.col("nth") == 1), cut(1))}[level]
    gap = F.when(F.col("kind") == "item", F.lit("\n")).otherwise(F.lit("\n\n"))
    rows = b.select(*keys, "block", F.when(shown.isNotNull(), F.struct("block", F.concat(gap, shown).alias("s"))).alias("x"))
    made = rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("x")).getField("s"), "").alias("s"))
    return turns.select(*keys).join(made, keys, "left").select(*keys, F.regexp_replace(F.coalesce("s", F.lit("")), r"^\n+", "").alias("shown"))


def effort(text: Column) -> Column:
    """Reading effort: words outside code, CJK characters 1 / 1.6 each."""
    prose = F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", " "), r"`[^`\n]*`", " ")
    return F.regexp_count(prose, F.lit(f"[{T.CJK}]")) / 1.6 + F.regexp_count(prose, F.lit(rf"[\p{{L}}\p{{N}}_&&[^{T.CJK}]]+(?:['’\-][\p{{L}}\p{{N}}_&&[^{T.CJK}]]+)*"))


def fold_share(turns: DataFrame, keys: list[str], level: int, every_stop: bool = False) -> DataFrame:
    """keys, total, shown_words: words of each turn and of its fold. every_stop: as in first_sentences."""
    folded = fold_turns(turns, keys, level, every_stop)
    return turns.join(folded, keys).select(*keys, effort(F.coalesce("text", F.lit(""))).alias("total"), effort(F.regexp_replace("shown", " …", "")).alias("shown_words"))


def worth_folding(turns: DataFrame, keys: list[str], level: int, least: float = 80, hidden: float = 0.25, every_stop: bool = False) -> DataFrame:
    """The keys of turns that take 80 words' effort or more and of which the fold hides a quarter or more."""
    s = fold_share(turns, keys, level, every_stop)
    return s.where((F.col("total") >= least) & (F.col("shown_words") <= (1 - hidden) * F.col("total"))).select(*keys)
