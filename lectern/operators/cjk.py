"""Folding rules for Chinese and Japanese texts: claim sentences, clause cuts, topics, tails cut by a page."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .fold import CJK_BUDGET, flag_apparatus
from .segment import with_sentences

# Marks and words that decide results.
CLAIM_WORDS = "认为 主张 应当 应该 需要 必须 旨在 在于 而是 可见 因此 所以 证明 表明 说明 标志 意味着 构成 属于 界定 确立 即：".split()
CONDITION_LEADS = "而如果 如果 若 倘若 假如 尽管 虽然 由于 随着 鉴于 但是".split()
FILLERS = (
    "随着 根据 由于 因此 但是 而且 并且 不过 然而 所以 如果 虽然 尽管 目前 首先 其次 再次 最后 此外 另外 同时 综上 总之 基于 鉴于 针对 对于 关于"
    " 近年来 当前 实践中 从我国 从中国"
).split()
#: How a line begins whose subject is the document that it comes from, or a year.
CITED_FIRST = r"^\s*(?:《[^》]{2,40}》|(?:19|20)\d{2}\s*年)"
#: Share of Chinese and Japanese characters above which a text is written in them.
CJK_SHARE = 0.2
STRONG_EDGES, SOFT_EDGES = "。！？；", "，、："
MARKERS = "①②③④⑤⑥⑦⑧⑨⑩⑴⑵⑶⑷⑸⑹⑺⑻⑼⑽⒈⒉⒊⒋⒌⒍⒎⒏⒐⒑⁰¹²³⁴⁵⁶⁷⁸⁹†‡§¶"
NUMERALS = "一二三四五六七八九十百千"
TOPIC_TAIL = "的地得了着与和及或"
ORDINAL_TAILS = ("第一", "第二", "第三", "第四", "一是", "二是", "三是")
#: Characters that nearly always begin a word: a label that ends on one was cut inside it.
WORD_STARTS = "主是支第被把将能可各每"
_ENDS = STRONG_EDGES + SOFT_EDGES + ".,;:!?)）】]」』”’\"'"


def topic_of(take: str, budget: int = CJK_BUDGET["topic"]) -> str:
    """A short label from a line: marks, numbering, labels, ordinals and fillers off its front; cut at a clause edge a few
    characters past the budget at most, else at the budget; never inside a number or an ordinal, behind a particle, on the
    first character of a word or on punctuation. A filler in the first few characters is skipped with what stands before it."""
    s = "".join(c for c in take if c not in MARKERS).strip()
    front = (
        rf"^[^\w{T.CJK}]+", rf"^(?:\d+|[{NUMERALS}]+)[.,、)）;；:：]", rf"^(?:第[{NUMERALS}](?=[{SOFT_EDGES}{STRONG_EDGES} ])|其[一二三四]|一[二三是])",
        r"^(?:图|表|Figure|Fig\.?|Tab\.?|Table)\s*\d+(?:\s*[-–—]\s*\d+)?\s*",
    )
    for rule in front:
        s = re.sub(rule, "", s)
    filler = "|".join(sorted(FILLERS, key=len, reverse=True))
    s = re.sub(rf"^[{SOFT_EDGES}{STRONG_EDGES} ]*(?:(?:{filler})[{SOFT_EDGES}{STRONG_EDGES} ]*)?", "", s)
    later = re.compile(rf"(?:{filler})[{SOFT_EDGES}{STRONG_EDGES} ]*")
    skips = (later.match(s, p) for p in range(min(5, len(s) - 1)))
    s = next((s[m.end() :] for m in skips if m), s)
    edge = re.search(rf"[{STRONG_EDGES}{SOFT_EDGES}.,;:!?]", s[: budget + 5])
    end = edge.start() if edge else min(len(s), budget)
    while not edge and 0 < end < len(s) and (s[end].isdigit() or s[end - 1].isdigit()):
        end += 1
    out = s[:end].rstrip(_ENDS) if edge else s[:end]
    out = out.rstrip(TOPIC_TAIL) or out[:1]
    while len(out) >= 4 and out.endswith(ORDINAL_TAILS):
        out = out[:-2]
    if 2 < len(out) < len(s) and out[-1] in WORD_STARTS and re.match(f"[{T.CJK}]", s[len(out)]):
        out = out[:-1]
    out = out.rstrip(_ENDS)
    return out if len(out) > 1 else ""


def _claim(sentences: Column) -> Column:
    """Index of the sentence, among the first four, that reads most like a claim."""
    claim, cond = "|".join(CLAIM_WORDS), "|".join(CONDITION_LEADS)

    def score(s: Column, i: Column) -> Column:
        value = (
            F.lit(0.4) - F.lit(0.6) * i + F.when(F.regexp_like(s, F.lit(claim)), 3.0).otherwise(0.0) + F.when(F.regexp_like(s, F.lit("[：:]")), 1.5).otherwise(0.0)
            - F.when(F.regexp_like(s, F.lit(f"^(?:{cond})")), 2.5).otherwise(0.0)
        )
        return F.struct(F.when(F.length(s) >= 10, value).otherwise(F.lit(-99.0)).alias("v"), (-i).alias("i"))

    return -F.array_max(F.transform(F.slice(sentences, 1, 4), score))["i"]


def _takeaway(sentence: Column, budget: int = CJK_BUDGET["takeaway"]) -> Column:
    """The sentence up to the last clause edge inside the budget, else the first edge up to a half past it, else the budget.

    A conditional runs on to the next stop. A strong edge stays, a soft one goes.
    """
    edges = rf"[{STRONG_EDGES}{SOFT_EDGES},]"
    inside = F.regexp_extract(sentence, rf"(?s)^(.{{2,{budget}}}{edges})", 1)
    beyond = F.regexp_extract(sentence, rf"(?s)^(.{{{budget},{budget + budget // 2}}}?{edges})", 1)
    cut = F.when(F.length(sentence) <= budget, sentence).when(inside != "", inside).when(beyond != "", beyond).otherwise(F.substring(sentence, 1, budget))
    half = F.regexp_like(cut, F.lit(f"^(?:{'|'.join(CONDITION_LEADS)})")) & ~F.regexp_like(cut, F.lit(f"[{STRONG_EDGES}]$"))
    whole = F.regexp_extract(sentence, rf"(?s)^(.*?[{STRONG_EDGES}]|.+)", 1)
    return F.regexp_replace(F.when(half, whole).otherwise(cut), f"[{SOFT_EDGES},]$", "")


def fold_cjk(units: DataFrame) -> DataFrame:
    """doc_id, pos, brief, takeaway, topic: units of a Chinese or Japanese document by their claim sentence; apparatus folds to nothing."""

    @F.pandas_udf("string")
    def topic(takes: pd.Series) -> pd.Series:
        return takes.map(lambda t: topic_of(t) if t else "")

    made = with_sentences(flag_apparatus(units)).withColumn("claim", _claim(F.col("sentences")))
    brief = F.translate(F.coalesce(F.get("sentences", F.col("claim")), F.lit("")), MARKERS, "")
    made = made.withColumn("brief", F.when(F.col("apparatus"), F.lit("")).otherwise(brief)).withColumn("takeaway", _takeaway(F.col("brief")))
    return made.select("doc_id", "pos", "brief", "takeaway", topic("takeaway").alias("topic"))


def repeats_section(lines: DataFrame, share: float = 0.8, least: int = 8) -> DataFrame:
    """lines (doc_id, section_id, pos, takeaway, section_line, ...) with repeats: the unit's line is its section's again.

    Lengths decide first, as texts of unlike length cannot be alike enough; only the rest is compared letter by letter.
    """
    flat = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\s，。、：；！？,.:;!?“”‘’\"'（）()《》]", "")

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() >= share for x, y in zip(a, b)])

    l = lines.withColumns({"_a": flat("takeaway"), "_b": flat("section_line")})  # noqa: E741
    short, long = F.least(F.length("_a"), F.length("_b")), F.greatest(F.length("_a"), F.length("_b"))
    maybe = (short >= least) & (2 * short >= F.lit(share) * (short + long))
    compared = l.where(maybe).withColumn("repeats", alike("_a", "_b"))
    return compared.unionByName(l.where(~maybe).withColumn("repeats", F.lit(False))).drop("_a", "_b")


def step_down_background(ladders: DataFrame, documents: DataFrame, cap: int = 2) -> DataFrame:
    """ladders (doc_id, section_id, pos, role, takeaway, section_line) with shown: which lines stand at the takeaway level.

    documents: doc_id, is_cjk. Only sections of Chinese and Japanese documents whose own lines are written so are changed. There a
    line that repeats its section's line steps down and neither counts nor resets; a section's first line stands; of
    background lines at most `cap` in a row; a background line about the source that it opens with steps down, though it
    counts; any other role, and a unit that folds to nothing, resets the run. A section without a line has no repeats.
    """
    section = Window.partitionBy("doc_id", "section_id")
    line = F.coalesce("takeaway", F.lit(""))
    word, wide = F.regexp_count(line, F.lit(r"[\p{L}\p{N}]")), F.regexp_count(line, F.lit(f"[{T.CJK}]"))
    written = F.sum(wide).over(section) > CJK_SHARE * F.sum(word).over(section)
    gated = ladders.join(documents.select("doc_id", "is_cjk"), "doc_id", "left").withColumn("_gate", F.coalesce("is_cjk", F.lit(False)) & written).drop("is_cjk")
    compared = repeats_section(gated.where("_gate")).unionByName(gated.where("NOT _gate").withColumn("repeats", F.lit(False)))
    folds, order = line != "", section.orderBy("pos")
    first = F.col("pos") == F.min(F.when(folds, F.col("pos"))).over(section)
    reset = ~folds | (~F.col("repeats") & (first | ~F.col("role").isin("context", "setup")))
    about = (wide > CJK_SHARE * word) & F.regexp_like(line, F.lit(CITED_FIRST)) & ~F.regexp_like(line, F.lit("[：:]|" + "|".join(CLAIM_WORDS)))
    marked = compared.withColumn("_reset", reset).withColumn("_g", F.sum(F.col("_reset").cast("int")).over(order))
    counts = folds & ~F.col("repeats") & ~F.col("_reset")
    run = F.sum(counts.cast("int")).over(Window.partitionBy("doc_id", "section_id", "_g").orderBy("pos"))
    shown = folds & ~F.col("repeats") & (F.col("_reset") | (F.col("_run") <= cap) & ~about)
    return marked.withColumn("_run", run).withColumn("shown", F.when(F.col("_gate"), shown).otherwise(folds)).drop("_gate", "_reset", "_g", "_run")


def carry_tail(units: DataFrame, glue: int = 40, least: int = 20) -> DataFrame:
    """units (doc_id, section_id, pos, role, text) with carried: the end of the unit before that a page break cut off.

    Notes and captions are stepped over. A text that does not end on a stop gives its last clause of 20 characters or
    more, else its last sentence, 40 characters at most; one that ends whole gives nothing.
    """
    note = (F.col("role") == "caption") | F.regexp_like("text", F.lit(r"^\s*[①-⑳]"))
    t = F.regexp_replace(F.trim("text"), r"[①-⑳]+$", "")
    sentence = F.regexp_extract(t, r"(?s)([^。！？!?]*)$", 1)
    clause = F.regexp_extract(sentence, rf"(?s)[，,；;：:]([^，,；;：:].{{{least - 1},}}?)$", 1)
    last = F.regexp_extract(sentence, r"(?s)[，,；;：:]([^，,；;：:]*)$", 1)
    chosen = F.when(F.length(last) >= least, last).when(F.length(clause) >= least, clause).otherwise(sentence)
    tail = F.when(F.regexp_like(t, F.lit(r"[。！？.!?：:；;”’」』）)]$")) | (t == ""), F.lit("")).otherwise(F.substring(chosen, -glue, glue))
    w = Window.partitionBy("doc_id", "section_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    u = units.withColumns({"_note": note, "_tail": tail})
    before = F.last(F.when(~F.col("_note"), F.col("_tail")), ignorenulls=True).over(w)
    return u.withColumn("carried", F.when(F.col("_note"), F.lit("")).otherwise(F.coalesce(before, F.lit("")))).drop("_note", "_tail")
