"""Revisions of a text: units aligned, ids and notes carried over, edits listed."""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settle

#: Candidates that an edited unit is compared with, nearest place first, and the likeness it must pass.
NEAREST, ALIKE = 12, 0.5
#: Units of each version that are compared in one group.
GAP_UNITS = 1_000
#: Pairs of words that difflib compares at most in a part of a run of words that is too long for it as a whole.
PART_CELLS = 10_000
#: Contexts: what a passage at a text's edge scores, and what several places with the same words must reach.
EDGE, FIT = 20, 8
#: Characters of context that can tell a passage whose own words are gone.
CONTEXT = 12


def _shared_head(a: str, b: str) -> int:
    """How many characters two texts have in common at their starts, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def _most_alike(text: str, others: list[str], least: float) -> int:
    """The place of the text that is most like this one by difflib's ratio, if that is over least; the first of equals; else -1.

    A ratio takes time by the product of both lengths, so it is computed only where bounds leave the answer open: it is at most
    quick_ratio(), and at least that of the longest match alone, which is no shorter than what both begin or end with.
    """
    open_ = []
    for k, other in enumerate(others):
        m = difflib.SequenceMatcher(None, text, other, autojunk=False)
        if m.real_quick_ratio() > least and (most := m.quick_ratio()) > least:
            shared = max(_shared_head(text, other), _shared_head(text[::-1], other[::-1]))
            open_.append((k, 2.0 * shared / max(1, len(text) + len(other)), most, m))
    for k, sure, _, _ in open_:
        if sure > least and all(j == k or (sure > most if j < k else sure >= most) for j, _, most, _ in open_):
            return k
    score, k = max(((m.ratio(), -k) for k, _, _, m in open_), default=(0.0, 1))
    return -k if score > least else -1


def by_group(df: DataFrame, keys: list[str], order: list[str], work: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """The rows that work gives for each group of df, handed to it as tuples of df's columns in order.

    Groups are streamed through sorted partitions, so that many small ones cost no call each; a task holds one at a time.
    """
    places = [df.columns.index(k) for k in keys]
    names = [field.split(" ")[0] for field in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key = [], None
        for pdf in batches:
            out = []
            for k, rows in groupby(pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None), key=lambda r: tuple(r[p] for p in places)):
                if k != key:
                    out += work(held) if held else []
                    held, key = [], k
                held += rows
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(work(held) if held else [], columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _chain(blocks: list[tuple]) -> list[tuple]:
    """The heaviest set of a document's blocks (doc_id, i, j, n), sorted by i, in which j rises too. Of equal sets the one that stands earlier in the old version."""
    tails: list[tuple[int, tuple[int, int], int]] = []  # j, weight and place of chain ends; j and weight rise
    before = []
    for k, (_, i, j, n) in enumerate(blocks):
        at = bisect_left(tails, (j,))
        lines, early = tails[at - 1][1] if at else (0, 0)
        weight = lines + n, early - i
        before.append(tails[at - 1][2] if at else -1)
        over = at
        while over < len(tails) and tails[over][1] <= weight:
            over += 1
        tails[at:over] = [(j, weight, k)]
    kept, k = [], tails[-1][2] if tails else -1
    while k >= 0:
        kept.append(blocks[k])
        k = before[k]
    return kept[::-1]


def gaps(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both versions' units, cut at the lines that stand once in each: what stays, and the gaps between.

    old, new: doc_id, pos, unit_id, text. Rows come with side (0 old, 1 new), place (from 0 in their version), stays, other (the place
    of a line that stays in the other version), gap, part, base (where the part begins among the new units), n_old and n_new (units of
    the gap). Lines that stand once in both versions are found by hash; runs of them that are together in both are one block, and a
    document's heaviest chain of blocks that keeps its order is what stays: 24 bytes a block are all that a Python task holds of a
    document. A gap of more than GAP_UNITS units on a side is cut into parts at equal shares of both: no line stands once in both
    sides of it, but for lines that moved. Everything else is a window over a document, spilled where it is long.
    """
    cols = ("doc_id", "pos", "unit_id", "text")
    # New names of old columns: where both versions come from one table, their columns would be taken for each other.
    old, new = (df.select(*[F.col(c).alias(c) for c in cols], F.lit(k).alias("side")) for k, df in enumerate((old, new)))
    placed = old.unionByName(new).repartition("doc_id").withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "side").orderBy("pos")) - 1)
    alike = Window.partitionBy("doc_id", "_h")
    count = lambda k: F.sum((F.col("side") == k).cast("int")).over(alike)
    hashed = placed.select("doc_id", "side", "place", F.sha2("text", 256).alias("_h"))
    met = hashed.withColumns({"_o": count(0), "_n": count(1), "j": F.max(F.when(F.col("side") == 1, F.col("place"))).over(alike)})
    once = met.where("_o = 1 AND _n = 1 AND side = 0").select("doc_id", F.col("place").alias("i"), "j")
    by_i = Window.partitionBy("doc_id").orderBy("i")
    begins = (F.col("i") != F.lag("i").over(by_i) + 1) | (F.col("j") != F.lag("j").over(by_i) + 1)
    runs = once.withColumn("_b", F.coalesce(begins, F.lit(True)).cast("long")).withColumn("run", F.sum("_b").over(by_i))
    blocks = runs.groupBy("doc_id", "run").agg(F.min("i").alias("i"), F.min("j").alias("j"), F.count(F.lit(1)).alias("n")).drop("run")
    chain = by_group(blocks, ["doc_id"], ["i"], _chain, "doc_id long, i int, j int, n int")
    # A block is laid before the unit that it begins with, so that each unit finds the last block before it.
    ends = F.array(*[F.struct(F.lit(k).alias("side"), F.col(m).alias("place"), F.struct(F.col(m).alias("a"), F.col(o).alias("b"), "n").alias("block")) for k, m, o in ((0, "i", "j"), (1, "j", "i"))])
    begun = chain.select("doc_id", F.explode(ends).alias("e")).select("doc_id", "e.*")
    laid = placed.unionByName(begun, allowMissingColumns=True).repartition("doc_id")
    upto = Window.partitionBy("doc_id", "side").orderBy("place", F.col("block").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("block", ignorenulls=True).over(upto)
    found = laid.withColumns({"_last": last, "gap": F.count("block").over(upto)}).where("block IS NULL").drop("block")
    ahead = F.col("place") - F.col("_last.a")
    stays = F.coalesce(ahead < F.col("_last.n"), F.lit(False))
    begin = F.coalesce(F.col("_last.a") + F.col("_last.n"), F.lit(0))
    other_begin = F.coalesce(F.col("_last.b") + F.col("_last.n"), F.lit(0))
    told = found.withColumns({
        "stays": stays, "other": F.when(stays, F.col("_last.b") + ahead), "base": F.when(F.col("side") == 0, other_begin).otherwise(begin), "_k": F.col("place") - begin,
    })
    of_gap = Window.partitionBy("doc_id", "gap")
    units = lambda k: F.sum(((F.col("side") == k) & ~F.col("stays")).cast("int")).over(of_gap)
    sized = told.withColumns({"n_old": units(0), "n_new": units(1)})
    parts = F.greatest(F.lit(1), F.ceil(F.greatest("n_old", "n_new") / GAP_UNITS))
    part = F.when(F.col("stays"), 0).otherwise(F.floor(F.col("_k") * parts / F.when(F.col("side") == 0, F.col("n_old")).otherwise(F.col("n_new"))))
    made = sized.withColumn("part", part.cast("int"))
    return made.withColumn("base", (F.col("base") + F.ceil(F.col("part") * F.col("n_new") / parts)).cast("int")).drop("_last", "_k")


def _opcodes(a: list[str], b: list[str], at_start: bool) -> list[tuple]:
    """difflib's opcodes for a gap. Lines that both sides begin or end with go on from the lines that stay around the gap.

    at_start: nothing stays before the gap, so the end has the first choice.
    """
    most, lo, hi = min(len(a), len(b)), 0, 0
    for end in (at_start, not at_start):
        while end and hi < most - lo and a[-1 - hi] == b[-1 - hi]:
            hi += 1
        while not end and lo < most - hi and a[lo] == b[lo]:
            lo += 1
    inner = difflib.SequenceMatcher(None, a[lo : len(a) - hi], b[lo : len(b) - hi], autojunk=False).get_opcodes()
    ops = [("equal", 0, lo, 0, lo)] if lo else []
    ops += [(op, i1 + lo, i2 + lo, j1 + lo, j2 + lo) for op, i1, i2, j1, j2 in inner]
    return ops + ([("equal", len(a) - hi, len(a), len(b) - hi, len(b))] if hi else [])


def align_units(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, old_id, new_id, kind (same, near, null), at: where each old unit is in the new text, in reading order.

    old, new: doc_id, pos, unit_id, text. same: word for word; near: in a replaced run, the most alike above a half of the
    twelve nearest; at: the place among the new units. Lines that stand once in both versions are matched by their hashes; only
    what lies between them is compared, gap by gap (see gaps), so a document of any length has no group of more than GAP_UNITS
    units a side. Equal lines that repeat are matched inside their gap.
    """

    def align(both: list[tuple]) -> list[tuple]:
        a, b = ([(text, unit) for _, _, _, side, _, unit, text, _ in both if side == k] for k in (0, 1))
        ta, ia, tb, ib = [x for x, _ in a], [u for _, u in a], [x for x, _ in b], [u for _, u in b]
        doc, gap, base = both[0][0], both[0][1], both[0][-1]
        rows = []
        for op, i1, i2, j1, j2 in _opcodes(ta, tb, gap == 0):
            free = dict.fromkeys(range(j1, j2)) if op == "replace" else {}
            for i in range(i1, i2):
                if op == "equal":
                    rows.append((doc, ia[i], ib[j1 + i - i1], "same", base + j1 + i - i1))
                    continue
                near = sorted(free, key=lambda j: (abs(j - j1 - i + i1), j))[:NEAREST]
                best = _most_alike(ta[i], [tb[j] for j in near], ALIKE)
                if best >= 0:
                    j = near[best]
                    free.pop(j)
                    rows.append((doc, ia[i], ib[j], "near", base + j1))
                else:
                    rows.append((doc, ia[i], None, None, base + j1))
        return rows

    # Read three times below, so it is made once; only units that are compared keep their texts.
    compare = F.expr("NOT stays AND n_old > 0 AND n_new > 0")
    cut = settle(gaps(old, new).withColumn("text", F.when(compare, F.col("text"))))
    key = F.when(F.col("side") == 1, F.col("place")).otherwise(F.col("other")).alias("at")
    sides = [F.max(F.when(F.col("side") == k, F.col("unit_id"))).alias(c) for k, c in ((0, "old_id"), (1, "new_id"))]
    same = cut.where("stays").groupBy("doc_id", key).agg(*sides).select("doc_id", "old_id", "new_id", F.lit("same").alias("kind"), "at")
    none = F.lit(None).cast("string")
    gone = cut.where("NOT stays AND side = 0 AND n_new = 0").select("doc_id", F.col("unit_id").alias("old_id"), none.alias("new_id"), none.alias("kind"), F.col("base").alias("at"))
    open_ = cut.where(compare).select("doc_id", "gap", "part", "side", "pos", "unit_id", "text", "base")
    compared = by_group(open_, ["doc_id", "gap", "part"], ["side", "pos"], align, "doc_id long, old_id string, new_id string, kind string, at int")
    return same.unionByName(compared).unionByName(gone)


def carry_ids(old: DataFrame, new: DataFrame, alignment: DataFrame) -> DataFrame:
    """doc_id, new_id, unit_id, section_id, kept_section: the ids that new units and their sections take.

    old, new: doc_id, pos, unit_id, section_id, text. A unit still there, edited or moved word for word keeps its old id;
    a new one whose id an old one has takes the next free number. A section takes the id of the old one that most of its
    units come from, one to one, larger votes first, then the section listed first.
    """
    paired = settle(alignment.where("new_id IS NOT NULL").select("doc_id", "old_id", "new_id"))
    nth = lambda key: F.row_number().over(Window.partitionBy("doc_id", "h").orderBy(key))
    digest = F.sha2("text", 256).alias("h")
    gone = old.join(paired.select("doc_id", F.col("old_id").alias("unit_id")), ["doc_id", "unit_id"], "left_anti").select("doc_id", F.col("unit_id").alias("old_id"), "pos", digest).withColumn("k", nth("pos"))
    come = new.join(paired.select("doc_id", F.col("new_id").alias("unit_id")), ["doc_id", "unit_id"], "left_anti").select("doc_id", F.col("unit_id").alias("new_id"), "pos", digest).withColumn("k", nth("pos"))
    moved = gone.drop("pos").join(come.drop("pos"), ["doc_id", "h", "k"]).select("doc_id", "old_id", "new_id")
    kept = paired.unionByName(moved)
    number = F.regexp_extract("unit_id", r"(\d+)", 1).cast("int")
    top = old.select("doc_id", "unit_id").unionByName(new.select("doc_id", "unit_id")).groupBy("doc_id").agg(F.max(number).alias("top"))
    taken = old.select("doc_id", F.col("unit_id").alias("new_id"), F.lit(True).alias("used"))
    fresh = new.select("doc_id", "pos", "section_id", F.col("unit_id").alias("new_id")).join(kept, ["doc_id", "new_id"], "left").join(taken, ["doc_id", "new_id"], "left").join(top, "doc_id")
    clash = F.col("old_id").isNull() & F.col("used").isNotNull()
    n = F.sum(clash.cast("int")).over(Window.partitionBy("doc_id").orderBy("pos"))
    named = fresh.withColumn("unit_id", F.coalesce("old_id", F.when(clash, F.concat(F.regexp_extract("new_id", r"^(\D+)", 1), (F.col("top") + n).cast("string"))).otherwise(F.col("new_id"))))
    named = settle(named.select("doc_id", "section_id", "new_id", "old_id", "unit_id"))
    votes = named.where("old_id IS NOT NULL").join(old.select("doc_id", F.col("unit_id").alias("old_id"), F.col("section_id").alias("old_section")), ["doc_id", "old_id"])
    votes = votes.groupBy("doc_id", "section_id", "old_section").agg(F.count(F.lit(1)).alias("n"))

    def choose(rows: list[tuple]) -> list[tuple]:
        out, new_taken, old_taken = [], set(), set()
        for doc, _, s, o in rows:
            if s not in new_taken and o not in old_taken:
                out.append((doc, s, o))
                new_taken.add(s)
                old_taken.add(o)
        return out

    ranked = votes.select("doc_id", (-F.col("n")).alias("k"), "section_id", "old_section")
    sections = by_group(ranked, ["doc_id"], ["k", "section_id", "old_section"], choose, "doc_id long, section_id string, kept_section string")
    return named.join(sections, ["doc_id", "section_id"], "left").select("doc_id", "new_id", "unit_id", "section_id", "kept_section")


def id_history(versions: list[DataFrame]) -> DataFrame:
    """doc_id, old_id, section_id, since: ids that are gone from the last version, and the section their text is in now.

    versions: doc_id, unit_id, section_id, to_section (where the unit's section went to in the next version; null: it
    stays). A gone id's section is followed through later versions; an id that comes back has no row.
    """
    gone = None
    for k in range(1, len(versions)):
        before, after = versions[k - 1], versions[k]
        left = before.join(after.select("doc_id", "unit_id"), ["doc_id", "unit_id"], "left_anti")
        left = left.select("doc_id", F.col("unit_id").alias("old_id"), F.coalesce("to_section", "section_id").alias("section_id"), F.lit(k).alias("since"))
        if gone is not None:
            moves = before.where("to_section IS NOT NULL").select("doc_id", "section_id", "to_section").distinct()
            gone = gone.join(moves, ["doc_id", "section_id"], "left").select("doc_id", "old_id", F.coalesce("to_section", "section_id").alias("section_id"), "since")
            gone = gone.join(after.select("doc_id", F.col("unit_id").alias("old_id")), ["doc_id", "old_id"], "left_anti")
            gone = gone.join(left.select("doc_id", "old_id"), ["doc_id", "old_id"], "left_anti")
        gone = left if gone is None else gone.unionByName(left)
    return gone


def lookup_ids(ids: DataFrame, units: DataFrame, history: DataFrame) -> DataFrame:
    """ids (doc_id, id) with state: here, gone (and the section it is in), unknown."""
    here = units.select("doc_id", F.col("unit_id").alias("id"), F.lit(True).alias("_here"))
    was = history.select("doc_id", F.col("old_id").alias("id"), F.col("section_id").alias("section"))
    joined = ids.join(here, ["doc_id", "id"], "left").join(was, ["doc_id", "id"], "left")
    state = F.when(F.col("_here"), "here").when(F.col("section").isNotNull(), "gone").otherwise("unknown")
    return joined.select("doc_id", "id", state.alias("state"), F.when(F.col("_here").isNull(), F.col("section")).alias("section"))


def _shared_end(a: Column, b: Column) -> Column:
    """How many characters two texts have in common at their ends."""
    return _shared_start(F.reverse(a), F.reverse(b))


#: Characters of context that are compared at most.
_SHARED = 40


def _shared_start(a: Column, b: Column, most: int = _SHARED) -> Column:
    same = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: (F.length(a) >= i) & (F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
    return F.size(F.filter(same, lambda x: x))


def reanchor(notes: DataFrame, new: DataFrame, alignment: DataFrame) -> DataFrame:
    """doc_id, note_id, unit_id, start, size, state: where each note's passage is in the new text.

    notes: doc_id, note_id, unit_id, exact, prefix, suffix; new: doc_id, pos, unit_id, text. A unit word for word the same
    keeps its note (state kept). Else each place of the exact words is scored by how much of the contexts fits, the
    edited unit breaks ties, then the nearest place; a single place is taken, of several one that fits by eight or is in
    the edited unit (found). Where the words are nowhere, what stands between the old contexts is taken, if these have
    CONTEXT characters and the gap is at most twice the words and 40: in the edited unit, or in one place only (found). Else the note is lost, on the edited unit if there is one. Places are found inside the same
    document only.
    """
    a = alignment.select("doc_id", F.col("old_id").alias("unit_id"), "new_id", "kind", "at")
    # Notes with their place in the alignment, hits and what is found are each read several times, so they are made once.
    n = settle(notes.join(a, ["doc_id", "unit_id"], "left"))
    kept = n.where("kind = 'same'").select("doc_id", "note_id", F.col("new_id").alias("unit_id"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("size"), F.lit("kept").alias("state"))
    rest = n.where("kind IS NULL OR kind <> 'same'").drop("unit_id")
    cand = rest.where("trim(exact) <> ''").join(new.select("doc_id", F.col("unit_id").alias("u"), "pos", "text"), "doc_id").where("contains(text, exact)")
    # Overlapping places count: the text is cut before every start at which the words stand, in one pass.
    ahead = F.concat(F.lit("(?=\\Q"), F.replace("exact", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    begun = F.aggregate(
        F.split("text", ahead), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.array_append(s["starts"], s["at"]).alias("starts")), lambda s: s["starts"],
    )
    # The first part begins the text; it is a start only if the words stand there.
    starts = F.when(F.startswith("text", "exact"), F.col("begun")).otherwise(F.slice("begun", F.lit(2), F.size("begun")))
    hit = cand.withColumn("begun", begun).withColumn("i", F.explode(starts)).drop("begun")
    after = F.substring(F.col("text"), F.col("i") + F.length("exact") + 1, F.lit(_SHARED))
    before = F.substring(F.col("text"), F.greatest(F.col("i") - _SHARED + 1, F.lit(1)), F.least(F.col("i"), F.lit(_SHARED)))
    fit = F.when(F.col("prefix") != "", _shared_end(before, F.col("prefix"))).otherwise(F.when(F.col("i") == 0, EDGE).otherwise(0)) + F.when(
        F.col("suffix") != "", _shared_start(after, F.col("suffix"))
    ).otherwise(F.when(after == "", EDGE).otherwise(0))
    near = F.coalesce(F.col("u") == F.col("new_id"), F.lit(False))
    w = Window.partitionBy("doc_id", "note_id")
    hit = hit.withColumns({"fit": fit, "near": near, "far": F.abs(F.col("pos") - F.coalesce("at", F.lit(0))), "size": F.length("exact")})
    hit = settle(hit.select("doc_id", "note_id", "u", "pos", "i", "size", "fit", "near", "far"))
    scored = hit.withColumns({"k": F.row_number().over(w.orderBy(F.desc("fit"), F.desc("near"), "far", "pos", "i")), "hits": F.count(F.lit(1)).over(w)})
    found = scored.where("k = 1 AND (hits = 1 OR fit >= %d OR near)" % FIT).select("doc_id", "note_id", F.col("u").alias("unit_id"), F.col("i").alias("start"), "size", F.lit("found").alias("state"))
    gone = rest.where("trim(exact) <> ''").join(hit.select("doc_id", "note_id").distinct(), ["doc_id", "note_id"], "left_anti")
    found = settle(found.unionByName(_between(gone, new)))
    lost = rest.join(found, ["doc_id", "note_id"], "left_anti").select("doc_id", "note_id", F.col("new_id").alias("unit_id"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("size"), F.lit("lost").alias("state"))
    return kept.unionByName(found).unionByName(lost)


def _between(gone: DataFrame, new: DataFrame) -> DataFrame:
    """found rows of notes whose words are nowhere, by what stands between their contexts. gone: a note's columns and new_id."""
    told = gone.withColumns({c: F.coalesce(c, F.lit("")) for c in ("prefix", "suffix")}).where(F.length("prefix") + F.length("suffix") >= CONTEXT)
    cand = told.join(new.select("doc_id", F.col("unit_id").alias("u"), "pos", "text"), "doc_id").where("contains(text, prefix) AND contains(text, suffix)")
    # Where a prefix ends: the lengths of the parts before, which the prefix cuts the text into.
    cut = F.split("text", F.concat(F.lit("\\Q"), "prefix", F.lit("\\E")))
    ends = F.transform(F.sequence(F.lit(1), F.size("cut") - 1), lambda i: F.length(F.array_join(F.slice("cut", 1, i), "")) + i * F.length("prefix"))
    starts = cand.withColumn("cut", F.when(F.col("prefix") != "", cut)).withColumn("s", F.explode(F.when(F.col("prefix") != "", ends).otherwise(F.array(F.lit(0)))))
    stop = F.expr("CASE WHEN suffix = '' THEN length(text) ELSE locate(suffix, text, s + 1) - 1 END")
    gaps = starts.withColumn("e", stop).where("e >= s").withColumn("gap", F.expr("substring(text, s + 1, e - s)"))
    gaps = gaps.where("trim(gap) <> '' AND length(gap) <= 2 * length(exact) + 40").withColumn("near", F.coalesce(F.col("u") == F.col("new_id"), F.lit(False)))
    w = Window.partitionBy("doc_id", "note_id")
    ranked = gaps.withColumns({"k": F.row_number().over(w.orderBy(F.desc("near"), "pos", "s")), "places": F.count(F.lit(1)).over(w)})
    inner = F.length("gap") - F.length(F.ltrim("gap"))
    return ranked.where("k = 1 AND (near OR places = 1)").select(
        "doc_id", "note_id", F.col("u").alias("unit_id"), (F.col("s") + inner).cast("int").alias("start"), F.length(F.trim("gap")).alias("size"), F.lit("found").alias("state")
    )


def section_target(asked: DataFrame, old: DataFrame, new: DataFrame, alignment: DataFrame) -> DataFrame:
    """asked (doc_id, section_id) with target: the section itself if it is still there, else where most of its units are,
    else the one before its place, else the first. An as-of lookup by place."""
    there = new.select("doc_id", "section_id").distinct().withColumn("_here", F.lit(True))
    was = settle(old.select("doc_id", "section_id", F.col("unit_id").alias("old_id")).join(alignment, ["doc_id", "old_id"]))
    now = new.select("doc_id", F.col("unit_id").alias("new_id"), F.col("section_id").alias("s"), "pos")
    votes = was.join(now, ["doc_id", "new_id"]).groupBy("doc_id", "section_id", "s").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("p"))
    most = votes.groupBy("doc_id", "section_id").agg(F.max_by("s", F.struct("n", -F.col("p"))).alias("most"))
    place = was.groupBy("doc_id", "section_id").agg(F.min("at").alias("at"))
    numbered = new.select("doc_id", F.col("section_id").alias("s"), (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1).alias("i"))
    asof = place.join(numbered, "doc_id").where("i <= greatest(at - 1, 0)").groupBy("doc_id", "section_id").agg(F.max_by("s", "i").alias("before"))
    first = numbered.groupBy("doc_id").agg(F.min_by("s", "i").alias("first"))
    out = asked.join(there, ["doc_id", "section_id"], "left").join(most, ["doc_id", "section_id"], "left").join(asof, ["doc_id", "section_id"], "left").join(first, "doc_id", "left")
    return out.select("doc_id", "section_id", F.coalesce(F.when(F.col("_here"), F.col("section_id")), "most", "before", "first").alias("target"))


def _longest_common(x: np.ndarray, y: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """The length of the longest run that stands in both, and at each place of either a number for the run of that length there.

    Runs of 2, 4, 8 ... are numbered as pairs of runs of half their length, as long as one stands in both; then the longest
    one is put together of these, the longer ones first.
    """

    def paired(head: tuple, tail: tuple, step: int) -> tuple | None:
        """Numbers for runs of head with the tail that begins step places on; none if no such run stands in both."""
        n = [max(0, len(t) - step) for t in tail]
        if not all(n):
            return None
        both = np.concatenate([h[:k].astype(np.int64) << 32 | t[step:] for h, t, k in zip(head, tail, n)])
        ids = np.unique(both, return_inverse=True)[1]
        return (ids[: n[0]], ids[n[0] :]) if np.isin(ids[: n[0]], ids[n[0] :]).any() else None

    if not np.isin(x, y).any():
        return 0, x, y
    ladder = [(x, y)]
    while (twice := paired(ladder[-1], ladder[-1], 1 << (len(ladder) - 1))) is not None:
        ladder.append(twice)
    size, runs = 1 << (len(ladder) - 1), ladder[-1]
    for k in range(len(ladder) - 2, -1, -1):
        if (longer := paired(runs, ladder[k], size)) is not None:
            size, runs = size + (1 << k), longer
    return size, *runs


def _word_opcodes(a: list[str], b: list[str], part_cells: int = PART_CELLS) -> list[tuple]:
    """difflib's opcodes for two long runs of words, in memory by their length.

    difflib takes the longest run that stands in both, the first in a, then in b, and goes on left and right of it. Right of it
    no longer one is left, so all of that length are taken in one pass from left to right; what lies between holds shorter ones only.
    A part with at most part_cells pairs of words goes to difflib itself.
    """
    ids: dict[str, int] = {}
    x, y = (np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64) for words in (a, b))
    found, parts = [], [(0, len(a), 0, len(b))]
    while parts:
        alo, ahi, blo, bhi = parts.pop()
        if (ahi - alo) * (bhi - blo) <= part_cells:
            met = difflib.SequenceMatcher(None, a[alo:ahi], b[blo:bhi], autojunk=False).get_matching_blocks()
            found += [(alo + i, blo + j, n) for i, j, n in met if n]
            continue
        size, in_a, in_b = _longest_common(x[alo:ahi], y[blo:bhi])
        if not size:
            continue
        at = np.flatnonzero(np.isin(in_a, in_b))
        order = np.argsort(in_b, kind="stable")
        first, last = (np.searchsorted(in_b[order], in_a[at], side).tolist() for side in ("left", "right"))
        places, i, j = order.tolist(), 0, 0
        for p, lo, hi in zip(at.tolist(), first, last):
            if p >= i and (k := bisect_left(places, j, lo, hi)) < hi:
                parts.append((alo + i, alo + p, blo + j, blo + places[k]))
                found.append((alo + p, blo + places[k], size))
                i, j = p + size, places[k] + size
        parts.append((alo + i, ahi, blo + j, bhi))
    ops, i, j = [], 0, 0
    for p, q, n in [*sorted(found), (len(a), len(b), 0)]:
        if p > i or q > j:
            ops.append(("replace" if p > i and q > j else "delete" if p > i else "insert", i, p, j, q))
        if n and ops and ops[-1][0] == "equal":
            ops[-1] = ("equal", ops[-1][1], p + n, ops[-1][3], q + n)
        elif n:
            ops.append(("equal", p, p + n, q, q + n))
        i, j = p + n, q + n
    return ops


def _word_places(was: list[tuple[int, str]], now: list[tuple[int, str]], most_cells: int) -> list[tuple[int, str, str]]:
    """(pos, was, now) of what differs between two runs of units, word by word; changes with only white space between
    them are one. pos is the new unit's that a change begins in, the old one's if the run has no new unit."""

    def words(units: list[tuple[int, str]]) -> list[tuple[int, str]]:
        cut = [(pos, w) for pos, text in units for w in [*re.split(r"(\s+)", text), "\n\n"] if w]
        return cut[:-1]

    a, b = words(was), words(now)
    ta, tb = [w for _, w in a], [w for _, w in b]
    # What both begin and end with is set aside first: an edit is mostly a few words.
    s = e = 0
    while s < min(len(ta), len(tb)) and ta[s] == tb[s]:
        s += 1
    while e < min(len(ta), len(tb)) - s and ta[-1 - e] == tb[-1 - e]:
        e += 1
    ma, mb = ta[s : len(ta) - e], tb[s : len(tb) - e]
    if len(ma) * len(mb) > most_cells:
        ops = _word_opcodes(ma, mb)
    else:
        ops = difflib.SequenceMatcher(None, ma, mb, autojunk=False).get_opcodes()
    ops = [(op, i1 + s, i2 + s, j1 + s, j2 + s) for op, i1, i2, j1, j2 in ops]
    out: list[list] = []
    gap, open_ = "", False
    for op, i1, i2, j1, j2 in ops:
        if op == "equal":
            gap = "".join(ta[i1:i2])
            open_ = open_ and gap.isspace()
            continue
        if open_:
            out[-1][1] += gap
            out[-1][2] += gap
        else:
            at = b[j1][0] if j1 < len(b) else b[-1][0] if b else a[i1][0]
            out.append([at, "", ""])
        out[-1][1] += "".join(ta[i1:i2])
        out[-1][2] += "".join(tb[j1:j2])
        open_ = True
    return [(pos, x.strip(), y.strip()) for pos, x, y in out if x.strip() or y.strip()]


def edit_places(old: DataFrame, new: DataFrame, most_cells: int = 1_000_000) -> DataFrame:
    """doc_id, pos, was, now: what changed between two versions: units first, then runs of words inside replaced units.

    old, new: doc_id, pos, text. Documents in which every unit has its text at its place are set aside by a full outer
    join; of the others the units are aligned by their texts, whatever their places, so that a unit put in between changes
    no other. Lines that stand once in both versions cut a document into gaps, which are compared one by one (see gaps). Runs of
    units with more than most_cells pairs of words are matched in another way, which finds the same changes (see _word_opcodes).
    """
    # New names of old columns, as the versions may come from one table.
    o = old.select(F.col("doc_id").alias("doc_id"), F.col("pos").cast("int").alias("pos"), F.col("text").alias("text"))
    n = new.select(F.col("doc_id").alias("doc_id"), F.col("pos").cast("int").alias("pos"), F.col("text").alias("text"))
    changed = o.withColumnRenamed("text", "was").join(n.withColumnRenamed("text", "now"), ["doc_id", "pos"], "full").where("NOT (was <=> now)").select("doc_id").distinct()

    def places(both: list[tuple]) -> list[tuple]:
        a, b = ([(pos, text) for _, _, _, side, pos, text in both if side == k] for k in (0, 1))
        rows = []
        for op, i1, i2, j1, j2 in _opcodes([t for _, t in a], [t for _, t in b], both[0][1] == 0):
            if op != "equal":
                rows += [(both[0][0], *change) for change in _word_places(a[i1:i2], b[j1:j2], most_cells)]
        return rows

    cut = gaps(*(x.join(changed, "doc_id", "left_semi").withColumn("unit_id", F.lit("")) for x in (o, n)))
    open_ = cut.where("NOT stays").select("doc_id", "gap", "part", "side", "pos", "text")
    return by_group(open_, ["doc_id", "gap", "part"], ["side", "pos"], places, "doc_id long, pos int, was string, now string")


def changed_sections(prompts: DataFrame, replies: DataFrame) -> DataFrame:
    """doc_id, section_id of the prompts that no kept reply answers: what an edit makes be asked again."""
    return prompts.join(replies.select("cache_key").distinct(), "cache_key", "left_anti").select("doc_id", "section_id").distinct()


def recite(cites: DataFrame, alignment: DataFrame) -> DataFrame:
    """doc_id, note_id, cites: citations (doc_id, note_id, i, unit_id) mapped through the alignment, in order, once each."""
    moved = alignment.where("new_id IS NOT NULL").select("doc_id", F.col("old_id").alias("unit_id"), "new_id")
    rows = cites.join(moved, ["doc_id", "unit_id"], "left").withColumn("u", F.coalesce("new_id", "unit_id"))
    firsts = rows.groupBy("doc_id", "note_id", "u").agg(F.min("i").alias("i"))
    return firsts.groupBy("doc_id", "note_id").agg(F.array_sort(F.collect_list(F.struct("i", "u"))).getField("u").alias("cites"))
