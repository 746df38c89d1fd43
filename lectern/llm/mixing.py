"""Mixing sources to target weights, in DataFrame operations only.

Weights are source shares to the power of an exponent, found by bisection for a target entropy or a repetition limit.
They are realised by budgeted block permutations: a source's documents are dealt to blocks by hash, an epoch permutes
the blocks and the rows inside them, and the last epoch ends where the source's budget does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running_start, settle, spread_join

#: Rows in a block on average.
BLOCK_ROWS = 2_000
#: Sources that may stand in one row while weights are computed, or be broadcast; more are aggregated and joined as a table.
MOST_SOURCES = 100_000
_STEPS = 60
#: Exponents tried at a time where the sources are a table.
_GRID = 64
#: Parts in which rows of one place are ranked.
_PARTS = 64


def words_in(text: str = "text") -> Column:
    """Words of a text, the measure of its share; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _source(name: str) -> Column:
    """The source as a key under which null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("null"))


def weights(totals: DataFrame, entropy_share: float | None, max_repeats: float | None, budget: float | None) -> DataFrame:
    """totals: source, tokens. Adds exponent, weight, quota (tokens to take) for each source with tokens.

    The exponent is between 0 (all sources alike) and 1 (natural shares). entropy_share asks for the largest exponent
    whose weights have that share of the greatest entropy; max_repeats for the smallest under which no source is repeated
    more often within the budget. If both are given the repetition limit wins. budget None: the least with which every
    document is used once. A single source has weight 1. Up to MOST_SOURCES sources are one row; the exponent of more is
    found by the same bisection over aggregates, a grid of exponents at a time.
    """
    if totals.where("tokens > 0").count() > MOST_SOURCES:
        return _weights_of_many(totals.where("tokens > 0").select("source", "tokens"), entropy_share, max_repeats, budget)
    row = totals.where("tokens > 0").agg(
        F.array_sort(F.collect_list(F.struct("source", "tokens"))).alias("s"), F.sum("tokens").alias("total")
    ).where("size(s) > 0")
    share = F.transform("s", lambda x: x["tokens"] / F.col("total"))
    shared = row.withColumn("p", share)

    def add(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    def raised(a: Column) -> Column:
        return F.transform("p", lambda x: F.pow(x, a))

    def entropy(a: Column) -> Column:
        z = add(raised(a))
        return F.ln(z) - add(F.transform("p", lambda x: F.pow(x, a) * a * F.ln(x))) / z

    def repeats(a: Column) -> Column:
        # Relative weight over share: p ** (a - 1) / z, times the budget in units of all tokens.
        used = F.transform("p", lambda x: F.pow(x, a - 1))
        if budget is None:
            return F.array_max(used) / F.array_min(used)
        return F.array_max(used) / add(raised(a)) * F.lit(float(budget)) / F.col("total")

    def bisect(good: Column, upper: bool) -> Column:
        """Edge of the exponents for which good(mid) holds: the upper edge, or the lower one."""
        state = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

        def step(s: Column, _: Column) -> Column:
            mid = (s["lo"] + s["hi"]) / 2
            up = good(mid) if upper else ~good(mid)
            return F.struct(F.when(up, mid).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi"))

        found = F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), state, step)
        return F.when(good(F.lit(1.0)), F.lit(1.0)).otherwise(found["lo"]) if upper else found["hi"]

    bounds = []
    if entropy_share is not None:
        goal = F.lit(entropy_share) * F.ln(F.size("s"))
        bounds.append(bisect(lambda a: entropy(a) >= goal, upper=True))
    if max_repeats is not None:
        bounds.append(bisect(lambda a: repeats(a) <= F.lit(float(max_repeats)), upper=False))
    exponent = F.lit(1.0) if not bounds else bounds[0] if len(bounds) == 1 else F.greatest(*bounds)
    solved = shared.withColumn("exponent", exponent)
    solved = solved.withColumn("w", F.transform(raised(F.col("exponent")), lambda x: x / add(raised(F.col("exponent")))))
    least = F.array_max(F.zip_with("s", "w", lambda s, w: s["tokens"] / w))
    solved = solved.withColumn("budget", least if budget is None else F.lit(float(budget)))
    each = F.inline(F.zip_with("s", "w", lambda s, w: F.struct(s["source"].alias("source"), s["tokens"].alias("tokens"), w.alias("weight"))))
    return solved.select("exponent", "budget", each).withColumn("quota", F.round(F.col("weight") * F.col("budget")).cast("long"))


def _weights_of_many(totals: DataFrame, entropy_share: float | None, max_repeats: float | None, budget: float | None) -> DataFrame:
    """weights() for sources that are too many for one row: only sums over all of them reach the driver."""
    n, total = totals.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    shared = totals.withColumn("p", F.col("tokens") / F.lit(total))

    def measures(exponents: list[float]) -> list[tuple[float, float]]:
        """Entropy and most repeats at each exponent."""
        raised = F.pow("p", F.col("a"))
        sums = shared.select("p", F.explode(F.array(*[F.lit(float(a)) for a in exponents])).alias("a")).groupBy("a").agg(
            F.sum(raised).alias("z"), F.sum(raised * F.col("a") * F.ln("p")).alias("e"),
            F.max(F.pow("p", F.col("a") - 1)).alias("high"), F.min(F.pow("p", F.col("a") - 1)).alias("low"),
        )
        by = {x.a: x for x in sums.collect()}
        repeats = (lambda x: x.high / x.low) if budget is None else (lambda x: x.high / x.z * budget / total)
        return [(math.log(by[a].z) - by[a].e / by[a].z, repeats(by[a])) for a in exponents]

    def edge(good, upper: bool) -> float:
        lo, hi = 0.0, 1.0
        if upper and good(measures([1.0])[0]):
            return 1.0
        for _ in range(math.ceil(_STEPS / math.log2(_GRID))):
            grid = sorted({lo + (hi - lo) * k / _GRID for k in range(1, _GRID)} - {lo, hi})
            if not grid:
                break
            ok = [good(x) if upper else not good(x) for x in measures(grid)]
            k = ok.index(False) if False in ok else len(grid)
            lo, hi = (grid[k - 1] if k else lo), (grid[k] if k < len(grid) else hi)
        return lo if upper else hi

    bounds = []
    if entropy_share is not None:
        bounds.append(edge(lambda x: x[0] >= entropy_share * math.log(n), upper=True))
    if max_repeats is not None:
        bounds.append(edge(lambda x: x[1] <= max_repeats, upper=False))
    exponent = max(bounds) if bounds else 1.0
    z = shared.agg(F.sum(F.pow("p", F.lit(exponent)))).first()[0]
    solved = shared.withColumn("weight", F.pow("p", F.lit(exponent)) / F.lit(z))
    spent = budget if budget is not None else solved.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0]
    out = solved.select(F.lit(exponent).alias("exponent"), F.lit(float(spent)).alias("budget"), "source", "tokens", "weight")
    return out.withColumn("quota", F.round(F.col("weight") * F.col("budget")).cast("long"))


def mix(
    docs: DataFrame,
    entropy_share: float | None = 0.9,
    max_repeats: float | None = 2.0,
    budget: float | None = None,
    seed: int = 17,
) -> DataFrame:
    """(doc, words, epoch, block_order, row_order): rows of docs (doc_id, text, source and any other columns) as mixed.

    Each source gives its quota of words: whole epochs first, each with all its rows, then the start of one more, up to
    the row with which the quota is reached. doc is the whole row, so no name of its columns can clash; block_order and
    row_order are the permuted order in the epoch. The choice depends on rows and seed only. A null source is a source; sources without words have no weight and give no rows; null and
    empty texts of other sources cost nothing and come as their place in the order says. Repeated rows are rows; they
    share a place in the order and are told apart by nothing else. An empty table gives no rows.
    """
    keyed = docs.select(F.struct("*").alias("doc"), "doc_id", "text", _source("source").alias("_source"))
    counts = keyed.groupBy("_source").agg(F.count(F.lit(1)).alias("_n"))
    blocks = settle(counts.withColumn("_blocks", F.greatest(F.ceil(F.col("_n") / BLOCK_ROWS), F.lit(1))))
    sources, rows = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    row_key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))

    def by_source(many: DataFrame, few: DataFrame, deal: Column) -> DataFrame:
        """Join a table of one row a source: broadcast if the sources are few enough, else with hot sources dealt."""
        if sources <= MOST_SOURCES:
            return many.join(F.broadcast(few), "_source")
        return spread_join(many, few, blocks.select("_source", "_n"), "_source", rows, deal)

    dealt = by_source(keyed, blocks.drop("_n"), row_key).withColumn("_block_no", F.pmod(row_key, F.col("_blocks")))
    sums = settle(dealt.groupBy("_source", "_block_no").agg(F.sum(words_in()).alias("words")))
    totals = sums.groupBy(F.col("_source").alias("source")).agg(F.sum("words").alias("tokens"))
    plan = weights(settle(totals), entropy_share, max_repeats, budget)
    plan = plan.withColumn("full", F.floor(F.col("quota") / F.col("tokens"))).withColumn("rest", F.col("quota") - F.col("full") * F.col("tokens"))
    plan = plan.withColumnRenamed("source", "_source")

    # The block of each source in which its last epoch ends. A hash's leading bits are buckets that keep its order.
    place = F.xxhash64(F.lit(seed), F.col("full"), F.col("_block_no"))
    ordered = by_source(sums, plan, F.col("_block_no")).withColumn("h", place)
    started = running_start(ordered, ["_source"], [F.col("h"), F.col("_block_no")], "words", "start", 0, F.shiftright("h", 48))
    cut = started.where("rest > 0 AND start < rest AND start + words >= rest")
    cut = cut.groupBy("_source").agg(F.min_by(F.struct("h", "_block_no", "start"), "start").alias("cut"))
    plan = settle(plan.join(cut, "_source", "left").select("_source", "full", "rest", "cut"))

    # Of the one block in which a quota ends only hashes and words are ranked, not texts. Equal rows share a place and are one.
    edge, end, left = F.col("cut"), F.col("end"), F.col("rest") - F.col("cut")["start"]
    last = F.xxhash64(F.lit(seed), F.col("full"), F.col("_block_no"))
    here, there = F.struct(last.alias("h"), F.col("_block_no").alias("_block_no")), F.struct(edge["h"].alias("h"), edge["_block_no"].alias("_block_no"))
    row = F.xxhash64(F.lit(seed), F.col("full"), F.col("doc_id"), F.col("text"))
    edges = by_source(dealt, plan, row_key).where(here == there)
    places = edges.groupBy("_source", left.alias("_left"), row.alias("place")).agg(F.sum(words_in()).alias("_sum"))
    upto = Window.partitionBy("_source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    places = places.withColumn("start", F.coalesce(F.sum("_sum").over(upto), F.lit(0))).where("start < _left")
    ends = places.groupBy("_source").agg(F.max(F.struct("place", "start")).alias("end"))
    plan = settle(plan.join(ends, "_source", "left"))

    planned = by_source(dealt, plan, row_key).withColumn("_words", words_in())
    taken = F.coalesce(F.when(here == there, row < end["place"]).otherwise(here < there), F.lit(False))
    times = planned.withColumn("_times", F.col("full") + taken.cast("long")).where("_times > 0")
    whole = times.withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1))).drop("_times")
    # The rows at the place where the quota ends, often one a source, are written, which gives a number to tell them apart.
    tied = planned.where(here == there).where(row == end["place"]).withColumn("_epoch", F.col("full"))
    tied = settle(tied.withColumn("_tie", F.monotonically_increasing_id()))
    tied = tied.withColumn("_part", F.pmod(F.xxhash64("_tie"), F.lit(_PARTS)))
    ranked = tied.select("_source", "_part", "_tie", "_words", (left - end["start"]).alias("_left"))
    ranked = running_start(ranked, ["_source"], [F.col("_tie")], "_words", "_at", 0, F.col("_part")).where("_at < _left")
    upto = ranked.groupBy("_source").agg(F.max(F.struct("_part", "_tie")).alias("_upto"))
    ended = by_source(tied, upto, F.col("_tie")).where(F.struct("_part", "_tie") <= F.col("_upto")).drop("_part", "_tie", "_upto")
    h, row = F.xxhash64(F.lit(seed), F.col("_epoch"), F.col("_block_no")), F.xxhash64(F.lit(seed), F.col("_epoch"), F.col("doc_id"), F.col("text"))
    return whole.unionByName(ended).withColumn("_block", h).withColumn("_row", row).select(
        "doc", F.col("_words").alias("words"), F.col("_epoch").alias("epoch"), F.col("_block").alias("block_order"), F.col("_row").alias("row_order")
    )
