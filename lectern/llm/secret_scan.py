"""Secret scans through a trigram index, in DataFrame operations only.

Each rule's regex gives a Boolean query over trigrams: an OR of clauses, each an AND of trigrams that a match must
contain. Postings name the documents that hold a trigram; a rule's candidates are the documents in all postings of one
of its clauses; candidates are verified with the regex. Rules without a mandatory trigram scan every document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Marks the start and end of a match while a text is cut at its matches; a text's own marks are taken for another
#: control character, which no rule can match either.
_MARK, _STAND_IN = "\x01", "\x02"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex, and the least length of the group `value` (0: the whole match) for a match to count."""

    kind: str
    regex: str
    value: int
    least: int


_VALUE = "[A-Za-z0-9+/_.=-]+"
#: What stands between the lines of a key: white space, or line ends as they are written inside a string.
_GAP = r"(?:[\x20\t\r\n]|\\[nr])++"
#: A private key: to its END line, else over the lines of base64 that follow its first. Possessive, so that neither
#: Java's stack nor the time of a failed match grows with the key.
_KEY = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:"
    r"[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_GAP}(?:Proc-Type|DEK-Info):\x20*[A-Za-z0-9,-]++)*+(?:{_GAP}[A-Za-z0-9+/]{{24,}}+={{0,2}})++"
    r"(?:(?:\r?\n|(?:\\r)?\\n)[\x20\t]*+[A-Za-z0-9+/]++={0,2}(?![^\r\n\\]))?+"
    r")?+"
)
#: The base rules first, in the order in which spans at one place are listed.
RULES = (
    Rule("assign", rf"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?({_VALUE})""", 2, 6),
    # A run of one class is as long in the shorter form, so the least length can stand in the regex.
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("private_key", _KEY, 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("github", r"(?:ghp|gho|ghs)_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[bp]-[A-Za-z0-9-]+", 0, 20),
)
BASE = ("assign", "access", "hex")


# --- Boolean trigram queries ---------------------------------------------------------------------------------------


def trigram_query(regex: str) -> list[list[str]] | None:
    """Clauses (an OR of ANDs) of lower-case trigrams that every match contains one of; None if nothing is mandatory.

    The regex's syntax tree is walked: a literal extends the open strings, a group or optional part multiplies them, and
    anything else that must match something unknown closes them. Case is folded on both sides, which only adds candidates.
    """
    from re import _parser as parser

    tree = parser.parse(regex)
    alternatives = _strings(tree)
    clauses = set()
    for parts in alternatives:
        grams = {p[i : i + 3] for p in parts for i in range(len(p) - 2)}
        if not grams:
            return None
        clauses.add(tuple(sorted(grams)))
    return [list(c) for c in sorted(clauses) if not any(set(d) < set(c) for d in clauses)]


#: More alternatives than this make an unknown part instead.
_MOST = 32


def _strings(tree) -> list[list[str]]:
    """For each alternative way to match, the literal strings that it contains in order."""
    ways: list[list[str]] = [[""]]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            more = [[chr(arg).lower()]]
        elif name == "SUBPATTERN":
            more = _strings(arg[-1])
        elif name == "BRANCH":
            more = [w for branch in arg[1] for w in _strings(branch)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[:2] == (0, 1):
            more = [[""], *_strings(arg[2])]
        elif name == "IN" and len(arg) <= 4 and all(str(o) == "LITERAL" for o, _ in arg):
            more = [[chr(c).lower()] for _, c in arg]
        elif name == "AT":
            continue
        else:
            more = [["", ""]]  # something unknown: strings end before it and begin after it
        if len(ways) * len(more) > _MOST:
            more = [["", ""]]
        ways = [[*w[:-1], w[-1] + m[0], *m[1:]] for w in ways for m in more]
    return ways


def rule_queries(rules: tuple[Rule, ...]) -> dict[str, list[list[str]] | None]:
    return {r.kind: trigram_query(r.regex) for r in rules}


# --- The index -----------------------------------------------------------------------------------------------------


def grams_held(low: Column, queries: dict[str, list[list[str]] | None]) -> Column:
    """The trigrams of the rules' queries that a lower-case text holds: its rows in the inverted index."""
    grams = sorted({g for q in queries.values() if q for clause in q for g in clause})
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in grams]))


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, gram) of the trigrams that some rule asks for. docs: key, text.

    The lower-case text and the list are columns of their own, so that a text is folded once and not for each trigram;
    the outer form keeps the optimizer from testing the list for emptiness first, which would make it twice.
    """
    low = docs.select("key", F.lower("text").alias("low"))
    held = low.select("key", grams_held(F.col("low"), rule_queries(rules)).alias("held"))
    return held.select("key", F.explode_outer("held").alias("gram")).where("gram IS NOT NULL")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, kinds): documents that stand in all postings of a clause, by intersecting them per document.

    The clauses are a table of a few rows for each rule, written into the query, so its size does not follow the data.
    """
    rows = [(r, i, g, len(c)) for r, q in rule_queries(rules).items() if q for i, c in enumerate(q) for g in c]
    clauses = index.sparkSession.createDataFrame(rows, "kind string, clause int, gram string, need int")
    hits = index.join(F.broadcast(clauses), "gram").groupBy("key", "kind", "clause", "need")
    whole = hits.agg(F.size(F.collect_set("gram")).alias("held")).where("held = need")
    return whole.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


#: Rows of a table of document keys that a join may broadcast; with more, both sides are shuffled.
BROADCAST_ROWS = 400_000


def _if_small(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder, with a broadcast hint if it has at most BROADCAST_ROWS rows."""
    table = settle(df)
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


# --- Spans ---------------------------------------------------------------------------------------------------------


def _cut(text: Column, rule: Rule) -> Column:
    """A text cut at a rule's matches: parts 0, 2, 4, ... stand between matches, 1, 3, 5, ... are matches."""
    safe = F.translate(text, _MARK, _STAND_IN)
    return F.split(F.regexp_replace(safe, f"({rule.regex})", f"{_MARK}$1{_MARK}"), _MARK)


def _parts(text: Column, rule: Rule) -> Column:
    """(length, is a valid match) of each part of a cut text."""

    def part(x: Column, i: Column) -> Column:
        value = F.regexp_extract(x, rule.regex, rule.value)
        return F.struct(F.length(x).alias("n"), ((i % 2 == 1) & (F.length(value) >= rule.least)).alias("ok"))

    return F.transform(_cut(text, rule), part)


def key_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A key that equal rows share and others do not, null ids included."""
    return F.struct(F.col(doc_id).cast("string").alias("id"), F.xxhash64(text, doc_id).alias("h"))


def spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, spans array<struct<start, rank, end, kind>>) of the documents with a secret, sorted. docs: key, text.

    Matches are leftmost and do not overlap within a rule; those whose value is too short are dropped after matching.
    Offsets are code points, end exclusive. Null and empty texts have none. Rows with equal keys count as one.
    """
    docs = docs.select("key", "text").where("text <> ''")
    queries = rule_queries(rules)
    rank = {r.kind: k for k, r in enumerate(rules)}
    cut = [
        docs.where(F.regexp_like("text", F.lit(r.regex))).select("key", F.lit(rank[r.kind]).alias("rank"), _parts(F.col("text"), r).alias("parts"))
        for r in rules
        if queries[r.kind] is None
    ]
    indexed = [r for r in rules if queries[r.kind] is not None]
    if indexed:
        hits = _if_small(candidates(postings(docs, rules), rules))
        each = F.array(*[
            F.struct(
                F.lit(rank[r.kind]).alias("rank"),
                F.when(F.array_contains("kinds", r.kind), _parts(F.col("text"), r)).alias("parts"),
            )
            for r in indexed
        ])
        cut.append(docs.join(hits, "key").select("key", F.inline(each)).where("size(parts) > 1"))
    every = cut[0]
    for c in cut[1:]:
        every = every.unionByName(c)
    # Offsets: the lengths of the parts before, summed by a window per document and rule; texts do not come along.
    once = every.groupBy("key", "rank").agg(F.first("parts").alias("parts"))
    parts = once.select("key", "rank", F.posexplode("parts").alias("i", "part")).select("key", "rank", "i", "part.*")
    upto = F.sum("n").over(Window.partitionBy("key", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    placed = parts.withColumn("end", upto.cast("int")).where("ok").withColumn("start", F.col("end") - F.col("n"))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    span = F.struct("start", "rank", "end", F.get(kinds, F.col("rank")).alias("kind"))
    return placed.groupBy("key").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans of every row of docs; rows without secrets have an empty list. Further columns are ignored."""
    keyed = docs.select("doc_id", "text", key_of().alias("key"))
    found = spans(keyed, rules)
    none = F.array().cast(found.schema["spans"].dataType)
    return keyed.drop("text").join(found, "key", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each run of overlapping spans replaced by [kind] of its first span; all other columns stay.

    n_chars, where docs has it, becomes the new length of a changed text. Rows without secrets stay as they are.
    """
    # The row is one column meanwhile, so that no name of its fields can clash.
    keyed = docs.select(F.struct("*").alias("doc"), "text", key_of().alias("key"))
    found = _if_small(spans(keyed.select("key", "text"), rules))
    text = F.col("text")
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(text, s["at"] + 1, x["start"] - s["at"])
        new = F.concat(s["out"], gap, F.lit("["), x["kind"], F.lit("]"))
        out = F.when(x["start"] >= s["at"], new).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), out.alias("out"))

    rest = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    clean = F.aggregate("spans", state, step, rest)
    new = F.col("doc").withField("text", clean)
    if "n_chars" in docs.columns:
        new = new.withField("n_chars", F.length(clean).cast(docs.schema["n_chars"].dataType))
    joined = keyed.join(found, "key", "left")
    return joined.select(F.when(F.col("spans").isNotNull(), new).otherwise(F.col("doc")).alias("doc")).select("doc.*")
