"""Column expressions over texts: tokens, sentences, words, scripts. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character ranges and word lists that decide results.
CJK = r"぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ"
THAI = r"฀-๿"
THAI_SYLLABLE = r"[เแโใไ]*[ก-ฮ][ะ-ฺๅ็-๎]*"
ABBREVIATIONS = (
    "e g i al etc vs cf fig figs eq eqs sec secs tab ref refs no approx resp ca viz dr mr ms prof st jr inc ltd co appx app"
    " thm def lem prop cor ch"
).split()
STOP_WORDS = (
    "the a an of to in is are was were be been and or that this these those it its for on with as by at from we our their"
    " they which while than then into can not but such also has have had does do more most less only both"
    " 的 了 是 在 和 与 或 这 那 就 也 都 而 及 其 之 对 中 为"
).split()
STOPS = (".", "?", "!", "。", "！", "？", "।", "॥")
CJK_STOPS = ("。", "！", "？")
DANDAS = ("।", "॥")
CLOSERS = (")", "]", "}", "）", "］", "｝", "】", "〕", "〉", "》", "」", "』", "”", '"', "’", "'")

_ANY = rf"[\p{{L}}\p{{N}}_&&[^{CJK}{THAI}]]"
_LETTERS = rf"{_ANY}[{_ANY}\p{{M}}]*+"
#: One token: a CJK character, a Thai syllable, a grouped number, Thai digits, a word, or any other character. What begins with
#: an ASCII letter is a word and an ASCII mark stands alone: those come first and are read without asking the large classes.
TOKEN = rf"[A-Za-z_][A-Za-z0-9_]*+[{_ANY}\p{{M}}]*+(?:['’\-]{_LETTERS})*+|[!-/:-@\[-\^`{{-~]|[{CJK}]|{THAI_SYLLABLE}|\d+(?:[.,]\d+)+%?|[๐-๙]+|{_LETTERS}(?:['’\-]{_LETTERS})*|[{THAI}]|\S"
WORD_CHAR = r"[\p{L}\p{N}_]"


def tokens(text: Column) -> Column:
    """array<struct<t string, s boolean>>: the tokens of a text and whether white space follows each. One match pass."""
    found = F.regexp_extract_all(text, F.lit(rf"(?:{TOKEN})\s*"), F.lit(0))

    def cut(x: Column) -> Column:
        t = F.rtrim(x, F.lit(" \t\n\x0b\f\r"))
        return F.struct(t.alias("t"), (F.octet_length(t) < F.octet_length(x)).alias("s"))

    return F.transform(found, cut)


def is_word(token: Column) -> Column:
    return F.regexp_like(token, F.lit(WORD_CHAR))


def is_cjk(text: Column) -> Column:
    return F.regexp_like(text, F.lit(f"[{CJK}]"))


def sentence_ends(toks: Column, text: Column) -> Column:
    """array<int>: the token index behind each sentence of a text.

    Texts without CJK characters and dandas, in which a sentence ends at white space only, go the short way.
    """
    # Most texts have no character of the two ranges that hold all of the class, which asks for far more of each.
    beyond = F.regexp_like(text, F.lit(r"[।-॥\u3000-\x{10FFFF}]"))
    wide = beyond & F.regexp_like(text, F.lit(f"[{CJK}{''.join((*CJK_STOPS, *DANDAS))}]"))
    return F.when(wide, _ends_one_by_one(toks)).otherwise(_ends_by_code(toks))


def _ends_by_code(toks: Column) -> Column:
    """Ends by a pattern over one letter for each token: o opens a run of stops, t prolongs it, q does so and may begin a
    sentence, c may begin one, x is any other; a capital letter has white space behind it."""
    heads = ("(", "[", "“", "‘")

    def code(x: Column, i: Column) -> Column:
        t, first = x["t"], F.substring(x["t"], 1, 1)
        prev = F.coalesce(F.get(toks, i - 1)["t"], F.lit(""))
        short = (t == ".") & (F.lower(prev).isin(*ABBREVIATIONS) | (F.octet_length(prev) == 1) & prev.between("A", "Z"))
        # Most tokens are words, which the first tests settle.
        kind = (
            F.when(first.between("a", "z"), "x").when(first.between("A", "Z") | first.between("0", "9"), "c")
            .when(t.isin(*STOPS), F.when(short, "t").otherwise("o")).when(t == '"', "q").when(t.isin(*CLOSERS), "t")
            .when(first.isin(*heads), "c").otherwise("x")
        )
        return F.when(x["s"], F.upper(kind)).otherwise(kind)

    codes = F.array_join(F.transform(toks, code), "")
    parts = F.split(F.regexp_replace(codes, "(o[otq]*[OTQ]|O)(?=[cCqQ])", "$1|"), r"\|")
    none = F.array().cast("array<int>")
    upto = F.aggregate(parts, none, lambda a, p: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + F.length(p))))
    return F.when(F.size(toks) > 0, upto).otherwise(none)


def _ends_one_by_one(toks: Column) -> Column:
    """Ends by one pass over the tokens.

    A stop that may end a sentence opens a run, which closers and stops without space between
    them prolong; the token behind the run decides. A number and its stop at the start of a text end nothing, nor do a
    stop behind an abbreviation or a single capital.
    """
    state = F.struct(
        F.lit(False).alias("open"), F.lit(False).alias("free"), F.lit(False).alias("bar"), F.lit("").alias("prev"), F.lit(False).alias("space"),
        F.lit(0).alias("n"), F.lit(0).alias("start"), F.array().cast("array<int>").alias("ends"),
    )
    tails = [*STOPS, *CLOSERS]

    def step(s: Column, x: Column) -> Column:
        t = x["t"]
        longer = s["open"] & ~s["space"] & t.isin(*tails)
        free = s["free"] | (is_cjk(t) & ~s["bar"])
        ends = s["open"] & ~longer & (free | (s["space"] & F.regexp_like(t, F.lit(r'^[A-Z0-9(\[“"‘]'))))
        cut = F.when(ends, F.concat(s["ends"], F.array(s["n"]))).otherwise(s["ends"])
        start = F.when(ends, s["n"]).otherwise(s["start"])
        short = (t == ".") & (F.lower(s["prev"]).isin(*ABBREVIATIONS) | F.regexp_like(s["prev"], F.lit("^[A-Z]$")))
        opens = t.isin(*STOPS) & ~short
        number = (t == ".") & (s["n"] == start + 1) & F.regexp_like(s["prev"], F.lit(r"^\d+$"))
        now_free = (t.isin(*CJK_STOPS) | is_cjk(s["prev"])) & ~number | t.isin(*DANDAS)
        return F.struct(
            (longer | opens).alias("open"),
            F.when(longer, s["free"] | t.isin(*CJK_STOPS, *DANDAS)).otherwise(now_free).alias("free"),
            F.when(longer, s["bar"]).otherwise(number).alias("bar"), t.alias("prev"), x["s"].alias("space"), (s["n"] + 1).alias("n"), start.alias("start"), cut.alias("ends"),
        )

    return F.aggregate(
        toks, state, step, lambda s: F.when(s["n"] > s["start"], F.concat(s["ends"], F.array(s["n"]))).otherwise(s["ends"])
    )


def plain(toks: Column) -> Column:
    """A token run as text."""
    return F.trim(F.array_join(F.transform(toks, lambda x: F.concat(x["t"], F.when(x["s"], F.lit(" ")).otherwise(F.lit("")))), ""))


def sentence_texts(toks: Column, ends: Column) -> Column:
    """array<string>: the texts of the sentences."""
    before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
    return F.transform(ends, lambda e, i: plain(F.slice(toks, before(i) + 1, e - before(i))))


def head_size(toks: Column, n: int) -> Column:
    """How many tokens hold the first n words: punctuation between them counts, none at the end."""
    at = F.filter(F.transform(toks, lambda x, i: F.when(is_word(x["t"]), i + 1)), lambda i: i.isNotNull())
    return F.coalesce(F.get(at, F.least(F.size(at), F.lit(n)) - 1), F.lit(0))


def terms(text: Column) -> Column:
    """array<string>: for each token of a text what two words must share to count as the same; empty for stop words and punctuation.

    Two passes, so that a word is made plain once: what stands twice in a lambda is computed twice.
    """
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    plain_words = F.transform(found, lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_\p{M}]+", ""))
    # A plural of four letters or more loses its s, if no s is before it.
    return F.transform(plain_words, lambda w: F.when(w.isin(*STOP_WORDS), F.lit("")).otherwise(F.regexp_replace(w, r"(?s)^(.{2,}[^s])s$", "$1")))


def cjk_share(text: Column) -> Column:
    """CJK characters over word characters; 0 without any."""
    cjk = F.regexp_count(text, F.lit(f"[{CJK}]"))
    word = F.regexp_count(text, F.lit(rf"[\p{{L}}\p{{N}}{CJK}]"))
    return F.when(word > 0, cjk / word).otherwise(F.lit(0.0))
