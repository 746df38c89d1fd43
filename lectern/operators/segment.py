"""Texts to units, tokens and sentences; keys; language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import languages as L
from ..functions import text as T


def units_of(docs: DataFrame, section_lines: int = 5) -> DataFrame:
    """doc_id, pos, unit_id, section_id, text: the non-blank lines of each text, numbered by line; sections by position."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).where("trim(text) <> ''")
    return lines.select(
        "doc_id", "pos", F.concat(F.lit("u"), "pos").alias("unit_id"),
        F.concat(F.lit("s"), F.floor(F.col("pos") / section_lines)).alias("section_id"), "text",
    )


def with_sentences(units: DataFrame) -> DataFrame:
    """units with toks, ends and sentences. Arrays inside a row: no shuffle."""
    return (
        units.withColumn("toks", T.tokens(F.col("text")))
        .withColumn("ends", T.sentence_ends(F.col("toks"), F.col("text")))
        .withColumn("sentences", T.sentence_texts(F.col("toks"), F.col("ends")))
    )


def tokens(units: DataFrame) -> DataFrame:
    """doc_id, pos, tok, t, s: one row a token."""
    toks = units.select("doc_id", "pos", F.posexplode(T.tokens(F.col("text"))).alias("tok", "x"))
    return toks.select("doc_id", "pos", "tok", "x.t", "x.s")


def sentences(units: DataFrame) -> DataFrame:
    """doc_id, pos, sent, tok_start, tok_end, text: one row a sentence, its half-open token range."""
    starts = F.concat(F.array(F.lit(0)), F.col("ends"))
    rows = F.zip_with("ends", "sentences", lambda e, t: F.struct(e.alias("tok_end"), t.alias("text")))
    out = with_sentences(units).withColumn("_starts", starts).select("doc_id", "pos", "_starts", F.posexplode(rows).alias("sent", "x"))
    return out.select("doc_id", "pos", "sent", F.get("_starts", F.col("sent")).alias("tok_start"), "x.tok_end", "x.text")


def terms(units: DataFrame) -> DataFrame:
    """doc_id, pos, term, n: the normalised words of each unit and how often; stop words and punctuation left out."""
    return units.select("doc_id", "pos", F.explode(T.terms(F.col("text"))).alias("term")).where("term <> ''").groupBy("doc_id", "pos", "term").agg(
        F.count(F.lit(1)).alias("n")
    )


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with token_words, md_words, effort and rough_tokens.

    token_words: tokens with a word character. md_words: CJK characters and Latin words outside code. effort: CJK
    characters count 1 / 1.6. rough_tokens: a CJK character one, four other characters one.
    """
    col = F.col(text)
    prose = F.regexp_replace(F.regexp_replace(col, r"(?s)```.*?```", " "), r"`[^`\n]*`", " ")
    cjk = F.regexp_count(prose, F.lit(f"[{T.CJK}]"))
    latin = F.regexp_count(prose, F.lit(rf"[\p{{L}}\p{{N}}_&&[^{T.CJK}]]+(?:['’\-][\p{{L}}\p{{N}}_&&[^{T.CJK}]]+)*"))
    wide = F.regexp_count(col, F.lit(r"[぀-ヿ㐀-䶿一-鿿가-힯]"))
    return df.withColumns({
        "token_words": F.size(F.filter(T.tokens(col), lambda x: T.is_word(x["t"]))),
        "md_words": cjk + latin,
        "effort": cjk / 1.6 + latin,
        "rough_tokens": wide + F.floor((F.length(col) - wide) / 4).cast("int"),
    })


def document_cjk_share(units: DataFrame, chars: int = 4000) -> DataFrame:
    """doc_id, share, is_cjk over the first characters of each document's units in order; the head is part of the rule."""
    upto = F.sum(F.length("text")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    head = units.withColumn("_before", F.coalesce(upto, F.lit(0))).where(F.col("_before") < chars)
    cut = F.substring(F.col("text"), F.lit(1), F.lit(chars) - F.col("_before"))
    word = F.regexp_count(cut, F.lit(r"[\p{L}\p{N}]"))
    cjk = F.regexp_count(cut, F.lit(f"[{T.CJK}]"))
    sums = head.select("doc_id", word.alias("w"), cjk.alias("c")).groupBy("doc_id").agg(F.sum("w").alias("w"), F.sum("c").alias("c"))
    share = F.when(F.col("w") > 0, F.col("c") / F.col("w")).otherwise(F.lit(0.0))
    return sums.select("doc_id", share.alias("share"), (share > 0.2).alias("is_cjk"))


def detect_language(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, detected: the script with most words, then the language by its own letters or small words.

    Code, formulas and reference marks are left out first. The head of 40,000 characters and 6,000 words belongs to the rule. Under five words or hits a text counts as English;
    ties go to the language that is listed first.
    """
    apart = r"(?s)```.*?```|`[^`\n]*`|\$\$.*?\$\$|\$[^$\s][^$\n]*\$|\[\^?[\w,–-]{1,20}\]"
    prose = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), apart, " ")
    head = F.col("_head")
    count = lambda rx: F.regexp_count(head, F.lit(rx))
    latin_words = F.slice(F.transform(F.regexp_extract_all(head, F.lit(r"([A-Za-zÀ-ɏḀ-ỿ]+)"), F.lit(1)), lambda w: F.lower(w)), 1, 6000)
    cyrillic = F.lower(F.array_join(F.regexp_extract_all(head, F.lit(r"([Ѐ-ӿ]+)"), F.lit(1)), ""))
    letters = F.array_join("_latin", "")
    order = {code: k for k, code in enumerate(L.SMALL_WORDS)}
    known_in = lambda words: lambda w: w.isin(*words)
    hits = [F.size(F.filter("_small", known_in(s.split()))) for s in L.SMALL_WORDS.values()]
    scored = F.array(*[F.struct(h.alias("n"), F.lit(-k).alias("k"), F.lit(c).alias("code")) for (c, k), h in zip(order.items(), hits)])
    best = F.array_max(scored)
    scripts = {
        "latin": count(r"[A-Za-zÀ-ɏḀ-ỿ]+").cast("double"), "cyrillic": count(r"[Ѐ-ӿ]+").cast("double"),
        "devanagari": count(r"[ऀ-ॿ]+").cast("double"), "hangul": count(r"[가-힯ᄀ-ᇿ]+").cast("double"),
        "cjk": (F.col("_han") + F.col("_kana")) / 1.7, "thai": count(r"[฀-๿]") / 4.0,
    }
    top = F.array_max(F.array(*[F.struct(n.alias("n"), F.lit(-k).alias("k"), F.lit(s).alias("script")) for k, (s, n) in enumerate(scripts.items())]))
    # The head is a column of its own: each count would clean the text again.
    counted = docs.withColumn("_head", F.substring(prose, 1, 40000)).withColumns({"_han": count(r"[一-鿿㐀-䶿]"), "_kana": count(r"[぀-ヿ]"), "_latin": latin_words})
    # Words of no list are left out once, so that the lists are asked for few.
    small = sorted({w for words in L.SMALL_WORDS.values() for w in words.split()})
    known = counted.withColumns({"_top": top, "_small": F.filter("_latin", known_in(small))})
    script, enough = F.col("_top.script"), F.col("_top.n") >= 5
    ukrainian = F.regexp_count(cyrillic, F.lit("[іїєґ]")) > 0.01 * F.length(cyrillic)
    vietnamese = F.regexp_count(letters, F.lit(f"[{L.VIETNAMESE}]")) > 0.03 * F.greatest(F.length(letters), F.lit(1))
    code = (
        F.when(~enough, "en")
        .when((script == "cjk") & (F.col("_kana") > 0.05 * (F.col("_han") + F.col("_kana"))), "ja")
        .when(script == "cjk", F.when(count(f"[{L.TRADITIONAL}]") > count(f"[{L.SIMPLIFIED}]"), "zh-Hant").otherwise("zh"))
        .when(script == "hangul", "ko").when(script == "thai", "th").when(script == "devanagari", "hi")
        .when(script == "cyrillic", F.when(ukrainian, "uk").otherwise("ru"))
        .when(vietnamese, "vi")
        .otherwise(F.when(best["n"] >= 5, best["code"]).otherwise("en"))
    )
    return known.select("doc_id", code.alias("detected"))


def split_units(units: DataFrame, most: int = 12, about: int = 7) -> DataFrame:
    """doc_id, pos, part, unit_id, sent_start, sent_end: units of more than `most` sentences in equal parts of about seven."""
    n = F.size("ends")
    sized = with_sentences(units).select("doc_id", "pos", "unit_id", n.alias("n"), (T.cjk_share(F.col("text")) > 0.2).alias("cjk"))
    parts = F.when((F.col("n") > most) & ~F.col("cjk"), F.ceil(F.col("n") / about)).otherwise(F.lit(1)).cast("int")
    size = F.ceil(F.col("n") / F.col("k")).cast("int")
    rows = sized.withColumn("k", parts).withColumn("size", size)
    out = rows.withColumn("part", F.explode(F.sequence(F.lit(1), F.greatest(F.ceil(F.col("n") / F.col("size")), F.lit(1)).cast("int"))))
    name = F.when(F.col("part") > 1, F.concat("unit_id", F.lit("~"), "part")).otherwise(F.col("unit_id"))
    start = (F.col("part") - 1) * F.col("size")
    return out.select("doc_id", "pos", "part", name.alias("unit_id"), start.alias("sent_start"), F.least("n", start + F.col("size")).alias("sent_end"))


# --- Keys -----------------------------------------------------------------------------------------------------------


def unit_keys(units: DataFrame) -> DataFrame:
    """doc_id, pos, key: p- and the digest of the text; the n-th repeat in reading order gets -n."""
    digest = F.substring(F.sha1("text"), 1, 8)
    n = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("pos"))
    keyed = units.select("doc_id", "pos", digest.alias("digest")).withColumn("n", n)
    key = F.concat(F.lit("p-"), "digest", F.when(F.col("n") > 1, F.concat(F.lit("-"), "n")).otherwise(F.lit("")))
    return keyed.select("doc_id", "pos", key.alias("key"))


def _slug(text: Column, size: int) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, size)


def page_keys(pages: DataFrame) -> DataFrame:
    """page_id, key: web-<host>-<digest of the url>."""
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(F.col("url"), F.lit("HOST")), F.lit(""))), r"^www\.", "")
    slug = F.substring(F.regexp_replace(host, "[^a-z0-9]+", "-"), 1, 40)
    return pages.select("page_id", F.concat(F.lit("web-"), slug, F.lit("-"), F.substring(F.sha2("url", 256), 1, 12)).alias("key"))


def text_keys(docs: DataFrame) -> DataFrame:
    """doc_id, key: md-<words of the first line>-<digest of the text>."""
    first = F.split("text", "\n", 2)[0]
    return docs.select("doc_id", F.concat(F.lit("md-"), _slug(first, 40), F.lit("-"), F.substring(F.sha1("text"), 1, 8)).alias("key"))


#: Owners that are pages of the site, not people.
RESERVED_OWNERS = ("features", "topics", "about", "pricing", "login", "settings", "marketplace", "sponsors", "explore", "orgs")


def classify_refs(refs: DataFrame, ref: str, stored: DataFrame | None = None) -> DataFrame:
    """refs with kind and key: what a link or id names, the first rule that matches. stored: key, ids already known."""
    x = F.trim(F.col(ref))
    known = refs
    hit = F.lit(False)
    if stored is not None:
        known = refs.join(stored.select(F.col("key").alias("_key")), x == F.col("_key"), "left")
        hit = F.col("_key").isNotNull()
    repo = r"^(?:https?://)?(?:www\.)?github\.com/([\w.-]+)/([\w.-]+?)(?:\.git)?(?:[/?#].*)?$"
    arxiv = r"(?i)(?:^|arxiv\.org/(?:abs|pdf|html)/|arxiv:|10\.48550/arxiv\.)(\d{4}\.\d{4,5}(?:v\d+)?)(?:\.pdf)?(?:[?#].*)?$"
    wiki = r"^https?://([a-z-]+)\.(?:m\.)?wikipedia\.org/wiki/([^?#]+)"
    preprint = r"(10\.(?:1101|64898)/[0-9.]+)"
    pmc = r"(?i)\b(PMC\d+|PPR\d+)\b"
    doi = r"(10\.\d{4,9}/[^\s?#]+)"
    owner = F.lower(F.regexp_extract(x, repo, 1))
    rules = [
        (hit, "stored", x),
        (F.regexp_like(x, F.lit(repo)) & ~owner.isin(*RESERVED_OWNERS), "github", F.concat(owner, F.lit("/"), F.lower(F.regexp_extract(x, repo, 2)))),
        (F.regexp_like(x, F.lit(arxiv)), "arxiv", F.regexp_extract(x, arxiv, 1)),
        (F.regexp_like(x, F.lit(r"^(?:md|pdf|doc|web)-[\w-]+$")), "imported", x),
        (F.regexp_like(x, F.lit(wiki)), "wikipedia", F.concat(F.regexp_extract(x, wiki, 1), F.lit(":"), F.regexp_extract(x, wiki, 2))),
        (F.regexp_like(x, F.lit(preprint)), "preprint", F.regexp_extract(x, preprint, 1)),
        (F.regexp_like(x, F.lit(pmc)), "europepmc", F.upper(F.regexp_extract(x, pmc, 1))),
        (F.regexp_like(x, F.lit(doi)), "doi", F.lower(F.regexp_extract(x, doi, 1))),
        (F.regexp_like(x, F.lit(r"^https?://")), "web", x),
    ]
    kind, key = F.lit("error"), F.lit(None).cast("string")
    for test, name, value in reversed(rules):
        kind, key = F.when(test, F.lit(name)).otherwise(kind), F.when(test, value).otherwise(key)
    return known.select(*refs.columns, kind.alias("kind"), key.alias("key"))
