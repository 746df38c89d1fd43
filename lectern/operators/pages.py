"""Web pages to blocks: visible markup, article, metadata, furniture, signals, checks."""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import search

PAGE_CHARS = 8 * 1024 * 1024
BLOCK_TAGS = "p|li|td|th|h[1-6]|figcaption|blockquote|dd|dt|pre|caption"
_HIDDEN_CLASSES = ("sr-only", "visually-hidden", "hidden", "d-none", "screen-reader-text")
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&amp;": "&"}


def read_pages(pages: DataFrame, least_words: int = 80) -> DataFrame:
    """pages with html cut at 8 MiB (the reader's limit) and has_text: at least 80 words outside markup."""
    cut = pages.withColumn("html", F.substring("html", 1, PAGE_CHARS))
    return cut.withColumn("has_text", F.regexp_count(strip_tags(F.col("html")), F.lit(r"[^\s]+")) >= least_words)


def strip_tags(html: Column) -> Column:
    """Text of markup: scripts, styles, comments and tags off, references decoded, single spaces."""
    s = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>", " ")
    s = F.regexp_replace(s, r"<[^>]*>", " ")
    for ref, char in ENTITIES.items():
        s = F.replace(s, F.lit(ref), F.lit(char))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def visible_html(pages: DataFrame) -> DataFrame:
    """pages with visible: html without comments, scripts, styles, templates and elements that are hidden and hold no others."""
    classes = "|".join(_HIDDEN_CLASSES)
    flat = r"(?:(?!<)[\s\S])*?"
    s = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>", "")
    hide = rf"""(?:aria-hidden=["']?true|\shidden(?=[\s>=])|style=["'][^"']*(?:display:\s*none|visibility:\s*hidden|opacity:\s*0(?![.\d])|font-size:\s*0)|class=["'](?:[^"']*\s)?(?:{classes})[\s"'])"""
    s = F.regexp_replace(s, rf"(?i)<([a-z][a-z0-9]*)\b[^>]*{hide}[^>]*>{flat}</\1\s*>", "")
    return pages.withColumn("visible", s)


def extract_article(pages: DataFrame, share: float = 0.6) -> DataFrame:
    """page_id, article: the longest article, else main, if it holds enough of the page's text; else the body without header, footer, aside and nav."""
    body = F.regexp_replace("visible", r"(?is)<(head|header|footer|aside|nav)\b.*?</\1\s*>", " ")
    longest = lambda tag: F.array_max(F.transform(
        F.regexp_extract_all("visible", F.lit(rf"(?is)(<{tag}\b.*?(?:</{tag}\s*>|(?=<footer\b)|\z))"), F.lit(1)),
        lambda x: F.struct(F.length(x).alias("n"), x.alias("x")),
    ))["x"]
    made = visible_html(pages).withColumns({"_body": body, "_pick": F.coalesce(longest("article"), longest("main"))})
    texts = made.withColumns({"_b": strip_tags(F.col("_body")), "_p": strip_tags(F.col("_pick"))})
    b = search.with_shingles(texts.withColumn("text", F.col("_b"))).withColumnRenamed("shingles", "_bs")
    both = search.with_shingles(b.withColumn("text", F.coalesce("_p", F.lit(""))))
    held = F.size(F.array_intersect("_bs", "shingles")) >= F.lit(share) * F.size("_bs")
    return both.select("page_id", F.when(F.col("_pick").isNotNull() & held & (F.size("_bs") > 0), F.col("_p")).otherwise(F.col("_b")).alias("article"))


def page_meta(pages: DataFrame) -> DataFrame:
    """page_id, title (without the site's name at its end), host (without www.), authors (12 at most), license (a URL only)."""
    title = strip_tags(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(F.col("url"), F.lit("HOST")), F.lit(""))), r"^www\.", "")
    site = F.regexp_extract("html", r'(?is)<meta[^>]*property=["\']og:site_name["\'][^>]*content=["\']([^"\']*)', 1)
    author = F.regexp_extract("html", r'(?is)<meta[^>]*name=["\']author["\'][^>]*content=["\']([^"\']*)', 1)
    lic = F.regexp_extract("html", r'(?is)<link[^>]*rel=["\']license["\'][^>]*href=["\'](https?://[^"\']+)', 1)
    named = pages.select("page_id", title.alias("_t"), host.alias("host"), site.alias("_s"), author.alias("_a"), lic.alias("license"))
    tail = F.regexp_extract("_t", r"\s*[-|–—·:]\s*([^-|–—·:]+)$", 1)
    known = (tail != "") & (F.lower(tail).isin(F.lower("_s")) | (F.lower(tail) == F.col("host")))
    cut = F.when(known, F.regexp_replace("_t", r"\s*[-|–—·:]\s*[^-|–—·:]+$", "")).otherwise(F.col("_t"))
    authors = F.slice(F.filter(F.transform(F.split("_a", r"\s*;\s*|\s+and\s+"), lambda a: F.trim(a)), lambda a: a != ""), 1, 12)
    return named.select("page_id", cut.alias("title"), "host", authors.alias("authors"), "license")


def html_blocks(pages: DataFrame) -> DataFrame:
    """page_id, pos, tag, text: the smallest text blocks in order, quotes straight, dashes plain, single spaces.

    A block ends where the next one of any kind begins, so markup that closes nothing still splits.
    """
    cut = F.split(F.col("visible"), rf"(?i)(?=<(?:{BLOCK_TAGS})\b)")
    rows = visible_html(pages).select("page_id", F.posexplode(cut).alias("pos", "part")).where("pos > 0")
    tag = F.lower(F.regexp_extract("part", r"^<([a-zA-Z][a-zA-Z0-9]*)", 1))
    inner = F.regexp_replace("part", rf"(?is)</(?:{BLOCK_TAGS}|article|section|div|ul|ol|table|nav|main)\s*>.*$", "")
    text = F.translate(strip_tags(inner), "‘’“”–—‐‑−", "''\"\"-----")
    return rows.select("page_id", "pos", tag.alias("tag"), text.alias("text"), "part").where("text <> ''")


def br_paragraphs(pages: DataFrame, column: str = "html") -> DataFrame:
    """page_id, pos, text: runs that two or more line breaks in a row set apart."""
    rows = pages.select("page_id", F.posexplode(F.split(F.col(column), r"(?i)(?:<br\s*/?>\s*){2,}")).alias("pos", "x"))
    return rows.select("page_id", "pos", strip_tags(F.col("x")).alias("text")).where("text <> ''")


def strip_furniture(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """Blocks (html_blocks) without the site's furniture; titles: page_id, title.

    Before the article's own words (a block of 30 words or more, under half of them links) short blocks that are all
    links or punctuation go; headings with nothing under them go, as does a first heading that repeats the title;
    bullets typed into list items go.
    """
    words = lambda c: F.regexp_count(c, F.lit(r"[^\s]+"))
    linked = strip_tags(F.array_join(F.regexp_extract_all("part", F.lit(r"(?is)<a\b[^>]*>(.*?)</a\s*>"), F.lit(1)), " "))
    w = Window.partitionBy("page_id").orderBy("pos")
    b = blocks.withColumns({"n": words(F.col("text")), "ln": words(linked), "heading": F.col("tag").rlike("^h[1-6]$")})
    body = (F.col("n") >= 30) & (F.col("ln") * 2 < F.col("n"))
    b = b.withColumn("begun", F.max(body.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bare = ~F.regexp_like("text", F.lit(r"[\p{L}\p{N}]"))
    b = b.where((F.col("begun") == 1) | ~((F.col("n") <= 12) & ((F.col("ln") >= F.col("n")) | bare)))
    b = b.withColumns({"next": F.lead("heading").over(w), "first": F.row_number().over(w) == 1}).join(titles, "page_id", "left")
    empty = F.col("heading") & F.coalesce(F.col("next"), F.lit(True))
    same = F.col("heading") & F.col("first") & (F.lower("text") == F.lower(F.coalesce("title", F.lit(""))))
    text = F.when(F.col("tag") == "li", F.regexp_replace("text", r"^[•·▪◦‣*-]\s+", "")).otherwise(F.col("text"))
    return b.where(~(empty | same)).select("page_id", "pos", "tag", text.alias("text"))


def page_signals(pages: DataFrame) -> DataFrame:
    """page_id and counts: tooltips, note-like classes, buttons in cells, drawn elements, paywall marks, characters of script and text, apps, generated class names."""
    count = lambda rx: F.regexp_count("html", F.lit(rx)).cast("int")
    chars = lambda rx: F.coalesce(F.length(F.array_join(F.regexp_extract_all("html", F.lit(rx), F.lit(0)), "")), F.lit(0))
    flag = F.get_json_object(F.regexp_extract("html", r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>', 1), "$.isAccessibleForFree")
    paywall = (F.coalesce(F.lower(flag), F.lit("")) == "false") | F.regexp_like("html", F.lit(r"(?i)class=[\"'][^\"']*paywall|subscribe to (?:read|continue)"))
    names = F.regexp_extract_all("html", F.lit(r"class=[\"']([^\"']+)"), F.lit(1))
    odd = F.filter(names, lambda x: F.regexp_like(x, F.lit(r"(?:^|\s)(?:css|sc|jsx?)-[a-z0-9]{5,}|[a-zA-Z]+_[a-zA-Z]+__[A-Za-z0-9]{5}")))
    return pages.select(
        "page_id", count(r"(?i)role=[\"']tooltip|class=[\"'][^\"']*tooltip").alias("tooltips"),
        count(r"(?i)class=[\"'][^\"']*(?:sidenote|footnote|marginnote)").alias("note_classes"),
        count(r"(?i)<td\b[^>]*>\s*<button").alias("cell_buttons"), count(r"(?i)<(?:canvas|svg)\b").alias("drawn"),
        paywall.alias("paywall"), chars(r"(?is)<script\b.*?</script>").alias("script_chars"),
        F.length(strip_tags(F.col("html"))).alias("text_chars"), count(r"(?i)id=[\"'](?:root|app|__next)[\"']").alias("apps"),
        F.when(F.size(names) > 0, F.size(odd) / F.size(names)).otherwise(F.lit(0.0)).alias("generated_share"),
    )


def reading_check(pages: DataFrame, units: DataFrame, least_words: int = 5, probe: int = 10, least_unit: int = 6) -> DataFrame:
    """page_id, absent, missing, unclear: a reading against its page.

    units: page_id, pos, text. absent: sentences of five words or more that the page does not hold; missing: page blocks
    of which under 80 % of the sentences are in the reading; unclear: units of six words or more whose first ten words do
    not stand exactly once on the page.
    """
    words = lambda c: F.regexp_count(c, F.lit(r"[^\s]+"))
    blocks = html_blocks(pages).select("page_id", "pos", "text")
    whole = pages.select("page_id", strip_tags(F.col("html")).alias("page"))
    reading = units.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "text"))).getField("text"), " ").alias("reading"))
    cut = lambda c: F.split(c, r"(?<=[.!?])\s+")
    s = units.select("page_id", F.explode(cut(F.col("text"))).alias("s")).where(words(F.col("s")) >= least_words).join(whole, "page_id")
    absent = s.groupBy("page_id").agg(F.sum((~F.col("page").contains(F.col("s"))).cast("int")).alias("absent"))
    bs = blocks.select("page_id", "pos", F.explode(cut(F.col("text"))).alias("s")).where(words(F.col("s")) >= least_words).join(reading, "page_id", "left")
    share = bs.groupBy("page_id", "pos").agg(F.avg(F.coalesce(F.col("reading").contains(F.col("s")), F.lit(False)).cast("double")).alias("share"))
    missing = share.groupBy("page_id").agg(F.sum((F.col("share") < 0.8).cast("int")).alias("missing"))
    lead = F.array_join(F.slice(F.split("text", " "), 1, probe), " ")
    u = units.where(words(F.col("text")) >= least_unit).select("page_id", lead.alias("lead")).join(whole, "page_id")
    times = (F.length("page") - F.length(F.replace("page", F.col("lead"), F.lit("")))) / F.length("lead")
    unclear = u.groupBy("page_id").agg(F.sum((times != 1).cast("int")).alias("unclear"))
    out = pages.select("page_id")
    for part in (absent, missing, unclear):
        out = out.join(part, "page_id", "left")
    return out.select("page_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("absent", "missing", "unclear")])


def choose_reading(candidates: DataFrame, preferred: str, least_words: int = 80, much_more: float = 1.5) -> DataFrame:
    """page_id, reader, text: of the readings with 80 words or more the preferred one, unless another has 1.5 times its words."""
    n = F.regexp_count("text", F.lit(r"[^\s]+"))
    c = candidates.withColumn("n", n).where(F.col("n") >= least_words).withColumn("mine", F.col("reader") == preferred)
    best = c.groupBy("page_id").agg(
        F.max(F.when(F.col("mine"), F.struct("n", "reader", "text"))).alias("p"), F.max(F.when(~F.col("mine"), F.struct("n", "reader", "text"))).alias("o")
    )
    pick = F.when(F.col("p").isNull() | (F.col("o.n") >= F.lit(much_more) * F.col("p.n")), F.col("o")).otherwise(F.col("p"))
    return best.select("page_id", pick.alias("x")).select("page_id", "x.reader", "x.text")


# --- Nested markup: one page at a time in Arrow batches ------------------------------------------------------------


class _Tree(HTMLParser):
    """A page as nested lists: [tag, attributes, children]."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, {k: v or "" for k, v in attrs}, []]
        self.open[-1][2].append(node)
        if tag not in self.VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1][2].append(data)


def _read(html: str) -> list:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


class Element:
    """An element of a page: its attributes, what it holds in order, where it hangs, its place in the page and its last one's."""

    __slots__ = ("tag", "attrs", "kids", "up", "at", "end")

    def __init__(self, tag: str, attrs: dict[str, str], up: Element | None, at: int):
        self.tag, self.attrs, self.up, self.at, self.end = tag, attrs, up, at, at
        self.kids: list[Element | str] = []

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def holds(self, other: Element) -> bool:
        return self.at <= other.at <= self.end

    def above(self) -> Iterator[Element]:
        node = self.up
        while node is not None:
            yield node
            node = node.up


class Index:
    """A page's elements in order, those with an id, and which elements name an id (by a description, a control or a link)."""

    def __init__(self, html: str):
        self.all: list[Element] = []
        self.ids: dict[str, Element] = {}
        self.naming: dict[str, list[Element]] = {}
        self.root = Element("", {}, None, 0)
        self.all.append(self.root)
        stack = [(self.root, iter(_read(html)[2]))]  # page order without recursion, as pages may be deep
        while stack:
            at, rest = stack[-1]
            kid = next(rest, None)
            if kid is None:
                at.end = len(self.all) - 1
                stack.pop()
            elif isinstance(kid, str):
                at.kids.append(kid)
            else:
                made = Element(kid[0], kid[1], at, len(self.all))
                at.kids.append(made)
                self.all.append(made)
                if made.attrs.get("id"):
                    self.ids.setdefault(made.attrs["id"], made)
                for name in names_of(made):
                    self.naming.setdefault(name, []).append(made)
                stack.append((made, iter(kid[2])))

    def unlink(self) -> None:
        """Let go of the elements: they hold each other, and would stay until Python looks for such circles."""
        for e in self.all:
            e.up, e.kids = None, []


#: So many pages are Python objects at once; an Arrow batch may have 10,000.
PAGES_AT_ONCE = 16


def _by_page(read: Callable[[dict], Iterable[tuple]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows that `read` makes of each page, for mapInArrow: a few pages at a time, so that memory follows the page and not the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_AT_ONCE):
                rows = [row for page in batch.slice(at, PAGES_AT_ONCE).to_pylist() for row in read(page)]
                yield pa.RecordBatch.from_arrays([pa.array([row[k] for row in rows], kind) for k, kind in enumerate(schema.types)], schema=schema)

    return run


def names_of(e: Element) -> list[str]:
    """The ids that an element names."""
    href = e.attrs.get("href", "")
    return [*e.attrs.get("aria-describedby", "").split(), *e.attrs.get("aria-controls", "").split(), *([href.partition("#")[2]] if "#" in href else [])]


#: Elements inside which a note belongs to a sentence, and those that show no words.
_IN_TEXT = frozenset("p li dd dt td th figcaption blockquote h1 h2 h3 h4 h5 h6".split())
_NO_WORDS = frozenset("script style button svg canvas input template noscript iframe video audio".split())
_APART = frozenset("p div section aside blockquote ul ol li dl dt dd table tr td th h1 h2 h3 h4 h5 h6 figure figcaption br".split())
_MARK = re.compile(r"\[?(?:\d{1,3}[a-z]?|[a-z]|[*†‡§¶⊕]{1,3})\]?|\(\d{1,3}\)", re.I)
_LEADING = re.compile(r"[\[(]?(\d+|[*†‡§])[\])]?[.:]?\s*")


def shown_text(e: Element | str, cut: set[int], said: dict[int, str]) -> str:
    """The words of an element without those that are cut; `said` are words in place of some elements. Both by place in the page."""
    out, todo = [], [e]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.at in said:
            out.append(said[x.at])
        elif x.at not in cut and x.tag not in _NO_WORDS:
            apart = [" "] if x.tag in _APART else []
            todo += [*apart, *reversed(x.kids), *apart]
    return " ".join("".join(out).split())


def paired(notes: list[Element], marks: list[Element], index: Index) -> dict[int, Element]:
    """The mark of each note, by the note's place: the one that names it, the one that it links back to, else the nearest before it."""
    free = {m.at: m for m in marks}
    out: dict[int, Element] = {}
    for note in notes:
        named = [m for m in index.naming.get(note.attrs.get("id", ""), []) if m.at in free]
        back = [free[t.at] for e in index.all[note.at : note.end + 1] for n in names_of(e) if (t := index.ids.get(n)) is not None and t.at in free]
        near = [free[k] for k in sorted(free) if k < note.at][-1:]
        for mark in [*named, *back, *near][:1]:
            out[note.at] = free.pop(mark.at)
    return out


def sentence_notes(index: Index, given: dict[int, Element] | None = None, gone: Collection[int] = ()) -> tuple[list[tuple[str, str]], set[int]]:
    """(mark, words) of the notes that stand inside sentences, in page order, and the places that go from the text with them.

    given: notes that a recipe has found, by place, with their marks; gone: places of elements that are dropped with all in them. A mark is the text of the element that names the note, or that
    the note links back to, if it reads like one; else what the note's words begin with; else the note's number among its kind. A
    tooltip without any is cut and is no note. Notes inside notes go with them.
    """
    given = given or {}
    found: list[tuple[str, str]] = []
    cut: set[int] = set()
    count: dict[str, int] = {}
    past = -1
    for e in index.all:
        if e.at <= past:
            continue
        if e.at in gone:
            past = e.end
            continue
        role, classes = e.attrs.get("role", ""), e.classes()
        inside = any(u.tag in _IN_TEXT for u in e.above())
        kind = (
            "given" if e.at in given else "tip" if role == "tooltip" or "tooltip" in classes else "foot" if role in ("doc-footnote", "doc-endnote") and inside
            else "distill" if e.tag == "d-footnote" else "side" if "sidenote" in classes and inside else "margin" if "marginnote" in classes and inside else ""
        )
        if not kind:
            continue
        past = e.end
        back = [t for x in index.all[e.at + 1 : e.end + 1] for n in names_of(x) if (t := index.ids.get(n)) is not None and not e.holds(t)]
        mark = given.get(e.at) or next((m for m in [*index.naming.get(e.attrs.get("id", ""), []), *back] if not e.holds(m)), None)
        label = "".join(shown_text(mark, {e.at}, {}).split()) if mark is not None else ""
        words = shown_text(e, set(), {})
        count[kind] = count.get(kind, 0) + 1
        if not _MARK.fullmatch(label):
            first = _LEADING.match(words)
            label, words = (first[1], words[first.end() :]) if first else ("" if kind == "tip" else str(count[kind]), words)
            mark = mark if kind == "given" else None
        cut.add(e.at)
        if label:
            found.append((label, words))
            if mark is not None and not mark.holds(e):
                cut.add(mark.at)
    return found, cut


def inline_notes(pages: DataFrame) -> DataFrame:
    """page_id, n, mark, words, html_text: notes that stand inside sentences, cut out, and the text without them (n null).

    Tooltips with a mark, doc-footnote and doc-endnote roles, sidenotes and marginnotes inside a paragraph, and d-footnote; their marks
    go from the text with them (see sentence_notes).
    """

    def read(page: dict) -> Iterator[tuple]:
        index = Index(page["html"])
        found, cut = sentence_notes(index)
        yield page["page_id"], None, None, None, shown_text(index.root, cut, {})
        yield from ((page["page_id"], k, mark, words, None) for k, (mark, words) in enumerate(found))
        index.unlink()

    text = pa.string()
    run = _by_page(read, pa.schema([("page_id", pa.int64()), ("n", pa.int32()), ("mark", text), ("words", text), ("html_text", text)]))
    return pages.select("page_id", "html").mapInArrow(run, "page_id long, n int, mark string, words string, html_text string")


_SELECTOR = re.compile(r"^([a-zA-Z][\w-]*)?((?:#[\w-]+|\.[\w-]+|\[[\w-]+(?:=[\"']?[^\]\"']*[\"']?)?\])*)$")


def _matcher(selector: str):
    """A test of (tag, attributes) for the subset tag, #id, .class, [attr=value]; None for anything else."""
    m = _SELECTOR.match(selector.strip())
    if not m or not selector.strip():
        return None
    tests = re.findall(r"#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:=[\"']?([^\]\"']*)[\"']?)?\]", m[2])

    def test(tag: str, attrs: dict[str, str]) -> bool:
        if m[1] and tag != m[1].lower():
            return False
        for i, c, a, v in tests:
            if i and attrs.get("id") != i or c and c not in attrs.get("class", "").split() or a and (a not in attrs or v and attrs[a] != v):
                return False
        return True

    return test


def _caption(figure: Element, index: Index, taken: set[int], figures: list[Element]) -> str:
    """A figure's words: the caption inside it, its label, its first heading; else the nearest free caption under the nearest ancestor
    that has one; else an arrow."""
    caption = lambda e: e.tag == "figcaption" or any("caption" in c.lower() for c in e.classes())
    inside = index.all[figure.at + 1 : figure.end + 1]
    own = next((e for e in inside if e.tag == "figcaption"), None) or next((e for e in inside if caption(e)), None)
    words = shown_text(own, set(), {}) if own is not None else figure.attrs.get("aria-label", "").strip()
    if not words:
        words = next((shown_text(e, set(), {}) for e in inside if re.fullmatch("h[1-6]", e.tag)), "")
    if own is None and not words:
        for up in figure.above():
            free = [e for e in index.all[up.at + 1 : up.end + 1] if caption(e) and e.at not in taken and not any(f.holds(e) for f in figures)]
            if free:
                own = min(free, key=lambda e: (abs(e.at - figure.at), e.at))
                taken.add(own.at)
                words = shown_text(own, set(), {})
                break
    return words or "↗"


_READ = "page_id long, host string, text string, hits map<string,int>, figures array<struct<caption:string,link:string>>, notes array<struct<mark:string,words:string>>"


def apply_recipes(pages: DataFrame, recipes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page_id, host, text, hits map, figures, notes), (host, selector, hits): pages read by their site's rules, and how often each matched.

    recipes: host, article, drop, content, and if there are any figures (arrays of selectors) and notes (array of mark and note
    selectors); one row a site. Spark broadcasts them if they are small and shuffles pages by host if not. A figure is its caption in
    the text, with a link to its place on the page. A note of a pair belongs to the mark that names it, to the one that it links back to,
    else to the nearest free one before it; a note without a mark stays text. Notes that say what they are need no pair. Selectors outside
    the subset (such as pseudo-states) match nothing and show no hits.
    """
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(F.col("url"), F.lit("HOST")), F.lit(""))), r"^www\.", "")
    for name, kind in (("figures", "array<string>"), ("notes", "array<struct<mark:string,note:string>>")):
        if name not in recipes.columns:
            recipes = recipes.withColumn(name, F.array().cast(kind))
    joined = pages.withColumn("host", host).join(recipes, "host")

    def read_by(url, html, article, drop, content, figures, pairs) -> tuple:
        index = Index(html)
        chosen: dict[str, list[Element]] = {}
        for s in (article, *drop, *content, *figures, *(x for p in pairs for x in (p["mark"], p["note"]))):
            test = _matcher(s)
            chosen[s] = [e for e in index.all[1:] if test and test(e.tag, e.attrs)]
        dropped = [e for s in drop for e in chosen[s]]
        lost = lambda e: any(d is not e and d.holds(e) for d in dropped)
        chosen = {s: [e for e in found if not lost(e) and (s in drop or not any(d is e for d in dropped))] for s, found in chosen.items()}
        roots = [e for s in (article, *content) for e in chosen[s]]
        roots = sorted({e.at: e for e in roots if not any(r is not e and r.holds(e) for r in roots)}.values(), key=lambda e: e.at)
        shown = lambda e: any(r.holds(e) for r in roots)
        given: dict[int, Element] = {}
        for p in pairs:
            given |= paired([e for e in chosen[p["note"]] if shown(e)], [e for e in chosen[p["mark"]] if shown(e)], index)
        cut, said, drawn, taken = {e.at for e in dropped}, {}, [], set()
        notes, gone = sentence_notes(index, given, cut)
        cut |= gone
        drawings = [e for s in figures for e in chosen[s] if shown(e)]
        for e in sorted(drawings, key=lambda e: e.at):
            words = _caption(e, index, taken, drawings)
            drawn.append((words, url.split("#")[0] + ("#" + e.attrs["id"] if e.attrs.get("id") else "")))
            said[e.at] = f" {words} "
        cut |= taken
        text = " ".join(filter(None, (shown_text(r, cut, said) for r in roots)))
        index.unlink()
        return text, {s: len(found) for s, found in chosen.items()}, drawn, notes

    def row(page: dict) -> Iterator[tuple]:
        text, hits, drawn, notes = read_by(page["url"] or "", *(page[c] for c in ("html", "article", "drop", "content", "figures", "notes")))
        figures = [{"caption": c, "link": k} for c, k in drawn]
        yield page["page_id"], page["host"], text, list(hits.items()), figures, [{"mark": m, "words": w} for m, w in notes]

    text = pa.string()
    pairs = lambda *names: pa.list_(pa.struct([(n, text) for n in names]))
    run = _by_page(row, pa.schema([("page_id", pa.int64()), ("host", text), ("text", text), ("hits", pa.map_(text, pa.int32())), ("figures", pairs("caption", "link")), ("notes", pairs("mark", "words"))]))
    read = joined.select("page_id", "host", "url", "html", "article", "drop", "content", "figures", "notes").mapInArrow(run, _READ)
    counts = read.select("host", F.explode("hits").alias("selector", "n")).groupBy("host", "selector").agg(F.sum("n").alias("hits"))
    return read, counts
