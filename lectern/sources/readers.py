"""Readers: text files, delimited text, notes, bibliographies, article metadata, page Markdown, streams."""

from __future__ import annotations

from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TEXT_GLOB = "*.{md,markdown,mdown,txt}"
#: Code pages that are tried in order when bytes are not UTF-8.
CODE_PAGES = ("gb18030", "cp1252", "latin-1")
CSV_HEAD, CSV_ROWS, CSV_COLUMNS = 8_192, 1_000, 50


def decode_fallback(files: DataFrame, content: str = "content") -> DataFrame:
    """files with text: UTF-8 with its mark off where valid; only other rows go to Python, for the code pages in order."""

    @F.pandas_udf("string")
    def other(data: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            for page in CODE_PAGES:
                try:
                    return None if b is None else bytes(b).decode(page)
                except UnicodeDecodeError:
                    continue
            return bytes(b).decode("utf-8", "replace")

        return data.map(one)

    valid = F.is_valid_utf8(F.col(content).cast("string"))
    good = files.where(valid).withColumn("text", F.regexp_replace(F.decode(content, "UTF-8"), "^﻿", ""))
    return good.unionByName(files.where(~valid).withColumn("text", other(F.col(content))))


def title_of(text: Column, path: Column) -> Column:
    """The title in the text's head block, else its only first-level heading, else the file's name with spaces."""
    head = F.regexp_extract(text, r"(?s)\A---\s*\n(.*?)\n---\s*(?:\n|\z)", 1)
    named = F.trim(F.regexp_replace(F.regexp_extract(head, r"(?m)^title:[ \t]*(.+)$", 1), r"""^["']|["']\s*$""", ""))
    heads = F.regexp_extract_all(text, F.lit(r"(?m)^#[ \t]+(.+?)[ \t#]*$"), F.lit(1))
    stem = F.regexp_replace(F.regexp_extract(F.url_decode(path), r"([^/]+?)(?:\.[A-Za-z]+)?$", 1), "[_-]+", " ")
    return F.when(named != "", named).when(F.size(heads) == 1, F.get(heads, F.lit(0))).otherwise(F.trim(stem))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, title, text of the text files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", TEXT_GLOB).option("recursiveFileLookup", "true").load(path)
    texts = decode_fallback(files.select("path", "content"))
    return texts.select("path", title_of(F.col("text"), F.col("path")).alias("title"), "text")


def sniff_separator(text: Column) -> Column:
    """The separator that the head of a text has most of: comma, semicolon, tab or bar; a comma on a tie."""
    head = F.substring(text, 1, CSV_HEAD)
    counts = [F.struct((F.length(head) - F.length(F.replace(head, F.lit(s), F.lit("")))).alias("n"), F.lit(-k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(",;\t|")]
    return F.array_max(F.array(*counts))["s"]


#: Stand between the cells and the rows of a text while its quotes are read; where a text holds them they are escaped.
_ESCAPE, _ROW, _CELL = "\x1d", "\x1e", "\x1f"


def delimited_cells(text: Column, separator: Column) -> Column:
    """array<array<string>>: the rows and cells of a delimited text, as Python's csv reads them.

    One scan over the text takes a cell after the other: a quote that begins a cell holds separators and line ends until it is closed,
    a doubled one is a quote, what stands behind the closing one belongs to the cell, and elsewhere quotes are as they are. A
    quote that is never closed holds the rest. A blank line is a row of one empty cell.
    """
    bare = F.replace(F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "0")), F.lit(_ROW), F.lit(_ESCAPE + "1")), F.lit(_CELL), F.lit(_ESCAPE + "2"))
    cells = F.lit(None).cast("array<struct<quoted:string,plain:string,end:string>>")
    for s in ",;\t|":
        cell = rf'(?s)(?:"([^"]*+(?:""[^"]*+)*+)(?:"|\z))?+([^{s}\r\n]*+)([{s}]|\r\n|\r|\n|\z)'
        parts = F.arrays_zip(*[F.regexp_extract_all(bare, F.lit(cell), F.lit(k)).alias(n) for k, n in enumerate(("quoted", "plain", "end"), 1)])
        cells = F.when(separator == s, parts).otherwise(cells)
    # A cell that ended with the text is followed by an empty match.
    cells = F.when(F.get(cells, F.size(cells) - 2)["end"] == "", F.slice(cells, F.lit(1), F.size(cells) - 1)).otherwise(cells)
    mark = lambda e: F.when(e == "", "").when(F.substring(e, 1, 1).isin("\r", "\n"), _ROW).otherwise(_CELL)
    shown = F.transform(cells, lambda c: F.concat(F.replace(c["quoted"], F.lit('""'), F.lit('"')), c["plain"], mark(c["end"])))
    back = lambda c: F.replace(F.replace(F.replace(c, F.lit(_ESCAPE + "2"), F.lit(_CELL)), F.lit(_ESCAPE + "1"), F.lit(_ROW)), F.lit(_ESCAPE + "0"), F.lit(_ESCAPE))
    return F.transform(F.split(F.array_join(shown, ""), _ROW), lambda row: F.transform(F.split(row, _CELL), back))


def read_sniffed_csv(texts: DataFrame, key: str, max_rows: int = CSV_ROWS, max_columns: int = CSV_COLUMNS) -> DataFrame:
    """key, row, cells: the rows of delimited texts (key, text); row 0 is the header.

    Blank rows go and empty cells at a row's end; whole floats lose their fraction (and a zero its sign), midnights their time. Rows over the
    limit become one row of "…": the limit is the reader's. A text's rows are made from the text alone, without a shuffle.
    """
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), r"^(?:-(?=0+\.))?(-?\d+)\.0+$", "$1"), r"^(\d{4}-\d{2}-\d{2})[ T]00:00(?::00)?$", "$1")
    rows = F.transform(delimited_cells(F.col("text"), sniff_separator(F.col("text"))), lambda row: F.transform(row, plain))
    width = lambda row: F.array_max(F.transform(row, lambda c, i: F.when(c != "", i + 1).otherwise(0)))
    cut = F.transform(rows, lambda row: F.slice(row, F.lit(1), F.least(width(row), F.lit(max_columns))))
    made = texts.select(key, F.filter(cut, lambda row: F.size(row) > 0).alias("rows"))
    more = F.when(F.size("rows") > max_rows + 1, F.array(F.array(F.lit("…")))).otherwise(F.array().cast("array<array<string>>"))
    return made.select(key, F.posexplode(F.concat(F.slice("rows", 1, max_rows + 1), more)).alias("row", "cells"))


NOTE_SCHEMA = (
    "format string, version int, paper struct<id:string,version:string,title:string,url:string>, notes array<struct<id:string,"
    "kind:string,created:string,updated:string,anchor:struct<unit:string,section:string,lang:string,level:int,tokens:array<int>,"
    "sents:array<int>,quote:struct<exact:string,prefix:string,suffix:string>,on:string>,text:string,thread:array<struct<q:string,"
    "a:string,takeaway:string,cites:array<string>,model:string,lang:string,at:string>>,ask:struct<q:string,a:string,takeaway:string,"
    "cites:array<string>,model:string,lang:string,at:string>>>, _bad string"
)


def read_notes(spark: SparkSession, path: str, formats: list[str]) -> DataFrame:
    """doc_id, note_id, kind, created, updated, anchor, text, thread of the notes files below a folder.

    formats: the format names that are read. A file is a document of notes, or an array of such. A note's single question of older files is
    a thread of one turn; files that cannot be read, and documents of another format, are skipped.
    """
    raw = spark.read.schema(NOTE_SCHEMA).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    files = raw.where(F.col("_bad").isNull() & F.col("format").isin(*formats))
    n = files.select(F.col("paper.id").alias("doc_id"), F.explode("notes").alias("n"))
    thread = F.when(F.size("n.thread") > 0, F.col("n.thread")).when(F.col("n.ask").isNotNull(), F.array("n.ask")).otherwise(F.array().cast(n.schema["n"].dataType["thread"].dataType))
    return n.select("doc_id", F.col("n.id").alias("note_id"), "n.kind", F.to_timestamp("n.created").alias("created"), F.to_timestamp("n.updated").alias("updated"), "n.anchor", "n.text", thread.alias("thread"))


def read_bibliography(items: DataFrame, column: str = "json") -> DataFrame:
    """key, title, authors, year, citekey, arxiv: a reference manager's items (JSON, one a row), attachments and notes off."""
    get = lambda p, t="string": F.try_variant_get("v", p, t)
    v = items.withColumn("v", F.try_parse_json(column)).where(~F.coalesce(get("$.data.itemType"), F.lit("")).isin("attachment", "note", "annotation"))
    people = get("$.data.creators", "array<struct<creatorType:string,firstName:string,lastName:string,name:string>>")
    authors = F.transform(F.filter(people, lambda c: c["creatorType"].isNull() | (c["creatorType"] == "author")), lambda c: F.coalesce(c["name"], F.concat_ws(", ", c["lastName"], c["firstName"])))
    extra = F.coalesce(get("$.data.extra"), F.lit(""))
    arxiv = r"(?i)(?:arxiv(?:\.org)?[:./ ]*(?:abs/|pdf/)?|10\.48550/arxiv\.)(\d{4}\.\d{4,5})"
    fields = [F.nullif(F.regexp_extract(F.coalesce(get(f"$.data.{f}"), F.lit("")), arxiv, 1), F.lit("")) for f in ("url", "DOI", "extra", "archiveID", "reportNumber")]
    repo = F.when(F.lower(F.coalesce(get("$.data.repository"), F.lit(""))) == "arxiv", F.nullif(F.regexp_extract(F.coalesce(get("$.data.archiveID"), F.lit("")), r"(\d{4}\.\d{4,5})", 1), F.lit("")))
    year = F.substring(F.coalesce(get("$.meta.parsedDate"), get("$.data.date"), F.lit("")), 1, 4)
    cite = F.coalesce(F.nullif(get("$.data.citationKey"), F.lit("")), F.nullif(F.regexp_extract(extra, r"(?m)^Citation Key:[ \t]*(\S+)", 1), F.lit("")))
    return v.select(get("$.key").alias("key"), get("$.data.title").alias("title"), authors.alias("authors"), year.alias("year"), cite.alias("citekey"), F.coalesce(*fields, repo).alias("arxiv"))


class _ArticleMeta:
    """What an article's JATS XML says of it, gathered while it is parsed once: the strings of the elements that were asked for."""

    DATE = ("year", "month", "day")
    NAME = ("given-names", "surname")
    ASKED = frozenset(("article-meta", "article-title", "article-id", "contrib", "name", "pub-date", *DATE, *NAME))

    def __init__(self) -> None:
        self.above: list[str] = []
        self.metas = 0  # open article-meta elements
        self.author = 0  # depth of an author's contrib that is open, 0 for none
        self.held: list[tuple[int, list[str], bool]] = []  # (depth, text so far, text of the element alone)
        self.title: list[str] | None = None
        self.doi: list[str] | None = None
        self.names: list[dict[str, list[str]]] = []
        self.dates = 0
        self.date: dict[str, list[str]] = {}

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        self.above.append(tag)
        if tag in self.ASKED and (self.metas or tag == "article-meta"):
            self.enter(tag, attrs, len(self.above), self.above[-2] if len(self.above) > 1 else "")

    def enter(self, tag: str, attrs: dict[str, str], depth: int, up: str) -> None:
        text: list[str] | None = None
        if tag == "article-meta":
            self.metas += 1
        elif tag == "article-title" and self.title is None:
            text = self.title = []
        elif tag == "article-id" and up == "article-meta" and self.doi is None and attrs.get("pub-id-type") == "doi":
            text = self.doi = []
        elif tag == "contrib" and attrs.get("contrib-type") == "author":
            self.author = depth
        elif tag == "name" and self.author and depth == self.author + 1:
            self.names.append({})
        elif tag in self.NAME and up == "name" and self.author and depth == self.author + 2 and tag not in self.names[-1]:
            text = self.names[-1][tag] = []
        elif tag == "pub-date" and up == "article-meta":
            self.dates += 1
        elif tag in self.DATE and self.dates == 1 and self.above[-3:-1] == ["article-meta", "pub-date"] and tag not in self.date:
            text = self.date[tag] = []
        if text is not None:
            self.held.append((depth, text, tag in self.NAME))
            self.parser.CharacterDataHandler = self.data

    def data(self, text: str) -> None:
        for depth, held, alone in self.held:
            if not alone or depth == len(self.above):
                held.append(text)

    def end(self, tag: str) -> None:
        if tag in self.ASKED:
            depth = len(self.above)
            if self.held and self.held[-1][0] == depth:
                self.held.pop()
                if not self.held:
                    self.parser.CharacterDataHandler = None
            if self.author == depth:
                self.author = 0
            if tag == "article-meta":
                self.metas -= 1
        self.above.pop()

    def read(self, xml: str) -> dict:
        parser = self.parser = expat.ParserCreate()
        parser.StartElementHandler, parser.EndElementHandler, parser.buffer_text = self.start, self.end, True
        parser.Parse(xml, True)
        del self.parser  # it holds this object
        whole = lambda x: "".join(x or ())
        names = [" ".join(filter(None, (whole(n.get("given-names")), whole(n.get("surname"))))) for n in self.names]
        return {"title": whole(self.title), "authors": [n for n in names if n], "doi": whole(self.doi), **{p: whole(self.date.get(p)) for p in self.DATE}}


def read_jats_meta(articles: DataFrame, column: str = "xml") -> DataFrame:
    """articles with title, authors, doi, date (zero-padded), license (a CC link) from JATS XML.

    Each article is parsed once; an XPath expression would parse it again for each value. An author is the given names and the surname
    of one name, so one who has only a surname takes nobody else's given names. XML that is not well formed is an error.
    """
    fields = ("title", "authors", "doi", *_ArticleMeta.DATE)

    @F.arrow_udf(", ".join(f"{n} {'array<string>' if n == 'authors' else 'string'}" for n in fields))
    def article_meta(xml: pa.Array) -> pa.Array:
        kind = pa.struct([(n, pa.list_(pa.string()) if n == "authors" else pa.string()) for n in fields])
        return pa.array((_ArticleMeta().read(x.as_py()) if x.is_valid else None for x in xml), kind)

    bare = F.regexp_replace(column, r"(?s)<!DOCTYPE.*?>|\A\s*<\?xml\s.*?\?>", "")
    day = [F.lpad(F.col(f"_meta.{p}"), n, "0") for p, n in zip(_ArticleMeta.DATE, (4, 2, 2))]
    date = F.array_join(F.filter(F.array(*[F.nullif(F.nullif(p, F.lit("00")), F.lit("0000")) for p in day]), lambda p: p.isNotNull()), "-")
    lic = F.regexp_extract(column, r"(https?://creativecommons\.org/[^\"'<\s]+)", 1)
    made = articles.withColumn("_meta", article_meta(bare))
    return made.select(*articles.columns, F.trim("_meta.title").alias("title"), F.col("_meta.authors").alias("authors"), F.col("_meta.doi").alias("doi"), date.alias("date"), lic.alias("license"))


def read_page_markdown(pages: DataFrame) -> DataFrame:
    """doc_id, page, block, kind, level, text: (doc_id, page, markdown) rows as typed blocks."""
    from ..operators.turns import markdown_blocks

    return markdown_blocks(pages, ["doc_id", "page"], "markdown")


def stream_docs(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet") -> DataFrame:
    """Arriving documents as a stream."""
    return spark.readStream.format(kind).schema(schema).load(path)
