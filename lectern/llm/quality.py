"""Quality rules as a short-circuit cascade, ordered by rejections per unit of cost measured on a sample."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows on which costs and selectivities are estimated, drawn by hash from all files. They decide the order of the rules
#: only, never a verdict.
SAMPLE_ROWS = 400
_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_LETTERS = bytes(c for c in range(128) if chr(c).isalpha())
_NOT_ASCII = re.compile("[^\x00-\x7f]+")


def once(count: Callable[[Doc], int]) -> Callable[[Doc], int]:
    """A count of a Doc that is made when first asked for and then kept, as rules ask again for what the base has counted."""

    def kept(doc: Doc) -> int:
        if count.__name__ not in doc.counts:
            doc.counts[count.__name__] = count(doc)
        return doc.counts[count.__name__]

    return kept


class Doc:
    """A text with what rules ask for, computed when first asked. Work is on UTF-8, where white space is one byte."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.data = self.text.encode("utf-8", "surrogatepass")
        self.counts: dict[str, int] = {}
        self._words: list[bytes] | None = None

    @property
    def words(self) -> list[bytes]:
        if self._words is None:
            self._words = self.data.split()
        return self._words

    def without(self, chars: bytes) -> int:
        """Bytes that are none of chars."""
        return len(self.data.translate(None, chars))

    @once
    def word_chars(self) -> int:
        """Code points that are not white space."""
        return len(self.text) - (len(self.data) - self.without(_SPACES))

    @once
    def letters(self) -> int:
        """Code points that are letters."""
        n = len(self.data) - self.without(_LETTERS)
        return n if self.text.isascii() else n + sum(map(str.isalpha, "".join(_NOT_ASCII.findall(self.text))))

    @once
    def symbols(self) -> int:
        return len(self.data) - self.without(_SYMBOLS)

    @once
    def dup_lines(self) -> int:
        """Lines with a word that equal an earlier line."""
        lines = [x for x in self.data.split(b"\n") if x and not x.isspace()]
        return len(lines) - len(set(lines))

    def base(self) -> tuple[int, int, int, int, int]:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
        return len(self.words), self.word_chars(), self.symbols(), self.dup_lines(), repeated_words(self.words)


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more in the text."""
    n = len(words)
    ids = {w: k for k, w in enumerate(set(words))}
    v = len(ids)
    if n < 4 or v == n:
        return 0
    x = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    pair = x[:-1] * v + x[1:]
    if v >= 1 << 20:  # three numbers would not fit in 63 bits
        _, pair = np.unique(pair, return_inverse=True)
    key = pair[:-1] * v + x[2:]
    ordered = np.sort(key)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    at = np.flatnonzero(np.isin(key, np.unique(again)))
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    """name, and a test that says whether a text fails."""

    name: str
    fails: Callable[[Doc], bool]


def _mean_length(d: Doc) -> bool:
    return bool(d.words) and not 2.0 <= d.word_chars() / len(d.words) <= 20.0


def _symbols(d: Doc) -> bool:
    return d.symbols() > 0.2 * len(d.words)


def _dup_lines(d: Doc) -> bool:
    return d.dup_lines() > 0.5 * (d.data.count(b"\n") + 1)


def _capitals(d: Doc) -> bool:
    return sum(map(bytes.isupper, d.words)) > 0.5 * len(d.words)


def _letters(d: Doc) -> bool:
    return d.letters() < 0.5 * d.word_chars()


RULES = (
    Rule("mean_word_length", _mean_length),
    Rule("symbol_share", _symbols),
    Rule("duplicate_lines", _dup_lines),
    Rule("capital_words", _capitals),
    Rule("letter_share", _letters),
)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def best_order(rejected: np.ndarray, seconds: np.ndarray, names: list[str]) -> list[int]:
    """Rules by rejections per second, each counted on the texts that the rules before it let through.

    rejected, seconds: one row a rule, one column a text. At each step the best rule is taken; with no rejection left, the
    cheaper; ties by name.
    """
    left, order = np.ones(rejected.shape[1], bool), []
    while len(order) < len(names):
        rest = [k for k in range(len(names)) if k not in order]
        cost = {k: max(float(seconds[k, left].sum()), 1e-12) for k in rest}
        best = min(rest, key=lambda k: (-float(rejected[k, left].sum()) / cost[k], cost[k], names[k]))
        order.append(best)
        left &= ~rejected[best]
    return order


def cascade_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in the order that best_order() finds on a sample of at most sample_rows rows of all files.

    A rule is tried, in a Spark task, on each text that passes the base rules, with the base counts at hand as they are
    when documents are judged, so it is charged for its own work only. An empty sample keeps the given order.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for text in (t.as_py() for b in batches for t in b.column(0)):
            doc = Doc(text)
            counts = doc.base()
            if base_failed(counts[0], counts[4]):
                continue
            row = []
            for rule in rules:
                start = time.perf_counter()
                failed = rule.fails(doc)
                row.append((failed, time.perf_counter() - start))
            found.append(row)
        table = np.array(found, float).reshape(len(found), len(rules), 2)
        order = best_order(table[:, :, 0].T > 0, table[:, :, 1].T, [r.name for r in rules]) if found else range(len(rules))
        yield pa.RecordBatch.from_arrays([pa.array([list(order)], pa.list_(pa.int32()))], ["places"])

    chosen = F.xxhash64("doc_id")
    part = F.pmod(chosen, F.lit(max(1, docs.count() // sample_rows))) == 0
    sample = docs.select("text").where(part).orderBy(chosen).limit(sample_rows)
    measured = sample.coalesce(1).mapInArrow(measure, "places array<int>").collect()
    return [rules[k] for row in measured[:1] for k in row.places] or list(rules)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of docs the given columns, the base counts, base_failed, kept and the rule that ended the cascade.

    A row that fails the base rules is rejected at once. Others go through the rules in the order of cascade_order()
    and stop at the first they fail; the verdict is the same in any order. Null texts are empty texts: no word, so
    rejected. Whole texts are read. Repeated rows are judged one by one; further columns of docs are ignored; an empty table gives
    no rows.
    """
    order = cascade_order(docs, rules)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, failed, kept, ended = [], [], [], []
            for text in batch.column(batch.num_columns - 1):
                doc = Doc(text.as_py())
                counts = doc.base()
                bad = base_failed(counts[0], counts[4])
                stop = "base" if bad else next((r.name for r in order if r.fails(doc)), None)
                base.append(counts)
                failed.append(bad)
                kept.append(stop is None)
                ended.append(stop)
            cols = [pa.array(c, pa.int64()) for c in zip(*base)] if base else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(batch.num_columns - 1)), *cols, pa.array(failed, pa.bool_()),
                 pa.array(kept, pa.bool_()), pa.array(ended, pa.string())],
                [*columns, *names, "base_failed", "kept", "failed_rule"],
            )

    given = docs.select(*columns)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)
    schema = f"{fields}, {', '.join(f'{n} long' for n in names)}, base_failed boolean, kept boolean, failed_rule string"
    return docs.select(*columns, "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass the base rules and every rule; all columns stay as they are."""
    order = cascade_order(docs, rules)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for text in batch.column(at):
                doc = Doc(text.as_py())
                ok = len(doc.words) >= 50 and not base_failed(len(doc.words), repeated_words(doc.words))
                keep.append(ok and not any(r.fails(doc) for r in order))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
