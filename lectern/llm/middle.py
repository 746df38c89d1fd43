"""Fill-in-the-middle: documents are cut at two token boundaries and their parts are put in another order.

A text's token boundaries are a sorted set of code-point offsets, held in the Roaring way: one container for each 65,536
offsets, an array, a bitmap or runs, whichever is smallest, with the cardinalities of the containers added up. The k-th
boundary is found by a search over these sums and a select inside one container. Parts are cut, joined and put back by
expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Offsets that one container covers.
SPAN = 1 << 16
#: Bytes of a bitmap container.
BITMAP_BYTES = SPAN // 8
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class ArrayContainer:
    """Few members: their low halves, sorted."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """Many members: a bit for each offset, and how many bits are set before each 64-bit word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(SPAN, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words)
        self.before = np.cumsum(counts, dtype=np.int64) - counts

    def select(self, k: int) -> int:
        w = int(np.searchsorted(self.before, k, side="right")) - 1
        bits = np.unpackbits(self.words[w : w + 1].view(np.uint8), bitorder="little")
        return 64 * w + int(np.flatnonzero(bits)[k - self.before[w]])


class RunContainer:
    """Members in runs of neighbours: where each run starts, and how many members stand before it."""

    def __init__(self, low: np.ndarray, starts: np.ndarray):
        self.starts = low[starts].astype(np.uint16)
        self.before = starts

    def select(self, k: int) -> int:
        r = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[r]) + k - int(self.before[r])


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container for the sorted low halves of some offsets."""
    starts = np.flatnonzero(np.diff(low, prepend=-2) != 1)
    if 4 * len(starts) < min(2 * len(low), BITMAP_BYTES):
        return RunContainer(low, starts)
    return ArrayContainer(low) if 2 * len(low) <= BITMAP_BYTES else BitmapContainer(low)


class BoundarySet:
    """The offsets at which tokens of `[A-Za-z]+|[^A-Za-z]` begin, and the text's end: one more than it has tokens."""

    def __init__(self, text: str):
        end, self.keys, self.containers, sums = len(text), [], [], []
        for lo in range(0, end + 1, SPAN):
            hi = min(lo + SPAN, end + 1)
            points = np.frombuffer(text[max(lo - 1, 0) : hi].encode("utf-32-le", "surrogatepass"), np.uint32)
            letter = np.zeros(hi - lo + 1, bool)  # of the code points lo - 1 to hi - 1; outside the text there is none
            first = 0 if lo else 1
            letter[first : first + len(points)] = (points | 32) - np.uint32(97) < 26
            low = np.flatnonzero(~(letter[:-1] & letter[1:]))
            if len(low):
                self.keys.append(lo)
                self.containers.append(container(low))
                sums.append(len(low))
        self.cumulative = np.cumsum(sums)

    def __len__(self) -> int:
        return int(self.cumulative[-1])

    def select(self, k: int) -> int:
        """The k-th offset, from 0."""
        c = int(np.searchsorted(self.cumulative, k, side="right"))
        return self.keys[c] + self.containers[c].select(k - int(self.cumulative[c - 1] if c else 0))


@F.pandas_udf(StructType([StructField(name, LongType()) for name in ("n", "first", "second")]))
def _cuts(text: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
    rows = []
    for t, a, b in zip(text, h1.tolist(), h2.tolist()):
        marks = BoundarySet(t)
        a, b = a % len(marks), b % len(marks)
        rows.append((len(marks) - 1, marks.select(min(a, b)), marks.select(max(a, b))))
    return pd.DataFrame(rows, columns=["n", "first", "second"])


def restored(output: Column, form: Column) -> Column:
    """The text from which fill_in_middle made output.

    A text that holds a control string is plain, and no control string can begin in one part and end in the next, so the
    marks cut the output in just one way.
    """
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fill_in_middle(docs: DataFrame, seed: str = "1", rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) per row of docs, over whole texts.

    n is the number of tokens. Four random numbers are read from the SHA-256 of `seed:doc_id`; two of them, modulo n + 1, are
    the tokens after which the prefix and the middle end. Of 100 texts `rate` are cut, `spm_rate` of 100 of those suffix first;
    empty texts, and texts that hold a control string, are plain: the output is the text, prefix_chars and middle_chars are
    null. Null texts count as empty. A null doc_id is hashed as an empty string, repeated rows come out alike, further
    columns are ignored whatever their names, and an empty table gives no rows. A text is read 65,536 code points at a time.
    """
    doc_id, text = F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    cut = docs.select(doc_id, text, *drawn).withColumn("cut", _cuts("text", "h1", "h2"))
    held = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | held | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    first, second = F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    prefix, middle = F.substring("text", F.lit(1), first), F.substring("text", first + 1, second - first)
    suffix = F.substring("text", second + 1, F.length("text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return cut.withColumn("form", form).select(
        "doc_id",
        F.col("cut.n").alias("n"),
        "form",
        F.when(F.col("form") != "plain", F.col("cut.first")).alias("prefix_chars"),
        F.when(F.col("form") != "plain", F.col("cut.second") - F.col("cut.first")).alias("middle_chars"),
        F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm).alias("output"),
    )
