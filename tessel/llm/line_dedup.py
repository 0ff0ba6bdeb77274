"""Removal of lines and passages that repeat, by hashing their units.

A unit is a line, or a stretch of one between sentence ends and words that
begin with a capital; where units begin depends on the text at that place only,
so equal passages fall into equal units wherever they stand.  A unit is
normalised (ASCII lower case, white space and outer punctuation dropped) and
hashed.  One of fewer than ``unit_words`` different words says little, so it is
hashed together with its neighbours in the line, or as a part of the whole line.
Digests are grouped globally, the first occurrence by (id, row, position) stays,
and later ones go.  Those that overlap or follow each other make a span; any
unit that isn't repeated breaks it, whatever its length.

``span_words`` is the least number of words of a span that goes (1: every
repeated line goes); with ``across``, only what an earlier row holds is a repeat,
not what a text says twice.

Defined results: null and empty texts have no units; what has no word goes only
between repeated units; every row is a document of its own, and rows with the
same id rank as they stand in the table's partitions; null ids rank last; texts
are taken whole, in time that grows with their length; an empty table gives an
empty result.  Offsets are code points of the original text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed_text, map_slices, stored, without_spans

BOUNDARY = re.compile(r"(?<=[.!?])\s+|\n+|\s+(?=[A-ZÀ-ÖØ-Þ][^\sA-ZÀ-ÖØ-Þ])")
WORD = re.compile(r"\w")
OUTER = " \t\r\n.,;:!?\"'"
LOWER = {c: c + 32 for c in range(65, 91)}

#: Different words that a unit needs to be hashed without its neighbours.
UNIT_WORDS = 5
#: Digests of several units are polynomials of theirs, modulo a prime.
PRIME, BASE = (1 << 61) - 1, 0x1F3D5B79A8C6E421 % ((1 << 61) - 1)


def lines(text: str) -> Iterator[list[tuple[int, int, list[str]]]]:
    """``(start, end, words)`` of the units of each line."""
    line, begin = [], 0
    for end, after in [*((m.start(), m.end()) for m in BOUNDARY.finditer(text)), (len(text), len(text))]:
        words = text[begin:end].translate(LOWER).split()
        if words:
            line.append((begin, end, words))
        if line and (after == len(text) or "\n" in text[end:after]):
            yield line
            line = []
        begin = after


def digest(words: list[str]) -> int:
    joined = " ".join(words)
    return xxhash.xxh64_intdigest(joined.strip(OUTER) or joined)


def passages(line: list[tuple[int, int, list[str]]], unit_words: int) -> list[tuple[int, int]]:
    """Of each unit of a line the shortest range from it on that has ``unit_words`` different words; at the line's end, the shortest that ends there."""
    out, held, j = [], Counter(), 0
    for k in range(len(line)):
        while j < len(line) and len(held) < unit_words:
            held.update(line[j][2])
            j += 1
        if len(held) < unit_words:
            break
        out.append((k, j))
        for w in line[k][2]:
            held[w] -= 1
            if not held[w]:
                del held[w]
    if len(out) < len(line):
        i = len(out)  # the units from here on lack words, so those before are taken in
        while i and len(held) < unit_words:
            i -= 1
            held.update(line[i][2])
        if (i, len(line)) not in out[i : i + 1]:
            out.append((i, len(line)))
    return out


def marks(text: str, unit_words: int = UNIT_WORDS) -> list[tuple[int, int, int, int, int, int, int]]:
    """``(no, last, start, end, words, upto, digest)`` of each passage: numbers of its first and last unit, its place, its words and those of the text up to its end."""
    out, no, upto = [], 0, 0
    for line in lines(text):
        sums, ends = [upto], [0]
        for *_, words in line:
            # what is only punctuation has no words
            sums.append(sums[-1] + (len(words) if any(map(WORD.search, words)) else 0))
            ends.append((ends[-1] * BASE + digest(words)) % PRIME)
        for i, j in passages(line, unit_words):
            value = digest(line[i][2]) if j == i + 1 else (ends[j] - ends[i] * pow(BASE, j - i, PRIME)) % PRIME
            out.append((no + i, no + j - 1, line[i][0], line[j - 1][1], sums[j] - sums[i], sums[j], value))
        no, upto = no + len(line), sums[-1]
    return out


def two(high: int, low: int) -> int:
    """Two numbers of 32 bits in one."""
    return high << 32 | low


def hashed(rows: DataFrame, unit_words: int) -> DataFrame:
    """``__row``, ``__id``, ``digest`` and, two in one number each, ``units`` (first, last), ``place`` (start, end) and ``words`` (up to the end, own) of each passage of ``__row``, ``__id``, ``__text``."""
    kind = rows.schema["__id"].dataType.simpleString()

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        owner, found = [], []
        for i, text in enumerate(piece.column("__text").to_pylist()):
            own = marks(text or "", unit_words)
            owner += [i] * len(own)
            found += [(value, two(no, last), two(start, end), two(upto, words)) for no, last, start, end, words, upto, value in own]
        cols = np.array(found, np.uint64).reshape(-1, 4).T.astype(np.int64)
        keys = [piece.column(k).take(pa.array(owner, pa.int32())) for k in ("__row", "__id")]
        return pa.RecordBatch.from_arrays([*keys, *map(pa.array, cols)], ["__row", "__id", "digest", "units", "place", "words"])

    return map_slices(rows, run, f"__row bigint, __id {kind}, digest bigint, units bigint, place bigint, words bigint")


def high(name: str) -> Column:
    return F.shiftright(name, 32).cast("int")


def low(name: str) -> Column:
    return F.col(name).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def spans_of_rows(rows: DataFrame, unit_words: int = UNIT_WORDS, span_words: int = 1, across: bool = False) -> DataFrame:
    """``__row`` and the columns of ``repeated_spans`` for ``__row``, ``__id``, ``__text``; the key of a row is kept with its passages."""
    rows = stored(hashed(rows, unit_words))
    order = F.struct(F.col("__id").isNull().alias("null"), F.col("__id").alias("id"), F.col("__row").alias("row"), F.col("units"))
    # kept apart from the join, so that the places of one very common passage can be dealt over several tasks
    several = F.min("__row") != F.max("__row") if across else F.count(F.lit(1)) > 1
    firsts = stored(rows.groupBy("digest").agg(F.min(order).alias("first"), several.alias("several")).filter("several").select("digest", "first"))
    later = F.col("__row") != F.col("first.row")
    if not across:
        later = later | (high("units") > low("first.units"))
    again = rows.join(firsts, "digest").filter(later).select(
        "__row", "__id", high("units").alias("no"), low("units").alias("last"), high("place").alias("start"), low("place").alias("end"), low("words").alias("words"), high("words").alias("upto"), "first"
    )
    # ranges of units that overlap or follow each other make a run
    before = Window.partitionBy("__row").orderBy("no", "last")
    begins = F.col("no") > F.coalesce(F.max("last").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-2)) + 1
    runs = again.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(before))
    spans = runs.groupBy("__row", "run").agg(
        F.first("__id").alias("__id"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        (F.max("upto") - F.min(F.col("upto") - F.col("words"))).alias("n_words"),
        (F.max("last") - F.min("no") + 1).alias("n_units"),
        F.min(F.struct("no", "first")).alias("at"),
    )
    return spans.filter(F.col("n_words") >= span_words).select("__row", "__id", F.col("at.no").alias("span"), "start", "end", "n_words", "n_units", F.col("at.first.id").alias("first_id"))


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int | bool) -> DataFrame:
    """``__id``, ``span``, ``start``, ``end``, ``n_words``, ``n_units``, ``first_id``: what to remove, and where its first unit stays."""
    return spans_of_rows(keyed_text(df, id_col, text_col).withColumn("__row", F.monotonically_increasing_id()), **how).drop("__row")


def remove_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int | bool) -> DataFrame:
    """``df`` with the repeated spans cut out of its texts; every row stays."""
    # written out with its keys, which would not be the same each time
    rows = stored(df.select(F.monotonically_increasing_id().alias("__row"), F.struct("*").alias("row")))
    text = F.col(f"row.`{text_col}`")
    keyed = rows.select("__row", F.col(f"row.`{id_col}`").alias("__id"), text.alias("__text"))
    cuts = spans_of_rows(keyed, **how).groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    left = F.when(F.col("cuts").isNull(), text).otherwise(without_spans(text, F.col("cuts"), ""))
    return rows.join(cuts, "__row", "left").select(F.col("row").withField(f"`{text_col}`", left).alias("row")).select("row.*")
