"""Benchmark decontamination by the q-gram lemma.

A benchmark item of n characters that stands in a text with at most e edits
keeps ``n - q + 1 - q * e`` of its q-grams, on diagonals that spread over at
most e.  Shared q-grams are counted in bands of diagonals that overlap by half,
so one band holds any such occurrence; bands with enough of them are verified
by an alignment confined to the band.

q-grams that an item repeats more than ``REPEATS`` times would meet a monotonous
text at too many diagonals, so they aren't counted; the bound is less by as many.
Items for which no bound is left are looked for where a stretch of text of their
length holds enough of their q-grams, whatever the diagonal, and verified there.
Shared q-grams are met ``PAIRS`` at a time and texts ``WINDOW`` characters at a time,
so memory is bounded.

Different texts of the benchmark go to the executors in blocks of bounded size,
each of which meets all texts, so a large benchmark costs passes and not memory.

Defined results: texts are compared with ASCII letters in lower case and runs of
white space as one blank, none at the ends; offsets are code points of the text as
it is.  Null and empty texts hold nothing, null and blank items stand nowhere; an
item of fewer than ``q`` characters counts where it stands as it is, between
characters that are no letters or digits.  Of occurrences of one item that overlap
the one with the fewest edits counts, of equals the first; repeated items and rows
are reported each; an empty table on either side gives an empty result.  Only the
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce
from typing import Any

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_row, keyed_text, map_slices, stored, without_ids

Q = 10
#: Edits allowed, as a share of an item's characters.
EDIT_SHARE = 0.08
#: Characters of benchmark that one pass broadcasts.
BLOCK_CHARS = 2 << 20
#: Places of one q-gram in one item beyond which they aren't counted by diagonal.
REPEATS = 8
#: Shared q-grams that are expanded at a time.
PAIRS = 1 << 20
#: Characters of text that are looked at at a time.
WINDOW = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x100000001B3


def characters(text: str) -> np.ndarray:
    """Code points as they are compared: ASCII letters in lower case, runs of white space as one blank."""
    a = np.frombuffer(" ".join(text.split()).encode("utf-32-le", "surrogatepass"), "<u4").copy()
    a[(a >= 65) & (a <= 90)] += 32
    return a


@cache
def blank_table() -> np.ndarray:
    return np.array([chr(c).isspace() for c in range(0x110000)])


def places(text: str) -> np.ndarray:
    """Where in the text each of its ``characters`` stands."""
    blank = blank_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    kept = ~blank
    kept[1:] |= ~blank[:-1]  # the first of a run
    solid = np.flatnonzero(~blank)
    kept[solid[-1] + 1 if len(solid) else 0 :] = False
    return np.flatnonzero(kept)


def as_text(a: np.ndarray) -> str:
    return a.tobytes().decode("utf-32-le", "surrogatepass")


def qgrams(a: np.ndarray, q: int) -> np.ndarray:
    """A hash of each run of q characters, put together from runs of powers of two."""
    n = len(a) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    run, width, out, done = a.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if q & width:
            piece = run[done : done + n]
            out = piece.copy() if out is None else out * np.uint64(pow(BASE, width, 1 << 64)) + piece
            done += width
        if done == q:
            return out * MIX
        run = run[: len(run) - width] * np.uint64(pow(BASE, width, 1 << 64)) + run[width:]
        width *= 2


@dataclass
class Index:
    """q-grams of a block of items: sorted keys, and for each key its places."""

    ids: list[Any]
    texts: list[np.ndarray]
    budget: np.ndarray
    need: np.ndarray
    keys: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    place: np.ndarray
    bloom: np.ndarray
    monotonous: dict[int, np.ndarray]
    short: ahocorasick.Automaton | None
    longest: int
    q: int

    @staticmethod
    def of(items: list[tuple[Any, str]], q: int, share: float) -> Index | None:
        made = [(i, a) for i, t in items if t is not None and len(a := characters(t))]
        if not made:
            return None
        made.sort(key=lambda x: len(x[1]) < q)  # the short ones last
        ids, texts = [i for i, _ in made], [a for _, a in made]
        n = np.array([len(t) for t in texts])
        long = int((n >= q).sum())
        budget = np.where(n >= q, np.minimum((share * n).astype(np.int64), (n - q) // q), 0)
        need = np.where(n >= q, n - q + 1 - q * budget, 0)
        hashes = [qgrams(t, q) for t in texts[:long]]
        all_keys = np.concatenate([np.zeros(0, np.uint64), *hashes])
        item = np.repeat(np.arange(long, dtype=np.int32), [len(h) for h in hashes])
        place = np.concatenate([np.zeros(0, np.int32), *(np.arange(len(h), dtype=np.int32) for h in hashes)])
        order = np.lexsort((place, item, all_keys))
        all_keys, item, place = all_keys[order], item[order], place[order]
        keys, which = np.unique(all_keys, return_inverse=True)
        # of each (key, item) how often it stands there
        fresh = np.ones(len(all_keys), bool)
        fresh[1:] = (all_keys[1:] != all_keys[:-1]) | (item[1:] != item[:-1])
        group = np.cumsum(fresh) - 1
        often = np.bincount(group)[group] > REPEATS if len(group) else np.zeros(0, bool)
        need = need - np.bincount(item[often], minlength=len(n))
        monotonous = {int(i): np.unique(which[item == i]) for i in np.flatnonzero((need <= 0) & (n >= q))}
        counted = ~often & (need[item] > 0)
        starts = np.concatenate([[0], np.cumsum(np.bincount(which[counted], minlength=len(keys)))])
        bloom = np.zeros(1 << 22, bool)
        bloom[(keys >> np.uint64(42)).astype(np.int64)] = True
        short = ahocorasick.Automaton() if long < len(texts) else None
        if short is not None:
            same: dict[str, list[int]] = {}
            for k in range(long, len(texts)):
                same.setdefault(as_text(texts[k]), []).append(k)
            for word, own in same.items():
                short.add_word(word, own)
            short.make_automaton()
        return Index(ids, texts, budget, need, keys, starts, item[counted], place[counted], bloom, monotonous, short, int(n.max()), q)


def alignments(item: np.ndarray, text: np.ndarray, low: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits between the item and a stretch of text that ends on each of the diagonals low .. low+width-1, confined to them, with its start and end."""
    n, idx = len(item), np.arange(width)
    at = low + idx
    padded = np.full(n + width, -1, np.int64)
    a, b = max(0, low), min(len(text), low + n + width)
    if a < b:
        padded[a - low : b - low] = text[a:b]
    cost, begin = np.zeros(width, np.int64), np.clip(at, 0, len(text))
    for i in range(n):
        step = cost + (padded[i : i + width] != item[i])
        up = np.append(cost[1:] + 1, np.iinfo(np.int64).max // 2)
        from_up = up < step
        step = np.where(from_up, up, step)
        origin = np.where(from_up, np.append(begin[1:], 0), begin)
        flat = step - idx
        least = np.minimum.accumulate(flat)
        pick = np.maximum.accumulate(np.where(flat == least, idx, 0))
        cost, begin = least + idx, origin[pick]
    return cost, begin, np.minimum(len(text), low + n + idx)


def banded(item: np.ndarray, text: np.ndarray, low: int, width: int) -> tuple[int, int, int]:
    """Least edits between the item and a stretch of text within a band, with its start and end."""
    cost, begin, end = alignments(item, text, low, width)
    k = int(np.argmin(cost))
    return int(cost[k]), int(begin[k]), int(end[k])


def verbatim(target: str, text: str, begin: int = 0) -> Iterator[int]:
    """Where the target stands, from left to right without overlaps."""
    at = text.find(target, begin)
    while at >= 0:
        yield at
        at = text.find(target, at + len(target))


def bands(where: np.ndarray, k: np.ndarray, begins: np.ndarray, index: Index) -> np.ndarray:
    """``(text, item, band)`` with enough shared q-grams, from places in the buffer and keys that stand there."""
    many = index.starts[k + 1] - index.starts[k]
    upto = np.cumsum(many)
    open_rows, open_count = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    out, a = [open_rows], 0
    while a < len(where):
        # as many places as make PAIRS, and one at least
        z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, side="right")))
        own = many[a:z]
        flat = np.repeat(index.starts[k[a:z]] - np.concatenate([[0], np.cumsum(own)[:-1]]), own) + np.arange(own.sum())
        spot, item = np.repeat(where[a:z], own), index.item[flat].astype(np.int64)
        doc = np.searchsorted(begins, spot, side="right") - 1
        band = (spot - begins[doc] - index.place[flat]) // (index.budget[item] + 1)
        rows = np.concatenate([np.stack([doc, item, band], 1), np.stack([doc, item, band - 1], 1)])
        if len(rows):
            rows, count = unique_rows(rows)
            rows, count = added(np.concatenate([open_rows, rows]), np.concatenate([open_count, count]))
            # a band is done when its last character is behind
            step = index.budget[rows[:, 1]] + 1
            ends = begins[rows[:, 0]] + (rows[:, 2] + 2) * step + np.array([len(t) for t in index.texts])[rows[:, 1]]
            going = ends >= where[z - 1] if z < len(where) else np.zeros(len(rows), bool)
            out.append(rows[~going & (count >= index.need[rows[:, 1]])])
            open_rows, open_count = rows[going], count[going]
        a = z
    out.append(open_rows[open_count >= index.need[open_rows[:, 1]]])
    return np.concatenate(out)


def added(rows: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows with the sums of their counts."""
    order = np.lexsort(rows.T[::-1])
    rows, count = rows[order], count[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]).any(1)
    return rows[fresh], np.add.reduceat(count, np.flatnonzero(fresh))


def dense(item: int, spots: np.ndarray, text: np.ndarray, index: Index) -> list[tuple[int, int, int]]:
    """``(edits, start, end)`` of a monotonous item, from the sorted places of its q-grams in a text."""
    target, e = index.texts[item], int(index.budget[item])
    n = len(target)
    need = n - index.q + 1 - index.q * e
    if len(spots) < need:
        return []
    first, last = spots[: len(spots) - need + 1], spots[need - 1 :]
    near = last - first <= n + e - index.q
    begin, end = np.maximum(0, last[near] + index.q - n - e), np.minimum(len(text), first[near] + n + e)
    # an edit takes away one character at most, so nearly all that differ from the item's commonest must be there
    kinds, count = np.unique(target, return_counts=True)
    other = np.concatenate([[0], np.cumsum(text != kinds[np.argmax(count)])])
    enough = other[end] - other[begin] >= n - int(count.max()) - e
    begin, end = begin[enough], end[enough]
    if not len(begin):
        return []
    # stretches that overlap make one
    cuts = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
    out = []
    for a, z in zip(begin[cuts].tolist(), end[np.append(cuts[1:] - 1, len(end) - 1)].tolist(), strict=True):
        whole = as_text(text[a:z])
        exact = [a + at for at in verbatim(as_text(target), whole)]
        out += [(0, at, at + n) for at in exact]
        free = a
        for stop, after in [*((x, x + n) for x in exact), (z, z)]:
            if stop - free >= n - e:
                cost, start, finish = alignments(target, text[free:stop], -e, stop - free - n + 2 * e + 1)
                good = np.flatnonzero(cost <= e)
                got = np.stack([cost[good], start[good], finish[good]], 1)
                out += apart([(c, free + s, free + f) for c, s, f in got[np.lexsort(got.T[::-1])].tolist()])
            free = after
    return out


def apart(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of ``(edits, start, end)`` that overlap none before them in the list."""
    if not found:
        return []
    low = min(s for _, s, _ in found)
    used, out = np.zeros(max(f for *_, f in found) - low + 1, bool), []
    for edits, start, end in found:
        if not used[start - low : end - low].any():
            used[start - low : end - low] = True
            out.append((edits, start, end))
    return out


def occurrences(texts: list[str], index: Index) -> list[tuple[int, int, int, int, int]]:
    """``(text, item, start, end, edits)`` of every item found within its budget."""
    whole = [characters(t) for t in texts]
    # long texts in windows that overlap by what an occurrence can cover
    reach = 2 * index.longest + index.q
    step = max(WINDOW, 2 * reach)
    found: dict[tuple[int, int], set[tuple[int, int, int]]] = {}
    group: list[tuple[int, int, np.ndarray]] = []
    held = 0

    def flush() -> None:
        for d, i, edits, start, end in within(group, index):
            found.setdefault((d, i), set()).add((edits, start, end))
        group.clear()

    for d, a in enumerate(whole):
        for k in range(0, max(1, len(a) - reach), step):
            part = a[k : k + step + reach]
            if held + len(part) > 2 * WINDOW:
                flush()
                held = 0
            group.append((d, k, part))
            held += len(part)
    flush()
    out = []
    for (d, i), own in found.items():
        at = places(texts[d])
        out += [(d, i, int(at[start]), int(at[end - 1]) + 1, edits) for edits, start, end in apart(sorted(own))]
    return sorted(out)


def within(group: list[tuple[int, int, np.ndarray]], index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """``(text, item, edits, start, end)`` in parts ``(text, offset, characters)`` of texts."""
    for d, offset, part in group:
        if index.short is not None:
            text = as_text(part)
            for last, own in index.short.iter(text):
                at, end = last + 1 - len(index.texts[own[0]]), last + 1
                if not any(map(str.isalnum, text[max(0, at - 1) : at] + text[end : end + 1])):
                    yield from ((d, i, 0, offset + at, offset + end) for i in own)
    if not len(index.keys):
        return
    gap = np.full(1, 0x110000, np.uint32)  # no code point, so no q-gram crosses it
    buffer = np.concatenate([np.zeros(0, np.uint32), *(x for *_, p in group for x in (p, gap))])
    begins = np.concatenate([[0], np.cumsum([len(p) + 1 for *_, p in group])]).astype(np.int64)
    grams = qgrams(buffer, index.q)
    maybe = np.flatnonzero(index.bloom[(grams >> np.uint64(42)).astype(np.int64)])
    k = np.minimum(np.searchsorted(index.keys, grams[maybe]), len(index.keys) - 1)
    real = index.keys[k] == grams[maybe]
    where, k = maybe[real], k[real]
    if not len(where):
        return
    for i, keys in index.monotonous.items():
        own = where[np.isin(k, keys)]
        for g in np.unique(np.searchsorted(begins, own, side="right") - 1).tolist():
            d, offset, part = group[g]
            for edits, start, end in dense(i, own[(own >= begins[g]) & (own < begins[g + 1])] - begins[g], part, index):
                yield d, i, edits, offset + start, offset + end
    for g, i, b in bands(where, k, begins, index).tolist():
        d, offset, part = group[g]
        s, target = int(index.budget[i]) + 1, index.texts[i]
        low = b * s
        a, z = max(0, low), min(len(part), low + 2 * s + len(target))
        at = as_text(part[a:z]).find(as_text(target))
        edits, start, end = (0, a + at, a + at + len(target)) if at >= 0 else banded(target, part, low, 2 * s)
        if edits <= index.budget[i] and start < end:
            yield d, i, edits, offset + start, offset + end


def unique_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and how often each stands, by one sort of a packed key where it fits."""
    low = rows.min(0)
    span = (rows.max(0) - low + 1).astype(object)
    if span[0] * span[1] * span[2] >= 1 << 62:
        return np.unique(rows, axis=0, return_counts=True)
    r = rows - low
    key, count = np.unique((r[:, 0] * int(span[1]) + r[:, 1]) * int(span[2]) + r[:, 2], return_counts=True)
    rest, third = np.divmod(key, int(span[2]))
    first, second = np.divmod(rest, int(span[1]))
    return np.stack([first, second, third], 1) + low, count


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = Q, share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``__id``, ``item``, ``start``, ``end``, ``edits`` of every benchmark item that stands in a text."""
    spark = docs.sparkSession
    items = stored(keyed_text(benchmark, item_col, item_text_col).dropna(subset=["__text"]))
    kind = docs.schema[id_col].dataType.simpleString()
    # repeated items are looked for once
    own = stored(items.select("__text").distinct().withColumn("no", F.monotonically_increasing_id()))
    blocks = 1 + (own.agg(F.sum(F.length("__text"))).first()[0] or 0) // block_chars
    place = lambda: F.pmod(F.xxhash64("no"), F.lit(blocks))
    # dealt by number, so even on the whole; more blocks where one is much larger than it should be, but for one item that is
    while not own.groupBy(place().alias("b")).agg(F.sum(F.length("__text")).alias("n"), F.count(F.lit(1)).alias("c")).filter((F.col("n") > 2 * block_chars) & (F.col("c") > 1)).isEmpty():
        blocks *= 2
    schema = f"__id {kind}, no bigint, start int, end int, edits int"

    def passed(block: int) -> DataFrame | None:
        index = Index.of([tuple(r) for r in own.filter(place() == block).orderBy("no").select("no", "__text").collect()], q, share)
        if index is None:
            return None
        shared = spark.sparkContext.broadcast(index)

        def run(piece: pa.RecordBatch) -> pa.RecordBatch:
            got = occurrences([t or "" for t in piece.column("__text").to_pylist()], shared.value)
            cols = list(zip(*got, strict=True)) or [[]] * 5
            ids = piece.column("__id").take(pa.array(cols[0], pa.int32()))
            found = pa.array([shared.value.ids[i] for i in cols[1]], pa.int64())
            return pa.RecordBatch.from_arrays([ids, found, *(pa.array(c, pa.int32()) for c in cols[2:])], ["__id", "no", "start", "end", "edits"])

        return map_slices(keyed_text(docs, id_col, text_col), run, schema)

    frames = [f for f in map(passed, range(blocks)) if f is not None]
    found = reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)
    named = items.join(own, "__text").select("no", F.col("__id").alias("item"))
    return found.join(named, "no").select("__id", "item", "start", "end", "edits")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rowwise: bool = False, **how: Any) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item: all rows of their ids, or with ``rowwise`` only the rows whose text holds one."""
    if rowwise:
        rows = by_row(docs, id_col, text_col)
        return without_ids(rows, leaks(rows, benchmark, "key", "text", **how).select("__id").distinct(), "key").select("row.*")
    return without_ids(docs, leaks(docs, benchmark, id_col, text_col, **how).select("__id").distinct(), id_col)
