"""SimHash near-duplicate groups through the generalised pigeonhole principle.

Fingerprints of 64 bits are dealt into groups of correlated bits.  For a radius
``r`` and ``m`` groups, thresholds with sum ``r - m + 1`` guarantee that any two
fingerprints within ``r`` bits agree, in at least one group, up to that group's
threshold (a threshold of -1 leaves its group out).  Dynamic programming picks
the thresholds with the least estimated number of probes and candidates; the
candidates are then verified on all 64 bits.

``near_duplicates`` links fingerprints of shingles within a radius.  Texts of which
0.8 of the five-word shingles are the same differ in 9 bits or so, too many to probe
for; ``similar`` finds them by fingerprints of their words, which an edit changes
less (a word that stands n times counts log n times), and verifies candidates
by a sketch of their shingles, 1,024 further bits whose distance tells the similarity.

Defined results: a null text counts as empty; a text without words has
fingerprint zero and is linked like any other; repeated rows give a row each; a
bit that half of the hashes have is 0; of rows with one id the first stands for
a group, and equal rows are one; texts are taken whole; a null id never becomes a
component's name unless all its ids are null; an empty table gives an empty result.  Only the two named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, as_bytes, by_row, cut, keyed_text, map_slices, spare, stored, tidy, without_ids

#: Distinct fingerprints looked at to group bits and to estimate candidates; it steers the plan only, never the result.
PLAN_SAMPLE = 4000
#: Index rows with one key, beyond a few times what even keys would have, from which the key's comparisons are dealt out in blocks.
LIGHT_BUCKET = 32
LIGHT_TIMES = 4
#: Fingerprints a side in such a block.
BLOCK = 1024
#: Numbers of 64 bits in a sketch, and bits in which the words' fingerprints of similar texts differ at most (of pairs with a similarity over 0.8, 0.96 do).
SKETCH = 16
WORDS_RADIUS = 6
#: Deviations beyond the expected distance up to which sketches count as similar: one in ten with just the similarity isn't.
DEVIATIONS = 1.3
MIX = np.uint64(0xD6E8FEB86659FD93)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    counts = np.zeros(64, np.int64)
    ordered = hashes.astype(">u8")
    for k in range(0, len(ordered), 1 << 16):
        counts += np.unpackbits(ordered[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(ordered)).tobytes(), "big")


def shingle_hashes(words: list[bytes], shingle_words: int, seed: int = 42) -> np.ndarray:
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1)
    starts, stops = (ends - sizes - 1).tolist(), (ends - 1).tolist()
    n = max(1, len(words) - shingle_words + 1)
    digest = xxhash.xxh64_intdigest
    tails = stops[shingle_words - 1 :] if len(words) >= shingle_words else [len(joined)]
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[:n], tails, strict=True)], np.uint64)


def fingerprint(text: bytes, shingle_words: int, seed: int = 42) -> int:
    words = text.translate(ASCII_LOWER).split()
    return majority(shingle_hashes(words, shingle_words, seed)) if words else 0


def plane(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th of several independent hashes made of one."""
    h = (hashes ^ (hashes >> np.uint64(32))) * MIX + np.uint64(k)
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(32))


def sketch(text: bytes, shingle_words: int = 5) -> tuple[int, int, list[int]]:
    """Fingerprint of a text's different shingles, that of its words, and a sketch of the shingles."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return 0, 0, [0] * SKETCH
    digest = xxhash.xxh64_intdigest
    of_words = np.array([digest(w, k) for w, n in Counter(words).items() for k in range(n.bit_length())], np.uint64)
    shingles = np.unique(shingle_hashes(words, shingle_words))
    return majority(shingles), majority(of_words), [majority(plane(shingles, k)) for k in range(SKETCH)]


def sketch_radius(similarity: float) -> int:
    """Bits in which sketches of texts with a shingle similarity differ at most, but for one in ten."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = 64 * SKETCH
    return int(n * share + DEVIATIONS * math.sqrt(n * share * (1 - share)))


def sketches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5) -> DataFrame:
    """``__id``, ``node``, ``fp`` and ``sketch`` of every row, as signed numbers."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        own = [sketch(t, shingle_words) for t in as_bytes(piece.column("__text"))]
        flat = np.array([(node, fp, *more) for node, fp, more in own], np.uint64).reshape(-1, 2 + SKETCH).view(np.int64)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(flat[:, 2:].ravel()), SKETCH).cast(pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([piece.column("__id"), pa.array(flat[:, 0]), pa.array(flat[:, 1]), lists], ["__id", "node", "fp", "sketch"])

    return map_slices(keyed_text(df, id_col, text_col), run, f"__id {kind}, node bigint, fp bigint, sketch array<bigint>")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """``__id`` and ``fp``, the fingerprint as a signed bigint, of every row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle_words) for t in as_bytes(piece.column("__text"))], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([piece.column("__id"), pa.array(fps.view(np.int64))], ["__id", "fp"])

    return map_slices(keyed_text(df, id_col, text_col), run, f"__id {kind}, fp bigint")


def group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of nearly equal size, each grown from a seed bit by the strongest absolute correlation."""
    width = bits.shape[1]
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = np.abs(np.nan_to_num(np.corrcoef(bits, rowvar=False))) if len(bits) > 1 else np.zeros((width, width))
    free, groups = set(range(width)), []
    for k in range(m):
        room = math.ceil(len(free) / (m - k))
        order = sorted(free)
        seed = order[int(np.argmax(corr[np.ix_(order, order)].sum(1)))]
        group = [seed]
        free.discard(seed)
        while len(group) < room:
            order = sorted(free)
            best = order[int(np.argmax(corr[np.ix_(order, group)].sum(1)))]
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def ball(width: int, radius: int) -> int:
    return sum(math.comb(width, k) for k in range(radius + 1)) if radius >= 0 else 0


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of -1 upwards with the given sum and the least summed cost; ``costs[i][t + 1]`` is the cost of threshold t in group i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for done, (cost, chosen) in best.items():
            for t in range(-1, len(row) - 1):
                have = step.get(done + t)
                if have is None or cost + row[t + 1] < have[0]:
                    step[done + t] = (cost + row[t + 1], [*chosen, t])
        best = step
    return best[total]


def plan(sample: np.ndarray, n: int, radius: int, probe_cost: float = 1.0, candidate_cost: float = 0.05) -> list[tuple[list[int], int]]:
    """Bit groups and their thresholds for ``n`` fingerprints of which ``sample`` (uint64) is a part."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    half = sample[: max(1, len(sample) // 2)], sample[len(sample) // 2 :]
    chosen: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(2, radius + 2):
        groups, costs = group_bits(bits, m), []
        for g in groups:
            mask = np.uint64(sum(1 << b for b in g))
            near = np.zeros(len(g) + 1)
            for k in range(0, len(half[0]), 500):
                near += np.bincount(np.bitwise_count((half[0][k : k + 500, None] ^ half[1][None, :]) & mask).ravel(), minlength=len(g) + 1)
            pairs = max(1, len(half[0]) * len(half[1]))
            share = np.cumsum(near) / pairs
            # few samples say little about rare agreements; independent bits are the least there is
            least = [ball(len(g), t) / 2.0 ** len(g) for t in range(radius + 1)]
            costs.append([0.0] + [n * ball(len(g), t) * probe_cost + n * n * max(float(share[min(t, len(g))]), least[t]) * candidate_cost for t in range(radius + 1)])
        cost, thresholds = allocate(costs, radius - m + 1)
        if chosen is None or cost < chosen[0]:
            chosen = cost, [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]
    assert chosen
    return chosen[1]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def flips(group: list[int], radius: int) -> list[int]:
    return [signed(sum(1 << b for b in c)) for k in range(radius + 1) for c in combinations(group, k)]


def spanning(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what the links between two blocks join (``near``, rows and columns named by ``left`` and ``right``): each member to the first of its local component."""
    edges: list[tuple[int, int]] = []
    todo_l, todo_r = near.any(1), near.any(0)
    while todo_l.any():
        in_l, in_r = np.zeros(len(left), bool), np.zeros(len(right), bool)
        in_l[np.argmax(todo_l)] = True
        new = in_l
        while new.any():
            reach = near[new].any(0) & ~in_r
            in_r |= reach
            new = near[:, reach].any(1) & ~in_l if reach.any() else np.zeros(len(left), bool)
            in_l |= new
        members = sorted({*left[in_l].tolist(), *right[in_r].tolist()})
        edges += [(members[0], x) for x in members[1:]]
        todo_l &= ~in_l
        todo_r &= ~in_r
    return edges


def links(distinct: DataFrame, radius: int = 4, sketch_bits: int | None = None) -> DataFrame:
    """Edges ``a < b`` between nodes whose components are those of all pairs of fingerprints ``fp`` within ``radius`` bits.

    A node is its fingerprint, or has a name ``node`` of its own; with ``sketch_bits``
    only pairs count whose ``sketch`` differ in so many bits at most.  A key with few
    index rows yields each of its links; a key with many yields a spanning forest
    for each block of comparisons, so rows grow in proportion to the fingerprints
    and not to the square of a group.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    if n == 0:
        return spark.createDataFrame([], "a bigint, b bigint")
    if "node" not in distinct.columns:
        distinct = distinct.withColumn("node", F.col("fp"))
    rows = distinct.orderBy(F.xxhash64("node")).limit(PLAN_SAMPLE).select("fp").collect()
    sample = np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)
    parts = plan(sample, n, radius)

    def keys(k: int) -> tuple[Column, Column]:
        group, t = parts[k]
        masked = F.col("fp").bitwiseAND(F.lit(signed(sum(1 << b for b in group))))
        around = F.transform(F.array(*[F.lit(x) for x in flips(group, t)]), lambda f: masked.bitwiseXOR(f))
        return masked, around

    def tagged(k: int, keys: Column) -> Column:
        return F.transform(keys, lambda x: F.struct(F.lit(k).alias("part"), x.alias("key")))

    own = F.array(*[F.struct(F.lit(k).alias("part"), keys(k)[0].alias("key")) for k in range(len(parts))])
    around = F.flatten(F.array(*[tagged(k, keys(k)[1]) for k in range(len(parts))]))
    named = [F.col("fp")] if sketch_bits is None else [F.col("fp"), F.col("node")]
    node, other = ("fp", "q") if sketch_bits is None else ("node", "q_node")
    index = distinct.select(*named, F.explode(own).alias("s")).select("s.*", *named)
    probe = distinct.select(*[c.alias(x) for c, x in zip(named, ("q", "q_node"), strict=False)], F.explode(around).alias("s")).select("s.*", *("q", "q_node")[: len(named)])
    limits = F.array(*[F.lit(LIGHT_BUCKET + LIGHT_TIMES * n // (1 << len(g))) for g, _ in parts])
    heavy = cut(index.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n_index")).filter(F.col("n_index") > F.get(limits, F.col("part"))))

    some_heavy = not heavy.isEmpty()
    light_index, light_probe = (x.join(heavy, ["part", "key"], "left_anti") if some_heavy else x for x in (index, probe))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("q"))) <= radius
    light = (
        light_probe.join(light_index, ["part", "key"])
        .filter((F.col(node) < F.col(other)) & close)
        .select(F.col(node).alias("a"), F.col(other).alias("b"))
    )
    if sketch_bits is not None:
        sides = [distinct.select(F.col("node").alias(x), F.col("sketch").alias(f"{x}_sketch")) for x in "ab"]
        apart = sum((F.bit_count(F.col("a_sketch")[k].bitwiseXOR(F.col("b_sketch")[k])) for k in range(SKETCH)), F.lit(0))
        light = light.distinct().join(sides[0], "a").join(sides[1], "b").filter(apart <= sketch_bits).select("a", "b")
    if not some_heavy:
        return light.distinct()
    counts = probe.join(heavy, ["part", "key"]).groupBy("part", "key").agg(F.count(F.lit(1)).alias("n_probe"))
    wide = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    place = lambda c, of: F.pmod(F.xxhash64(c), wide(of)).cast("int")
    sized = cut(heavy.join(counts, ["part", "key"]))
    held = [F.col("fp"), F.col(node).alias("node")]
    sides = [
        index.join(sized, ["part", "key"]).select("part", "key", place(node, "n_index").alias("i"), F.explode(F.sequence(F.lit(0), wide("n_probe") - 1)).alias("j"), *held, F.lit(True).alias("indexed")),
        probe.join(sized, ["part", "key"]).withColumn("fp", F.col("q")).select("part", "key", F.explode(F.sequence(F.lit(0), wide("n_index") - 1)).alias("i"), place(other, "n_probe").alias("j"), "fp", F.col(other).alias("node"), F.lit(False).alias("indexed")),
    ]
    both = sides[0].unionByName(sides[1])
    if sketch_bits is not None:
        both = both.join(distinct.select("node", "sketch"), "node")

    def block(table: pa.Table) -> pa.Table:
        side, nodes, fps = table["indexed"].to_numpy(), table["node"].to_numpy(), table["fp"].to_numpy().view(np.uint64)
        near = np.bitwise_count(fps[side][:, None] ^ fps[~side][None, :]) <= radius
        if sketch_bits is not None:
            sk = table["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH)
            near &= sum(np.bitwise_count(sk[side, k][:, None] ^ sk[~side, k][None, :]).astype(np.int16) for k in range(SKETCH)) <= sketch_bits
        edges = np.array(spanning(near, nodes[side], nodes[~side]), np.int64).reshape(-1, 2)
        spare()
        return pa.table({"a": edges[:, 0], "b": edges[:, 1]})

    dense = both.groupBy("part", "key", "i", "j").applyInArrow(block, "a bigint, b bigint")
    return light.unionByName(dense).distinct()


def stars(edges: DataFrame) -> bool:
    """Whether each node has an edge to its root and to nothing else."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("root"), F.lit(0).alias("leaf")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(F.max("root").alias("root"), F.sum("leaf").alias("leaf")).filter("root + leaf > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) of every node of the edges ``a``, ``b``.

    Alternates large-star and small-star steps; each step only sends minima and
    edges through a shuffle, and the number of edges never grows.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    while not stars(edges):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        # kept apart from the join, so that the edges of one node can be dealt over several tasks
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.filter("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct()
        large = cut(large)
        down = cut(large.groupBy("b").agg(F.min("a").alias("m")))
        small = large.join(down, "b").select("m", "a", "b").select(F.explode(F.array(F.struct("m", F.col("a").alias("x")), F.struct("m", F.col("b").alias("x")))).alias("s"))
        edges = cut(small.select(F.col("s.m").alias("a"), F.col("s.x").alias("b")).filter("a < b").distinct())
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def named_by_least(rows: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """``component_id`` of each row (``__id``, ``node``, ...): the smallest id that edges between nodes lead to; ``distinct`` has a node's ``least``."""
    tree = components(edges).withColumnRenamed("node", "of")
    rooted = distinct.join(tree, distinct["node"] == tree["of"], "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    # kept apart from the join, so that one large group can be dealt over several tasks
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    label = cut(rooted.join(named, "root").select("node", "component_id"))
    return rows.join(label, "node")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, radius: int = 4) -> DataFrame:
    """``__id``, ``fp`` and ``component_id`` of every row: the smallest id that links within ``radius`` bits lead to."""
    fps = cut(fingerprints(df, id_col, text_col, shingle_words))
    distinct = cut(fps.groupBy("fp").agg(F.min("__id").alias("least")))
    named = named_by_least(fps.withColumn("node", F.col("fp")), distinct.withColumn("node", F.col("fp")), links(distinct.select("fp"), radius))
    return named.select("__id", "fp", "component_id")


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``__id`` and ``component_id`` of every row: the smallest id that links of texts with ``similarity`` of their shingles lead to."""
    rows = stored(sketches(df, id_col, text_col, shingle_words))
    distinct = stored(rows.groupBy("node").agg(F.min("__id").alias("least"), F.min(F.struct("fp", "sketch")).alias("s")).select("node", "least", "s.*"))
    edges = links(distinct, WORDS_RADIUS, sketch_radius(similarity))
    tidy(df.sparkSession)
    return named_by_least(rows.select("__id", "node"), distinct.select("node", "least"), edges).select("__id", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows of ``df`` less all but one document of each group of similar texts: the one with the smallest id (of repeated rows, one).

    Rows count by id and text, so different texts that share an id, null included, stand for themselves.
    """
    rows = by_row(df, id_col, text_col)
    groups = cut(similar(rows, "key", "text", shingle_words, similarity))
    by_key = groups.groupBy("__id").agg(F.max(F.col("__id").eqNullSafe(F.col("component_id"))).alias("stays"), F.count(F.lit(1)).alias("n"))
    kept = without_ids(rows, by_key.filter(~F.col("stays")).select("__id"), "key")
    if not by_key.filter("stays AND n > 1").isEmpty():
        kept = kept.dropDuplicates(["key"])
    return kept.select("row.*")
