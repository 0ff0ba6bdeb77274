"""Quality rules judged by host.

Each document is measured; each rule's failures are summed by host; a host's
failure rates are shrunk towards all hosts' with a beta prior fitted to them by
moments (hosts weighed by their documents, sampling noise taken off); a host whose
shrunk rate of any rule lies ``DEVIATIONS`` of the prior's deviations above its
mean (and over ``LEAST_RATE``), or over ``MOST_RATE``, is rejected, and with it every
document of it.

Defined results: a null text counts as empty and fails the base rule; a null host
has no verdict, so its documents stand on their own; the host of an address is
what stands after its scheme, of anything else the whole; case doesn't count; a
rate equal to its limit passes; texts are taken whole; repeated rows count and
appear once each; an empty table gives an empty result.  Only the three named
columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, map_slices

# ASCII white space and the characters that count as symbols.
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"

WINDOW = 8
#: Deviations above the mean beyond which a host is rejected, and the shares of failing documents between which that limit lies.
DEVIATIONS = 2.0
LEAST_RATE, MOST_RATE = 0.25, 0.5
#: Documents that the prior weighs as much as where hosts don't differ beyond chance.
NO_SPREAD = 1e9
#: What stands after the scheme of an address, up to port or path.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
#: Rejected hosts that may go to every executor (a name of some tens of bytes each); beyond that the join is dealt out with salts.
BROADCAST_HOSTS = 100_000
SALTS = 32


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words within windows that stand twice or more in the text; windows are compared exactly, by doubling ranks."""
    n = len(words)
    if n < window + 1:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if len(known) == n:
        return 0
    width = 1
    while width < window:
        pair = ids[: len(ids) - width] * (int(ids.max()) + 1) + ids[width:]
        _, ids = np.unique(pair, return_inverse=True)
        width *= 2
    twice = np.bincount(ids)[ids] > 1
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def measures(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, code points in them, symbols, repeated lines, repeated words."""
    words = text.split()
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = len(text) - int(count[128:192].sum()) - int(count[list(SPACES)].sum())
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    return len(words), chars, int(count[list(SYMBOLS)].sum()), dup, repeated_words(words)


def measured(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    host = F.col(f"`{host_col}`").cast("string")
    rows = df.select(F.col(f"`{id_col}`").alias("__id"), F.lower(F.coalesce(F.nullif(F.regexp_extract(host, HOST, 1), F.lit("")), host)).alias("__host"), F.col(f"`{text_col}`").alias("__text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        got = np.array([measures(t) for t in as_bytes(piece.column("__text"))], np.int64).reshape(-1, 5)
        return pa.RecordBatch.from_arrays([piece.column("__id"), piece.column("__host"), *(pa.array(got[:, k]) for k in range(5))], ["__id", "__host", *names])

    return map_slices(rows, run, f"__id {kind}, __host string, " + ", ".join(f"{x} bigint" for x in names))


def rules() -> dict[str, Column]:
    """Each rule's failure."""
    n = F.col("n_words")
    return {
        "base": F.col("base_failed"),
        "symbols": 5 * F.col("n_symbols") > F.col("word_chars"),
        "long_words": F.col("word_chars") > 20 * n,
        "dup_lines": 2 * F.col("n_dup_lines") > n,
    }


def host_verdicts(docs: DataFrame) -> DataFrame:
    """``host``, its documents and for each rule its shrunk rate and limit, and whether it is rejected."""
    failures = rules()
    by_host = docs.filter(F.col("__host").isNotNull()).groupBy("__host").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c.cast("int")).cast("double").alias(f"k_{r}") for r, c in failures.items()])
    sums = [F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("squares")]
    prior = by_host.agg(*sums, *[x for r in failures for x in (F.sum(f"k_{r}").alias(f"all_{r}"), F.sum(F.col(f"k_{r}") * F.col(f"k_{r}") / F.col("n")).alias(f"q_{r}"))])
    out, bad = by_host.join(F.broadcast(prior)), F.lit(False)  # one row
    for r in failures:
        # moments of a beta-binomial with hosts weighed by their documents: what the rates differ beyond sampling noise
        mean = F.col(f"all_{r}") / F.col("all")
        mixed, free = mean * (1 - mean), F.col("hosts") - 1
        beyond = F.col(f"q_{r}") - F.col(f"all_{r}") * mean - mixed * free
        room = mixed * (F.col("all") - F.col("squares") / F.col("all") - free)
        alike = F.when((beyond > 0) & (room > 0), F.least(beyond / room, F.lit(1.0))).otherwise(0.0)
        weight = F.when(alike > 0, 1 / alike - 1).otherwise(NO_SPREAD)
        out = out.withColumn(f"rate_{r}", (F.col(f"k_{r}") + mean * weight) / (F.col("n") + weight))
        out = out.withColumn(f"limit_{r}", F.least(F.lit(MOST_RATE), F.greatest(F.lit(LEAST_RATE), mean + DEVIATIONS * F.sqrt(mixed * alike))))
        bad = bad | (F.col(f"rate_{r}") > F.col(f"limit_{r}"))
    shown = [f"{x}_{r}" for r in failures for x in ("rate", "limit")]
    return out.select(F.col("__host").alias("__of"), F.col("n").cast("bigint").alias("n_docs"), *shown, bad.alias("host_rejected"))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``__id``, the measures, ``base_failed``, ``host_rejected`` and ``kept`` of every row."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    docs = cut(measured(df, id_col, text_col, host_col).withColumn("base_failed", failed))
    rejected = cut(host_verdicts(docs).filter("host_rejected").select("__of"))
    if rejected.count() <= BROADCAST_HOSTS:
        joined = docs.join(F.broadcast(rejected), docs["__host"] == rejected["__of"], "left")
    else:  # a host may have most of all documents, so each is dealt over several tasks
        salted = rejected.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = docs.withColumn("__of_salt", F.pmod(F.xxhash64("__id"), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, (dealt["__host"] == salted["__of"]) & (dealt["__of_salt"] == salted["__salt"]), "left")
    bad = F.col("__of").isNotNull()
    return joined.select("__id", "__host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", bad.alias("host_rejected"), (~F.col("base_failed") & ~bad).alias("kept"))
