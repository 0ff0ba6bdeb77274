"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL, scored as sparse dot products.

A text becomes two streams of tokens: its words as they stand and their shapes
(case, digits, runs of other characters).  Unigrams and bigrams of both are
hashed; a bigram of a word with itself is one feature whatever the word, as is
what a word ends on when that isn't a letter.  A feature's value is its share of the tokens.

Defined results: a null or empty text has no features and scores by the bias;
without labels every score is 0.5; texts are scored whole; an id with several
labels has the largest, and a score equal to the limit of ``keep`` is kept; repeated
rows are scored each; an empty table gives an empty result.  Only the id and text of a document are read.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, map_slices
from .linear import FTRL, labelled_sample, score_texts, sigmoid

BUCKETS = 1 << 18
SCALE = 30.0
TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")


@lru_cache(1 << 16)
def token_hash(token: bytes) -> tuple[int, int]:
    """Hashes of the token and of its shape."""
    if token[:1].isdigit():
        shape = b"9"
    elif token[0] >= 128 or token[:1].isalpha():
        text = token.decode("utf-8", "replace")
        shape = b"A" if len(text) > 1 and text.isupper() else b"Aa" if text[:1].isupper() else b"a"
        shape += b"." if len(text) > 25 else b""
    else:
        shape = token[:4]
    return zlib.crc32(token), zlib.crc32(shape, 77)


def features(text: bytes) -> np.ndarray:
    """Buckets of all n-grams of a text, repeats included."""
    tokens = TOKEN.findall(text)
    if not tokens:
        return np.zeros(0, np.int32)
    h = np.array([token_hash(t) for t in tokens], np.uint64)
    out = [h[:, 0], h[:, 1] + np.uint64(1)]
    if len(tokens) > 1:
        a, b = h[:-1], h[1:]
        pair = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
        out += [np.where(a[:, 0] == b[:, 0], np.uint64(12345), pair[:, 0]), pair[:, 1]]
    mixed = np.concatenate(out) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(46)).astype(np.int32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", epochs: int = 3) -> np.ndarray:
    """Weights of all buckets and the bias."""
    sample = labelled_sample(docs, labels, label, lambda t: (len(f := features(t)), f), id_col, text_col)
    model = FTRL(BUCKETS, alpha=0.5, l1=0.05, l2=0.1)
    for _ in range(epochs):
        for y, n, at, count in sample.rows():
            model.learn(at, SCALE * count / max(1, n), float(y > 0))
    return model.dense().astype(np.float32)


def probabilities(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    out = np.empty(len(texts))
    for i, t in enumerate(texts):
        at = features(t)
        out[i] = weights[-1] + (SCALE * weights[at].sum(dtype=np.float64) / len(at) if len(at) else 0.0)
    return sigmoid(out)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``__id`` and ``score`` (likelihood of label 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    return score_texts(docs, lambda texts: probabilities(texts, shared.value), id_col, text_col)


def keep(docs: DataFrame, weights: np.ndarray, least: float, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that score ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    places = [f"c{k}" for k in range(len(docs.columns))]  # whatever the columns are called
    rows, text = docs.toDF(*places), places[docs.columns.index(text_col)]

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        return piece.filter(pa.array(probabilities(as_bytes(piece.column(text)), shared.value) >= least))

    return map_slices(rows, run, rows.schema, text).toDF(*docs.columns)
