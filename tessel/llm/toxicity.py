"""Toxicity: a classifier regularised by counterfactuals.

Logistic regression on the words of a text and their stems (prefixes), by the
root of the text's length.  For every labelled text, identity terms in it are
swapped for others (in a text without any, one is put in), each with its stems
and as often as it stands there, and the squared change of the score is
penalised, so the terms themselves carry next to no weight and a neutral mention
of a group isn't taken for abuse.

Defined results: a null or empty text has no words and scores by the bias;
without labels every score is 0.5; texts are scored whole; an id with several
labels has the largest, and equal scores are no tie to break; repeated rows are
scored each; an empty table gives an empty result.  Only the id and text of a document are read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from .licenses import WORD_BYTES
from .linear import FTRL, Sample, labelled_sample, score_texts, sigmoid

BUCKETS = 1 << 20
PREFIXES = (5, 6, 7)
SCALE = 5.0
#: Words that a worker remembers.
CACHE_WORDS = 300_000

# Words that name groups of people, in English, German, French and Spanish.
IDENTITY_TERMS = """
african american arab asian atheist bisexual black blind buddhist catholic chinese christian deaf disabled
european female feminist gay german hindu hispanic immigrant indian indigenous jewish jew jews latina latino
lesbian male men mexican muslim muslims nonbinary old queer refugee russian straight teenage trans transgender
white woman women young
afrikaner araber ausländer behinderte buddhisten christen deutsche flüchtlinge frauen juden lesben migranten muslime
muslimisch russen schwarze schwule schwul türken weiße jüdisch
africains allemands arabes asiatiques catholiques chrétiens femmes handicapés homosexuels immigrés juifs juive lesbiennes
musulmans musulmane noirs réfugiés russes transgenres
africanos alemanes árabes asiáticos católicos chinos cristianos discapacitados gitanos homosexuales indígenas inmigrantes
judíos lesbianas mujeres musulmanes negros refugiados rusos
""".split()


def bucket(word: bytes) -> int:
    return (zlib.crc32(word) * 0x9E3779B1 & 0xFFFFFFFF) >> 12


def buckets(word: bytes) -> list[int]:
    """Of a word and of its longer prefixes, which stand for the stem of an inflected word."""
    return [bucket(word), *(bucket(b"^" + word[:k]) for k in PREFIXES if len(word) >= k)]


#: Of each identity term all features, its own bucket first.
IDENTITY = [buckets(w.encode()) for w in IDENTITY_TERMS]
BY_BUCKET = {own[0]: own for own in IDENTITY}


def features(text: bytes) -> tuple[int, np.ndarray]:
    """The number of words and the buckets of all of them, repeats included."""
    words = text.translate(WORD_BYTES).split()
    return len(words), np.array([b for w in words for b in buckets(w)], np.int32)


def scale(n_words: int) -> float:
    """Value of one occurrence: long texts need more of them, though fewer a word."""
    return SCALE / max(1.0, n_words) ** 0.5


def swap(held: list[tuple[int, int]], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Features that change, and by how many, when each identity term ``(bucket, count)`` of a text goes and another comes as often; one comes where the text has none."""
    change: Counter[int] = Counter()
    new = [IDENTITY[k] for k in rng.integers(len(IDENTITY), size=max(1, len(held))).tolist()]
    for (old, count), own in zip(held or [(None, 1)], new, strict=True):
        for b in BY_BUCKET.get(old, ()):
            change[b] += count
        for b in own:
            change[b] -= count
    at = sorted(b for b, n in change.items() if n)
    return np.array(at, np.int64), np.array([change[b] for b in at], float)


def fit_rows(sample: Sample, penalty: float = 1.0, epochs: int = 6, positive_weight: float = 2.0, least_texts: int = 8) -> np.ndarray:
    """Weights of all buckets and the bias; what stands in fewer than ``least_texts`` labelled texts isn't learnt."""
    model, rng = FTRL(BUCKETS, alpha=0.5, l1=3.0, l2=0.02), np.random.default_rng(7)
    seen = np.bincount(sample.at, minlength=BUCKETS)
    known = seen >= least_texts
    known[[b for own in IDENTITY for b in own]] = True
    rows = []
    for y, n, at, count in sample.rows():
        own = known[at]
        rows.append((y, at[own], scale(n) * count[own], scale(n), [(b, c) for b, c in zip(at.tolist(), count.tolist(), strict=True) if b in BY_BUCKET]))
    for _ in range(epochs):
        for y, at, x, value, held in rows:
            model.learn(at, x, float(y > 0), positive_weight if y > 0 else 1.0)
            if penalty:
                changed, change = swap(held, rng)
                if len(changed):
                    change *= value
                    w = model.weights(changed)
                    model.step(changed, 2 * penalty * float(w @ change) * change, w)
    return model.dense().astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", penalty: float = 1.0) -> np.ndarray:
    return fit_rows(labelled_sample(docs, labels, label, features, id_col, text_col), penalty)


class Scorer:
    """Scores texts; remembers what words weigh."""

    def __init__(self, weights: np.ndarray) -> None:
        keep = np.flatnonzero(weights[:-1])
        self.weight, self.bias = dict(zip(keep.tolist(), weights[keep].tolist(), strict=True)), float(weights[-1])
        self.words: dict[bytes, float] = {}

    def logit(self, text: bytes) -> float:
        words = text.translate(WORD_BYTES).split()
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        known, total = self.words, 0.0
        for w in words:
            value = known.get(w)
            if value is None:
                value = known[w] = sum(self.weight.get(b, 0.0) for b in buckets(w))
            total += value
        return self.bias + total * scale(len(words))


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``__id`` and ``score`` (likelihood of label 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(Scorer(weights))
    return score_texts(docs, lambda texts: sigmoid(np.array([shared.value.logit(t) for t in texts])), id_col, text_col)
