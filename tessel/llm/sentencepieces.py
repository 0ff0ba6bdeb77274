"""SentencePiece encoding and decoding by a Viterbi search that many words go through together.

A text is cut where no piece can cross: before the first blank of a run and
around characters that no piece holds.  Equal words of a slice are encoded
once; words of equal length advance together, character by character.  At each
end the hashes of all substrings probe the sorted piece keys, and a vectorised
maximum over the candidates stores the backpointer.

For a unigram model a candidate's value is the best score of the path to it.
For a merging (BPE) model the sum of scores isn't what the model means, so a
candidate counts only if it is *stable* after the piece before it: no merge
across their border comes before the merges that made the two.  One path is
left, and it is the one that merging gives, so ids equal the library's.

Defined results: null and empty texts have no pieces and decode to an empty
text; a character that no piece holds becomes its bytes where the model has byte
pieces, else the unknown id; the model's own blank sign in a text comes back as
a blank, as in the library; of merges with one score the leftmost comes first, as
there; texts are encoded whole, a word of n characters without blanks in n log n
steps; repeated rows give a row each; an empty table gives an empty result.  Only the two named columns are read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import KEPT, as_bytes, keyed_text, map_slices

BLANK = 0x2581
BASE = 0x9E3779B97F4A7C15 | 1
#: Words that a worker remembers.
CACHE_WORDS = 600_000
#: Matrix cells that one step of the search holds.
CELLS = 1 << 20
#: Characters of a word beyond which it's cut where no piece can lie, and beyond which what is left of it is merged and not searched.
CUT_WORD = 64
LONG_WORD = 4096
#: Bytes of a vocabulary file that may go to all executors.
MODEL_BYTES = 64 << 20


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & ((1 << 64) - 1), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Model:
    """Pieces as sorted hash keys, with what merging or scoring needs of each."""

    kind: str
    pieces: list[bytes]
    keys: np.ndarray
    ids: np.ndarray
    bloom: np.ndarray
    hash: np.ndarray
    length: np.ndarray
    score: np.ndarray
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    held: np.ndarray
    byte_ids: list[int]
    unknown: int
    longest: int
    prefix: bool
    size: int
    joints: np.ndarray
    table: dict[str, int] = field(repr=False, default_factory=dict)

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Id of the piece with each hash, -1 where there is none."""
        out = np.full(h.shape, -1, np.int64)
        maybe = np.flatnonzero(self.bloom[(h >> np.uint64(40)).ravel().view(np.int64)])
        if len(maybe):
            at = h.ravel()[maybe]
            k = np.minimum(np.searchsorted(self.keys, at), len(self.keys) - 1)
            out.ravel()[maybe] = np.where(self.keys[k] == at, self.ids[k], -1)
        return out


def mixed(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def merged(chars: list[str], table: dict[str, int], score: np.ndarray) -> list[tuple[str, tuple[str, str] | None]]:
    """Merging, pair by pair: best score first, leftmost of equals; each symbol with the two it was last made of.

    Pairs wait in a heap, so n characters take n log n steps.
    """
    n = len(chars)
    symbol, made = list(chars), [None] * n
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[float, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (s := table.get(symbol[i] + symbol[j])) is not None:
            heapq.heappush(heap, (-score[s], i, len(symbol[i]) + len(symbol[j])))

    for i in range(n):
        offer(i)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i] if symbol[i] else n
        if j >= n or len(symbol[i]) + len(symbol[j]) != size:
            continue  # one of the two is another by now
        made[i] = (symbol[i], symbol[j])
        symbol[i] += symbol[j]
        symbol[j], after[i] = "", after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [(s, m) for s, m in zip(symbol, made, strict=True) if s]


def load(path: str, kind: str | None = None) -> Model:
    """Read a vocabulary file on the driver; ``kind`` (bpe or unigram) overrides the file's."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(path, "rb") as f:
        data = f.read()
    if len(data) > MODEL_BYTES:
        raise ValueError(f"{path}: {len(data)} bytes are more than a vocabulary may have")
    proto = pb.ModelProto()
    proto.ParseFromString(data)
    spec = proto.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise NotImplementedError("only models that leave texts as they are")
    kind = kind or {1: "unigram", 2: "bpe"}[proto.trainer_spec.model_type]
    normal = {i: p.piece for i, p in enumerate(proto.pieces) if p.type == 1}
    table = {p: i for i, p in normal.items()}
    n = len(proto.pieces)
    score = np.array([p.score for p in proto.pieces], np.float64)
    chars = {c for p in normal.values() for c in p}
    # a character that stands in pieces but isn't one gets an id of its own beyond the file's
    extra = {c: n + k for k, c in enumerate(sorted(chars - table.keys()))}
    symbols = normal | {i: c for c, i in extra.items()}
    size = n + len(extra)
    rank, left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    dead = set()
    if kind == "bpe":
        order = {s: r for r, s in enumerate(sorted({-score[i] for i in normal}))}
        of = table | extra
        for i, p in normal.items():
            if len(p) > 1:
                got = merged(list(p), table, score)
                if len(got) > 1:
                    dead.add(i)  # merging never makes it
                else:
                    rank[i] = order[-score[i]]
                    left[i], right[i] = (of[x] for x in got[0][1])
    power = powers(BASE, 64)
    hashes, length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
    for i, p in symbols.items():
        c = np.array([ord(x) for x in p], np.uint64)
        hashes[i], length[i] = (c * power[: len(c)]).sum(dtype=np.uint64), len(c)
    usable = np.array(sorted(i for i in symbols if i not in dead), np.int64)
    key = mixed(hashes[usable])
    by_key = np.argsort(key)
    keys, ids = key[by_key], usable[by_key]
    if (np.diff(keys) == 0).any():
        raise ValueError("two pieces have one key")
    bloom = np.zeros(1 << 24, bool)
    bloom[(keys >> np.uint64(40)).view(np.int64)] = True
    held = np.zeros(0x110001, bool)
    held[[ord(c) for c in chars]] = True
    raw = [p.piece.encode() for p in proto.pieces]
    byte_ids = [-1] * 256
    for i, p in enumerate(proto.pieces):
        if p.type == 6:
            byte_ids[int(p.piece[3:5], 16)] = i
            raw[i] = bytes([int(p.piece[3:5], 16)])
        elif p.type in (2, 3):
            raw[i] = b"" if p.type == 3 else proto.trainer_spec.unk_surface.encode()
        else:
            raw[i] = p.piece.replace(chr(BLANK), " ").encode()
    fallback = [int(i) for i in byte_ids] if proto.trainer_spec.byte_fallback else [-1] * 256
    low = min((score[i] for i in normal), default=0.0) - 10.0
    score = np.append(score, np.full(len(extra), low))
    joints = np.array(sorted({ord(a) << 32 | ord(b) for p in normal.values() for a, b in zip(p, p[1:], strict=False)}), np.int64)
    out = Model(kind, raw, keys, ids, bloom, hashes, length, score, rank, left, right, held, fallback, proto.trainer_spec.unk_id, int(length.max()), spec.add_dummy_prefix, n, joints, table)
    for c, i in extra.items():
        out.pieces.append(c.encode())
        assert i == len(out.pieces) - 1
    return out


class Encoder:
    """Encodes slices of texts; remembers words."""

    def __init__(self, model: Model) -> None:
        self.m = model
        self.power = powers(BASE, 1 << 12)
        self.inverse = powers(pow(BASE, -1, 1 << 64), 1 << 12)
        self.small = powers(BASE, model.longest + 1)
        self.forget()

    def forget(self) -> None:
        self.words, self.offsets, self.tokens = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets by text, and ids."""
        m = self.m
        begins, parts, total = [], [], 0
        for t in texts:
            begins.append(total)
            if t:
                t = ("▁" if m.prefix else "") + t.replace(" ", "▁")
                a = np.frombuffer(t.encode("utf-32-le"), "<u4")
                parts.append(a)
                total += len(a)
        begins.append(total)
        if not total:
            return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int32)
        buf = np.concatenate(parts)
        if len(self.power) <= total:
            self.power, self.inverse = powers(BASE, total + 1), powers(pow(BASE, -1, 1 << 64), total + 1)
        run = np.zeros(total + 1, np.uint64)
        np.cumsum(buf * self.power[:total], out=run[1:], dtype=np.uint64)
        foreign, blank = ~m.held[buf], buf == BLANK
        start = foreign | blank
        start[1:] = foreign[1:] | foreign[:-1] | (blank[1:] & ~blank[:-1])
        start[[b for b in begins[:-1] if b < total]] = True
        at = np.flatnonzero(start)
        size = np.diff(np.append(at, total))
        if size.max() > CUT_WORD:  # no piece holds two characters that stand side by side in none
            spots = np.flatnonzero(~start & (np.repeat(size, size) > CUT_WORD))
            start[spots[~np.isin(buf[spots - 1].astype(np.int64) << 32 | buf[spots], m.joints)]] = True
            at = np.flatnonzero(start)
            size = np.diff(np.append(at, total))
        words = (run[at + size] - run[at]) * self.inverse[at]
        words ^= size.astype(np.uint64) << np.uint64(52)
        distinct, first, which = np.unique(words, return_index=True, return_inverse=True)
        self.learn(buf, run, at[first], size[first], foreign[at[first]], distinct)
        k = np.searchsorted(self.words, distinct)
        head, many = self.offsets[k][which], (self.offsets[k + 1] - self.offsets[k])[which]
        ends = np.cumsum(many)
        ids = self.tokens[np.repeat(head - (ends - many), many) + np.arange(ends[-1])]
        upto = np.concatenate([[0], ends])[np.searchsorted(at, begins)]
        if len(self.words) > CACHE_WORDS:
            self.forget()
        return upto, ids

    def learn(self, buf: np.ndarray, run: np.ndarray, at: np.ndarray, size: np.ndarray, foreign: np.ndarray, words: np.ndarray) -> None:
        """Encode the words that aren't remembered."""
        known = np.zeros(len(words), bool)
        if len(self.words):
            k = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            known = self.words[k] == words
        new = np.flatnonzero(~known)
        if not len(new):
            return
        at, size, foreign, words = at[new], size[new], foreign[new], words[new]
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # word, how many ids, ids

        def scalar(i: int, ids: list[int]) -> None:
            rows.append((np.array([i]), np.array([len(ids)]), np.array(ids, np.int32)))

        odd = foreign.copy()
        if self.m.kind == "bpe":  # runs of blanks have pieces of equal score, so which merge comes first depends on the place
            odd |= (size > 1) & (buf[np.minimum(at + 1, len(buf) - 1)] == BLANK)
            odd |= size > LONG_WORD  # few of a length, so there's nothing to go through together
        for i in np.flatnonzero(odd).tolist():
            text = buf[at[i] : at[i] + size[i]].tobytes().decode("utf-32-le")
            scalar(i, self.bytes_of(text) if foreign[i] else [x for s, _ in merged(list(text), self.m.table, self.m.score) for x in self.ids_of(s)])
        for n in np.unique(size[~odd]).tolist():
            group = np.flatnonzero(~odd & (size == n))
            step = max(1, CELLS // (n + 1))
            for a in range(0, len(group), step):
                own = group[a : a + step]
                many, ids = self.search(run, at[own], n)
                rows.append((own, many, ids))
        order = np.concatenate([r[0] for r in rows])
        many = np.concatenate([r[1] for r in rows])
        ids = np.concatenate([r[2] for r in rows])
        begin = np.concatenate([[0], np.cumsum(many)[:-1]])
        # remembered and new words together, sorted by hash
        all_words = np.concatenate([self.words, words[order]])
        all_begin = np.concatenate([self.offsets[:-1], begin + len(self.tokens)])
        all_many = np.concatenate([np.diff(self.offsets), many])
        tokens = np.concatenate([self.tokens, ids])
        by_hash = np.argsort(all_words)
        all_many = all_many[by_hash]
        ends = np.cumsum(all_many)
        self.tokens = tokens[np.repeat(all_begin[by_hash] - (ends - all_many), all_many) + np.arange(ends[-1])]
        self.words, self.offsets = all_words[by_hash], np.concatenate([[0], ends])

    def bytes_of(self, text: str) -> list[int]:
        ids = [self.m.byte_ids[b] for b in text.encode()]
        return ids if min(ids) >= 0 else [self.m.unknown]

    def ids_of(self, symbol: str) -> list[int]:
        i = self.m.table.get(symbol)
        return [i] if i is not None else self.bytes_of(symbol)

    def stable(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether merging keeps the border between pieces x and y.

        Goes back in time: of the two symbols at the border the one that was made
        last is taken apart, and the pair before must not have had a better merge
        across the border; of equals the leftmost comes first.
        """
        m, ok = self.m, np.ones(len(x), bool)
        todo, limit = np.arange(len(x)), np.full(len(x), np.iinfo(np.int64).max)
        while len(todo):
            joint = m.hash[x] + m.hash[y] * self.small[np.minimum(m.length[x], m.longest)]
            both = m.probe(mixed(joint))
            both[m.length[x] + m.length[y] > m.longest] = -1
            crossed = (both >= 0) & (m.rank[both] < limit)
            ok[todo[crossed]] = False
            rx, ry = m.rank[x], m.rank[y]
            go = ~crossed & ((rx >= 0) | (ry >= 0))
            todo, x, y, rx, ry = todo[go], x[go], y[go], rx[go], ry[go]
            on_left = rx > ry
            # the right one was made by a merge to the right of the border, so an equal merge across it would come first
            limit = np.where(on_left, rx, ry + 1)
            x, y = np.where(on_left, m.right[x], x), np.where(on_left, y, m.left[y])
        return ok

    def search(self, run: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi over words of n characters that begin at ``at``: number of ids of each, and all ids."""
        m, w = self.m, len(at)
        last, value = np.full((n + 1, w), -1, np.int64), np.full((n + 1, w), -np.inf)
        value[0] = 0.0
        for i in range(1, n + 1):
            k = np.arange(1, min(i, m.longest) + 1)
            begin = at[None, :] + (i - k)[:, None]
            piece = m.probe(mixed((run[at + i][None, :] - run[begin]) * self.inverse[begin]))
            back = i - k
            good = (piece >= 0) & (value[back] > -np.inf)
            if m.kind == "bpe":
                row, col = np.nonzero(good & (back[:, None] > 0))
                good[row, col] = self.stable(last[back[row], col], piece[row, col])
                gain = np.where(good, 0.0, -np.inf)
            else:
                gain = np.where(good, value[back] + m.score[piece], -np.inf)
            best = len(k) - 1 - np.argmax(gain[::-1], axis=0)  # of equals the longest
            cols = np.arange(w)
            value[i], last[i] = gain[best, cols], piece[best, cols]
        ids, place = np.full((n, w), -1, np.int64), np.full(w, n)
        for k in range(n):
            live = place > 0
            if not live.any():
                break
            got = last[place, np.arange(w)]
            ids[n - 1 - k] = np.where(live, got, -1)
            place = np.where(live, place - m.length[got], 0)
        flat = ids.T[ids.T >= 0]
        many = (ids >= 0).sum(0)
        if (flat >= m.size).any():
            return self.expanded(many, flat)
        return many, flat.astype(np.int32)

    def expanded(self, many: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces become bytes."""
        out, count, at = [], [], 0
        for n in many.tolist():
            own = [x for i in flat[at : at + n].tolist() for x in ([i] if i < self.m.size else self.bytes_of(self.m.pieces[i].decode()))]
            out += own
            count.append(len(own))
            at += n
        return np.array(count), np.array(out, np.int32)


def decode_ids(model: Model, ids: list[int]) -> str:
    raw = b"".join(map(model.pieces.__getitem__, ids))
    if model.prefix and raw[:1] == b" ":
        raw = raw[1:]
    return raw.decode("utf-8", "replace")


def encoder_of(shared: object) -> Encoder:
    """One encoder a worker process and broadcast model, so that words are remembered across partitions."""
    key = shared._jbroadcast_id if hasattr(shared, "_jbroadcast_id") else id(shared.value)
    have = KEPT.get(key)
    if have is None or have[0] is not shared.value:
        KEPT.clear()
        KEPT[key] = have = (shared.value, Encoder(shared.value))
    return have[1]


def encode(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``__id``, ``n_tokens``, ``ids`` and ``round_trip`` (whether decoding gives the text again) of every row."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        encoder = encoder_of(shared)
        texts = [t.decode() for t in as_bytes(piece.column("__text"))]
        upto, ids = encoder.encode(texts)
        listed = ids.tolist()
        same = [decode_ids(encoder.m, listed[a:b]) == t for a, b, t in zip(upto[:-1].tolist(), upto[1:].tolist(), texts, strict=True)]
        arrays = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids, pa.int32()))
        return pa.RecordBatch.from_arrays([piece.column("__id"), pa.array(np.diff(upto), pa.int64()), arrays, pa.array(same, pa.bool_())], ["__id", "n_tokens", "ids", "round_trip"])

    return map_slices(keyed_text(df, id_col, text_col), run, f"__id {kind}, n_tokens bigint, ids array<int>, round_trip boolean", keeps=True)


def decode(df: DataFrame, model: Model, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``__id`` and ``text`` of every row of ids; a null list or id counts as absent."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            texts = [decode_ids(shared.value, [i for i in row or () if i is not None]) for row in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(texts, pa.string())], ["__id", "text"])

    return df.selectExpr(f"`{id_col}` AS __id", f"`{ids_col}` AS __ids").mapInArrow(run, f"__id {kind}, text string")
