"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Symbols start as characters; the agenda takes the best-scored pair of neighbours whose
concatenation is a piece (ties: leftmost) and merges it, until none is left. With dropout a
candidate merge is skipped where a keyed hash of (seed and document, chunk, offset in the
chunk, merged piece) falls below the rate, so the same seed gives the same segmentation on
any cluster, another seed another one, and repeated words vary within a text.

No piece of the vocabulary has a blank after its first other character, so merges stay
inside chunks (blanks and the word after them; a line end is alone). All chunks of a slice
run their agendas side by side in matrices, one merge a round; chunks longer than WIDE
symbols run on a heap by the same rule.

Characters without a piece become byte pieces. Decoding joins the pieces' bytes and drops
the blank that encoding put in front, so it gives back every text exactly; U+2581, which
the vocabulary uses for a blank, is written as bytes to keep that true.

Defined cases. Null counts as empty, and an empty text has no ids. A null id hashes like any
other value; repeated rows give the same ids. Empty tables give an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlake.llm.common import mix

RATE, WIDE, SLICE = 0.1, 32, 400_000
_UNKNOWN, _FAR = 1 << 20, np.int32(2**31 - 1)
_loaded: dict = {}


class Pieces:
    """The vocabulary: characters, mergeable pairs with their order, and the bytes of each piece."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        text = {i: sp.id_to_piece(i) for i in range(n)}
        normal = {i: t for i, t in text.items() if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        by = {t: i for i, t in normal.items()}
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.bytes = [t.replace("▁", " ").encode() if i in normal else b"" for i, t in text.items()]
        for b in range(256):
            self.bytes[self.byte_id[b]] = bytes([b])
        self.char = np.arange(0x110000, dtype=np.int64) + _UNKNOWN
        for t, i in by.items():
            if len(t) == 1:
                self.char[ord(t)] = i
        for c in range(128):
            if self.char[c] >= _UNKNOWN:
                self.char[c] = self.byte_id[c]
        self.char[0x20], self.char[0x2581] = self.char[0x2581], 0x2581 + _UNKNOWN
        # the better the score, the smaller the place; equal scores share one
        places = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in normal}, reverse=True))}
        self.place = np.full(n, _FAR, np.int32)
        for i in normal:
            self.place[i] = places[sp.get_score(i)]
        one = lambda t: by.get(t, int(self.char[ord(t)]) if len(t) == 1 and t != "▁" else None)
        self.pair = {(a, b): i for i, t in normal.items() for k in range(1, len(t)) if (a := one(t[:k])) is not None and (b := one(t[k:])) is not None}
        self._table()

    def _table(self) -> None:
        """The pairs as an open-addressed table that numpy can probe."""
        self.bits = 19
        keys = np.array([(a << 21) | b for a, b in self.pair], np.int64)
        vals = np.array(list(self.pair.values()), np.int32)
        self.keys, self.vals, self.probes = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32), 1
        for k, at, v in zip(keys.tolist(), self._slot(keys).tolist(), vals.tolist(), strict=True):
            probe = 1
            while self.keys[at] != -1:
                at, probe = (at + 1) & ((1 << self.bits) - 1), probe + 1
            self.keys[at], self.vals[at], self.probes = k, v, max(probe, self.probes)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, -1 for none."""
        keys = (a << 21) | b
        at = self._slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.vals[at], np.int32(-1))
        open_ = np.flatnonzero((seen != keys) & (seen != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.vals[at[open_[hit]]]
            open_ = open_[~hit & (seen != -1)]
        return out

    def skipped(self, key: np.ndarray, offset: np.ndarray, piece: np.ndarray, rate: int) -> np.ndarray:
        h = key + offset.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + piece.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        return mix(h) < np.uint64(rate)

    # --- agendas of many short chunks, side by side ---

    def _places(self, sym, off, key, rate):
        """Place and piece of each candidate; _FAR where there is none or it is skipped."""
        piece = self.merged(sym[0], sym[1])
        good = np.flatnonzero(piece >= 0)
        place = np.full(len(piece), _FAR, np.int32)
        place[good] = self.place[piece[good]]
        if rate and len(good):
            drop = self.skipped(key[good], off[good], piece[good], rate)
            place[good[drop]] = _FAR
        return place, piece

    def matrix(self, points: np.ndarray, starts: np.ndarray, length: int, keys: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of chunks of one length, after their agendas: (chunks x length, counts)."""
        m = len(starts)
        sym = self.char[points[starts[:, None] + np.arange(length)]]
        count = np.full(m, length, np.int64)
        if length == 1:
            return sym, count
        off = np.broadcast_to(np.arange(length), (m, length)).copy()
        flat = lambda x: np.ascontiguousarray(x).reshape(-1)
        place, piece = self._places((flat(sym[:, :-1]), flat(sym[:, 1:])), flat(off[:, :-1]), np.repeat(keys, length - 1), rate)
        place, piece = place.reshape(m, length - 1), piece.reshape(m, length - 1)
        live = np.arange(m)
        out = np.full((m, length), -1, np.int64)
        cols = np.arange(length)
        while True:
            best = place.argmin(axis=1)
            rows = np.arange(len(live))
            more = place[rows, best] != _FAR
            if not more.all():
                out[live[~more], : sym.shape[1]] = sym[~more]
                live, sym, off, place, piece, best = live[more], sym[more], off[more], place[more], piece[more], best[more]
                rows = np.arange(len(live))
            if not len(live):
                return out, count
            sym[rows, best] = piece[rows, best]
            width = sym.shape[1]
            after = cols[None, :width] > best[:, None]
            shift = lambda x, pad: np.concatenate([x[:, 1:], np.full((len(x), 1), pad, x.dtype)], axis=1)
            sym, off = np.where(after, shift(sym, -1), sym), np.where(after, shift(off, 0), off)
            gone = cols[None, : width - 1] >= best[:, None]
            place, piece = np.where(gone, shift(place, _FAR), place), np.where(gone, shift(piece, -1), piece)
            count[live] -= 1
            for j, ok in ((best - 1, best > 0), (best, best + 1 < count[live])):
                r = rows[ok]
                if len(r):
                    c = j[ok]
                    place[r, c], piece[r, c] = self._places((sym[r, c], sym[r, c + 1]), off[r, c], keys[live[r]], rate)
            full = int(count[live].max())
            if full < width:
                sym, off, place, piece = sym[:, :full], off[:, :full], place[:, : max(full - 1, 1)], piece[:, : max(full - 1, 1)]

    def long_chunk(self, points: np.ndarray, key: np.uint64, rate: int) -> list[int]:
        """The same agenda on a heap, for one chunk of any length; the first candidates are looked up and hashed side by side."""
        symbols = self.char[points]
        n, own = len(symbols), int(key)
        place, piece = self._places((symbols[:-1], symbols[1:]), np.arange(n - 1), np.full(n - 1, key, np.uint64), rate) if n > 1 else (np.zeros(0, np.int32), np.zeros(0, np.int32))
        sym, left, right = symbols.tolist(), list(range(-1, n - 1)), [*range(1, n), -1]
        first = np.flatnonzero(place != _FAR)
        heap = [(p, i, i + 1, sym[i], sym[i + 1], w) for p, i, w in zip(place[first].tolist(), first.tolist(), piece[first].tolist(), strict=True)]
        heapq.heapify(heap)

        def push(i, j):
            if i >= 0 and j >= 0 and (p := self.pair.get((sym[i], sym[j]))) is not None and not (rate and skipped_one(own, i, p, rate)):
                heapq.heappush(heap, (int(self.place[p]), i, j, sym[i], sym[j], p))

        while heap:
            _, i, j, a, b, p = heapq.heappop(heap)
            if sym[i] != a or sym[j] != b or right[i] != j:
                continue
            sym[i], sym[j], right[i] = p, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            push(left[i], i)
            push(i, right[i])
        return [s for s in sym if s != -1]

    # --- texts ---

    def encode(self, texts: list[str], keys: np.ndarray, rate: float = RATE) -> list[np.ndarray]:
        out, first, held = [], 0, 0
        for k, t in enumerate(texts):
            held += len(t)
            if held >= SLICE or k + 1 == len(texts):
                out += self._slice(texts[first : k + 1], keys[first : k + 1], min(2**64 - 1, int(rate * 2**64)))
                first, held = k + 1, 0
        return out

    def _slice(self, texts: list[str], keys: np.ndarray, rate: int) -> list[np.ndarray]:
        lengths = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        points = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le"), np.uint32).astype(np.int64)
        if not len(points):
            return [np.zeros(0, np.int32) for _ in texts]
        blank, end = points == 32, points == 10
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        start |= end
        start[1:] |= end[:-1]
        start[bounds[:-1][lengths > 0]] = True
        starts = np.flatnonzero(start)
        sizes = np.diff(np.append(starts, len(points)))
        doc = np.searchsorted(bounds, starts, "right") - 1
        ordinal = np.arange(len(starts)) - np.searchsorted(starts, bounds)[doc]
        own = mix(keys[doc] + ordinal.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        counts, parts = np.zeros(len(starts), np.int64), []
        for size in np.unique(sizes):
            which = np.flatnonzero(sizes == size)
            if size > WIDE:
                for w in which:
                    ids = self.long_chunk(points[starts[w] : starts[w] + size], own[w], rate)
                    counts[w] = len(ids)
                    parts.append((np.array([w]), np.array([ids], np.int64)))
            else:
                sym, n = self.matrix(points, starts[which], int(size), own[which], rate)
                counts[which] = n
                parts.append((which, sym))
        at = np.concatenate([[0], np.cumsum(counts)])
        ids = np.zeros(at[-1], np.int64)
        for which, sym in parts:
            keep = np.arange(sym.shape[1])[None, :] < counts[which][:, None]
            ids[(at[which][:, None] + np.arange(sym.shape[1]))[keep]] = sym[keep]
        edges = at[np.searchsorted(starts, bounds)]
        return [self._bytes(ids[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def _bytes(self, ids: np.ndarray) -> np.ndarray:
        """Characters without a piece, as byte pieces."""
        if not len(ids) or ids.max() < _UNKNOWN:
            return ids.astype(np.int32)
        out = []
        for i in ids.tolist():
            out += [i] if i < _UNKNOWN else [self.byte_id[b] for b in chr(i - _UNKNOWN).encode()]
        return np.array(out, np.int32)

    def decode(self, ids) -> str:
        return b"".join([self.bytes[i] for i in ids])[1:].decode()


_WORD = 2**64 - 1


def skipped_one(key: int, offset: int, piece: int, rate: int) -> bool:
    """Pieces.skipped for one candidate, in plain integers."""
    h = (key + offset * 0xD6E8FEB86659FD93 + piece * 0xA0761D6478BD642F) & _WORD
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & _WORD
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & _WORD
    return (h ^ (h >> 31)) < rate


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _default(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers as public

    return public.path("piece_bpe_32k.model")


def encoded(docs: DataFrame, seed: int = 0, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, n_chars, ids (array of int), lossless: whether decoding the ids gave the text back."""
    path = _default(path)

    def run(batches):
        import pyarrow as pa

        p = pieces(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                got = p.encode(texts, part.column(2).to_numpy(zero_copy_only=False).view(np.uint64), rate)
                offsets = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(got)))
                same = [p.decode(g.tolist()) == t for g, t in zip(got, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), ids, pa.array(same)], ["id", "n_chars", "ids", "lossless"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("key"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_chars long, ids array<int>, lossless boolean").withColumnRenamed("id", id_col)


def decoded(rows: DataFrame, ids_col: str = "ids", out_col: str = "text", path: str | None = None) -> DataFrame:
    """rows with the decoded text in a further column; null ids give null."""
    path = _default(path)

    @F.pandas_udf("string")
    def text(ids):
        p = pieces(path)
        return ids.map(lambda x: None if x is None else p.decode(x))

    return rows.withColumn(out_col, text(ids_col))
