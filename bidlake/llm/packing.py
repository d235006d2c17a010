"""Hierarchical multi-length packing of documents into training sequences.

A document is its token ids and a closing id. Ids come from a byte-level BPE vocabulary
file; the same vocabulary and merge order run in a faster encoder, which the tests hold
against the file's own library.

1. Runs of whole context windows are cut off as sequences of their own.
2. What remains is routed to the smallest context-size tier that holds it.
3. Tiers are packed from long to short: each sequence starts with the tier's longest
   remainder, and its gap is filled from shorter tiers, longest fitting first. Where none
   fits, the shortest remainder left is cut to size, so every sequence is exactly full.
4. A shard's last tokens become sequences of powers of two; nothing is padded.
5. Sequences of a tier are dealt into step groups of equal token counts, in snake order of
   their attention cost (the sum of squared piece lengths), so groups cost about the same.
   Groups are balanced within a block of BLOCK_TOKENS of one shard, not over the whole table.

Each input partition is a shard packed where it lies: no shuffle, and a lost task's shard is
packed again to the same result. Memory is bounded by BLOCK_TOKENS and the longest document.

Defined cases. Null and empty texts are the closing id alone. Strings of the vocabulary's added
tokens inside a text are those tokens, as in the file's own library. Repeated rows are packed once
each; their pieces share a doc_id. Empty tables give an empty result.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlake.llm.common import library_ids

WINDOW, TIERS, BLOCK_TOKENS, STEP_TOKENS = 1024, (1024, 512, 256, 128), 4_000_000, 16_384
PIECES = "id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
_encoders: dict = {}


def encoder(path: str, pattern: str):
    """The vocabulary of a byte-level BPE file (JSON), as text -> array of ids; the strings of its added tokens give their ids."""
    if path not in _encoders:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # byte-level vocabularies write each byte as a printable character: printable ones stand for themselves, others follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}
        back = {c: b for b, c in shown.items()}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        order = [spec["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if order != sorted(order):
            raise ValueError("merge order and ids differ in this vocabulary")
        _encoders[path] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


class Pool:
    """Remainders by length; the longest that fits, or the shortest."""

    def __init__(self):
        self.lengths: list[int] = []
        self.by: dict[int, list] = {}

    def add(self, length: int, item) -> None:
        if length not in self.by:
            self.by[length] = []
            insort(self.lengths, length)
        self.by[length].append(item)

    def _take(self, at: int):
        n = self.lengths[at]
        item = self.by[n].pop()
        if not self.by[n]:
            del self.by[n]
            del self.lengths[at]
        return n, item

    def longest(self, most: int):
        at = bisect_right(self.lengths, most) - 1
        return self._take(at) if at >= 0 else None

    def shortest(self, least: int):
        at = bisect_left(self.lengths, least)
        return self._take(at) if at < len(self.lengths) else None


def fill(pool: Pool, tier: int, first: tuple) -> tuple[list, int]:
    """A sequence of the tier from its first remainder: pieces (length, item) and the gap that is left."""
    pieces, gap = [first], tier - first[0]
    while gap:
        got = pool.longest(gap)
        if got is None:
            got = pool.shortest(gap + 1)
            if got is None:
                break
            n, (doc, start) = got
            pool.add(n - gap, (doc, start + gap))
            got = gap, (doc, start)
        pieces.append(got)
        gap -= got[0]
    return pieces, gap


class Shard:
    """Packs a stream of documents; items are (document, start), documents are (id, ids)."""

    def __init__(self, number: int):
        self.next_sequence = self.next_group = number << 40
        self.pool = Pool()

    def block(self, docs: list, last: bool) -> list[tuple]:
        """Rows of the sequences that are full; what isn't stays for the next block unless this is the last."""
        done: list[tuple[int, list]] = []
        for doc in docs:
            n = len(doc[1])
            whole = n - n % WINDOW
            done += [(WINDOW, [(WINDOW, (doc, at))]) for at in range(0, whole, WINDOW)]
            if n > whole:
                self.pool.add(n - whole, (doc, whole))
        waiting = []
        for tier in TIERS:
            least = tier // 2 if tier != TIERS[-1] else 0
            while (first := self.pool.longest(tier)) is not None:
                if first[0] <= least:
                    self.pool.add(*first)
                    break
                pieces, gap = fill(self.pool, tier, first)
                if gap:
                    waiting += pieces
                else:
                    done.append((tier, pieces))
        for n, item in waiting:
            self.pool.add(n, item)
        if last:
            done += self.finish()
        return self.rows(done)

    def finish(self) -> list[tuple[int, list]]:
        """The tokens that fill no sequence, as sequences of powers of two."""
        rest = []
        while (got := self.pool.longest(WINDOW)) is not None:
            rest.append(got)
        total, out = sum(n for n, _ in rest), []
        for size in (1 << k for k in range(total.bit_length() - 1, -1, -1)):
            while total >= size:
                step, pieces, need = min(size, WINDOW), [], min(size, WINDOW)
                while need:
                    n, (doc, start) = rest.pop()
                    cut = min(n, need)
                    pieces.append((cut, (doc, start)))
                    if cut < n:
                        rest.append((n - cut, (doc, start + cut)))
                    need -= cut
                total -= step
                out.append((step, pieces))
        return out

    def rows(self, done: list[tuple[int, list]]) -> list[tuple]:
        groups = self.groups(done)
        out = []
        for (tier, pieces), group in zip(done, groups, strict=True):
            offset = 0
            for n, (doc, start) in pieces:
                out.append((doc[0], start, n, doc[1][start : start + n].tobytes(), len(doc[1]), self.next_sequence, offset, tier, group))
                offset += n
            self.next_sequence += 1
        return out

    def groups(self, done: list[tuple[int, list]]) -> list[int]:
        out = [0] * len(done)
        by: dict[int, list] = {}
        for k, (tier, pieces) in enumerate(done):
            by.setdefault(tier, []).append((-sum(n * n for n, _ in pieces), k))
        for tier, seqs in by.items():
            n = -(-len(seqs) * tier // STEP_TOKENS)
            for place, (_, k) in enumerate(sorted(seqs)):
                lap, at = divmod(place, n)
                out[k] = self.next_group + (at if lap % 2 == 0 else n - 1 - at)
            self.next_group += n
        return out


def _packer(path: str, pattern: str):
    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, shard, closing = encoder(path, pattern), Shard(TaskContext.get().partitionId()), np.zeros(1, np.uint32)
        names = [x.split()[0] for x in PIECES.split(", ")]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        id_type = None

        def out(rows):
            for k in range(0, len(rows), 10_000):
                cols = list(zip(*rows[k : k + 10_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, t) for c, t in zip(cols[1:], types, strict=True))], names)

        docs, held = [], 0
        for batch in batches:
            id_type = batch.column(0).type
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids = np.concatenate([library_ids(enc, text).astype(np.uint32), closing]) if text else closing
                docs.append((i, ids))
                held += len(ids)
                if held >= BLOCK_TOKENS:
                    yield from out(shard.block(docs, last=False))
                    docs, held = [], 0
        if id_type is not None:
            yield from out(shard.block(docs, last=True))

    return pack


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Pieces: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, tier, step_group."""
    import public_tokenizers as public

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_packer(path or public.path("byte_bpe_50k.json"), public.PATTERN), PIECES.format(id=kind)).withColumnRenamed("id", id_col)
