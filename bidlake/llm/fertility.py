"""Quality rules from tokeniser fertility, beside a few plain text counts.

Two public vocabularies read every text. The piece vocabulary (with byte fallback) gives
characters per token, the share of byte-fallback tokens and the entropy of the text's
tokens; the multilingual byte-level vocabulary gives a second figure of characters per
token. Each script has a band for each measure; a text outside a band is rejected. The
script is that of most of the text's letters.

Tokens are looked up by chunk (white space and what stands after it up to the next), which neither
vocabulary's merges cross, in a bounded cache of each Python worker; when it is full, its chunks become the
older half, from which those still in use come back, so frequent chunks are never looked up anew. Chunks of more
than LONG characters are not kept. The piece vocabulary puts a blank before a text, the other one doesn't: a
text's first chunk is looked up both ways.

Base counts: words are runs outside space and \\t\\n\\v\\f\\r. base_failed: fewer than 20
words, or more than 30 % of the words in 8-word windows found twice or more in the text.

Defined cases. Null and empty texts have zeros for counts, null measures, and fail. Texts
of fewer than MIN_TOKENS tokens are not held to the entropy band, which short texts can't
fill. All columns of docs but id and text are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlake.llm.common import WHITE, find_words, hash_words, library_ids, shingle_hashes, text_slices

MIN_WORDS, REPEAT_PERCENT, WINDOW, MIN_TOKENS, CACHED, LONG, TOGETHER = 20, 30, 8, 64, 300_000, 1000, 1 << 18
#: Bits of token entropy that long texts are held against; shorter ones against the logarithm of their length.
TOP_BITS = 9.0
#: First code point of each range and its script.
SCRIPT_STARTS = [0x0000, 0x0041, 0x005B, 0x0061, 0x007B, 0x00C0, 0x0250, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900, 0x0E00, 0x0E80, 0x1100, 0x1200, 0x1E00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0x20000, 0x30000]
SCRIPT_NAMES = ["none", "latin", "none", "latin", "none", "latin", "other", "greek", "cyrillic", "other", "hebrew", "arabic", "other", "indic", "thai", "other", "hangul", "other", "latin", "none", "kana", "other", "han", "other", "hangul", "other", "han", "other", "han", "none"]
NAMES = sorted(set(SCRIPT_NAMES))
#: By script: least and most characters per piece, most byte-fallback share, least and most characters
#: per multilingual token, least entropy as a share of the greatest possible for the text's length.
BANDS = {
    "latin": (1.3, 7.0, 0.10, 2.06, 7.5, 0.67),
    "greek": (0.6, 4.0, 0.25, 0.6, 5.0, 0.55),
    "cyrillic": (1.0, 6.0, 0.10, 0.8, 6.0, 0.55),
    "hebrew": (0.4, 3.0, 0.40, 0.4, 4.0, 0.50),
    "arabic": (0.4, 4.0, 0.40, 0.4, 5.0, 0.50),
    "indic": (0.2, 3.0, 0.80, 0.2, 5.0, 0.45),
    "thai": (0.2, 3.0, 0.80, 0.2, 5.0, 0.45),
    "hangul": (0.3, 2.0, 0.80, 0.3, 3.0, 0.45),
    "kana": (0.4, 2.0, 0.60, 0.4, 3.0, 0.45),
    "han": (0.3, 2.0, 0.70, 0.3, 3.0, 0.45),
    "other": (0.2, 7.0, 0.95, 0.2, 7.5, 0.40),
    "none": (0.5, 7.0, 0.30, 0.5, 7.5, 0.40),
}
MEASURED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, n_tokens long, chars_per_token double, byte_share double, chars_per_multi double, entropy_share double"
#: Chunks end before a space or line end that follows something else; other white space may stand inside pieces.
_ODD = WHITE.replace("\\t-\\r ", "\\t\\x0b-\\r")
_CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+(?:[{_ODD}][{WHITE}]*[^{WHITE}]+)*(?:[{_ODD}][{WHITE}]*)?|[{WHITE}]+")
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_LEAD = (np.arange(256) & 0xC0) != 0x80
_tools: dict = {}


class Vocabularies:
    """Ids and counts by chunk, cached up to a bound."""

    def __init__(self, piece_path: str, multi_path: str, pattern: str):
        import base64

        import sentencepiece
        import tiktoken

        self.sp = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        with open(multi_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.multi = tiktoken.Encoding("multi", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, tuple[bytes, int]] = {}
        self.older: dict[str, tuple[bytes, int]] = {}
        self.bytes_ = np.array([self.sp.is_byte(i) for i in range(self.sp.get_piece_size())])
        self.newline = self.sp.piece_to_id("<0x0A>")

    def learn(self, chunks: list[str]) -> dict:
        """The chunks' values; those of the older half of the cache that are used again move to the younger."""
        known, out = self.older, {}
        new = []
        for c in chunks:
            if (x := known.get(c)) is None:
                new.append(c)
            else:
                out[c] = x
        # the library puts a blank before each input; a chunk without one goes behind a line end, whose two tokens are cut off
        bare = [not c.startswith(" ") for c in new]
        ids = self.sp.encode(["\n" + c if b else c[1:] for c, b in zip(new, bare, strict=True)], num_threads=1)
        for c, b, i in zip(new, bare, ids, strict=True):
            if c == " ":
                i = [self.sp.piece_to_id("▁")]
            out[c] = np.array(i[2:] if b else i, np.uint16).tobytes(), len(self.multi.encode_ordinary(c) if len(c) <= LONG else library_ids(self.multi, c))
        if len(self.cache) + len(out) > CACHED:
            self.cache, self.older = {}, self.cache
        self.cache |= {c: x for c, x in out.items() if len(c) <= LONG}
        return out

    def read(self, texts: list[str]) -> list[tuple[np.ndarray, int]]:
        """Piece ids (without the ids of line ends) and the number of multilingual tokens, for each text."""
        out, first, size = [], 0, 0
        for k, text in enumerate(texts):
            size += len(text)
            if size >= TOGETHER or k == len(texts) - 1:
                out += self._read(texts[first : k + 1])
                first, size = k + 1, 0
        return out

    def _read(self, texts: list[str]) -> list[tuple[np.ndarray, int]]:
        """Some texts together: their unknown chunks are looked up at once."""
        get, out = self.cache.get, []
        chunks = [_CHUNK.findall(text) for text in texts]
        for c in chunks:
            c += [" " + x for x in c[:1]]
        found = [list(map(get, c)) for c in chunks]
        new = {c for cs, xs in zip(chunks, found, strict=True) if None in xs for c, x in zip(cs, xs, strict=True) if x is None}
        learnt = self.learn(sorted(new)) if new else {}
        for cs, xs in zip(chunks, found, strict=True):
            if None in xs:
                xs = [x or learnt[c] for c, x in zip(cs, xs, strict=True)]
            ids = np.frombuffer(b"".join([x[0] for x in [*xs[-1:], *xs[1:-1]]]), np.uint16)
            out.append((ids[ids != self.newline], sum([x[1] for x in xs[:-1]])))
        return out


def script_of(text: str) -> str:
    """The script of most of the text's letters."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    votes = np.bincount(np.searchsorted(SCRIPT_STARTS, points, "right") - 1, minlength=len(SCRIPT_NAMES))
    by = dict.fromkeys(NAMES, 0)
    for name, v in zip(SCRIPT_NAMES, votes, strict=True):
        by[name] += int(v) * (name != "none")
    return max(NAMES, key=by.get) if any(by.values()) else "none"


def base_counts(column) -> np.ndarray:
    """Rows of n_words, word_chars, n_symbols, n_repeat_words, from the bytes."""
    rows = []
    for _, bounds, data in text_slices(column):
        starts, ends, first = find_words(data, bounds)
        words = hash_words(data, starts, ends, fold=False)
        marks = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_LEAD[data], out=marks[1:])
        chars = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(marks[ends] - marks[starts], out=chars[1:])
        signs = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_SYMBOL[data], out=signs[1:])
        for i in range(len(bounds) - 1):
            a, b = first[i], first[i + 1]
            rows.append((b - a, chars[b] - chars[a], signs[bounds[i + 1]] - signs[bounds[i]], repeated_words(words[a:b], WINDOW)))
    return np.array(rows, np.int64).reshape(-1, 4)


def repeated_words(words: np.ndarray, window: int) -> int:
    """How many words stand in a window that is found twice or more."""
    grams = shingle_hashes(words, window)
    if len(grams) < 2:
        return 0
    _, back, counts = np.unique(grams, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[back] > 1)
    if not len(again):
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def repeated_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\v\f\r"):
            n += line in seen
            seen.add(line)
    return n


def _entropy_share(ids: np.ndarray) -> float:
    if len(ids) < 2:
        return 0.0
    p = np.bincount(ids)
    p = p[p > 0] / len(ids)
    return float(-(p * np.log2(p)).sum() / min(np.log2(len(ids)), TOP_BITS))


def _measurer(piece_path: str, multi_path: str, pattern: str):
    def measure(batches):
        import pyarrow as pa

        key = (piece_path, multi_path)
        tools = _tools.setdefault(key, None) or _tools.update({key: Vocabularies(piece_path, multi_path, pattern)}) or _tools[key]
        for batch in batches:
            base, out = base_counts(batch.column(1)), []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for text, (ids, multi) in zip(texts, tools.read(texts), strict=True):
                n = len(ids)
                chars = len(text) - text.count("\n")
                out.append((repeated_lines(text), script_of(text), n, chars / n if n else None, float(tools.bytes_[ids].sum() / n) if n else None, chars / multi if multi else None, _entropy_share(ids) if n else None))
            cols = list(zip(*out, strict=True)) or [()] * 7
            ints = [pa.array(base[:, k]) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), ints[0], ints[1], ints[2], pa.array(cols[0], pa.int64()), ints[3], pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[3:])],
                ["id", *(x.split()[0] for x in MEASURED.split(", "))],
            )

    return measure


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece_path: str | None = None, multi_path: str | None = None) -> DataFrame:
    """Counts, measures, base_failed and kept for each row of docs."""
    import public_tokenizers as public

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    f = _measurer(piece_path or public.path("piece_bpe_32k.model"), multi_path or public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
    m = rows.mapInArrow(f, f"id {kind}, {MEASURED}")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return m.select(F.col("id").alias(id_col), *(x.split()[0] for x in MEASURED.split(", ")), failed.alias("base_failed"), (~failed & F.coalesce(_inside(), F.lit(False))).alias("kept"))


def _inside():
    """Whether the measures lie in the bands of the row's script."""
    verdict = F.lit(False)
    for name, (lo, hi, share, lo2, hi2, entropy) in BANDS.items():
        ok = F.col("chars_per_token").between(lo, hi) & (F.col("byte_share") <= share) & F.col("chars_per_multi").between(lo2, hi2) & ((F.col("n_tokens") < MIN_TOKENS) | (F.col("entropy_share") >= entropy))
        verdict = F.when(F.col("script") == name, ok).otherwise(verdict)
    return verdict


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that pass, all columns as they were.

    Every column goes through the same pass as the text, so no join is needed and repeated ids do no harm.
    """
    import public_tokenizers as public

    inner = _measurer(public.path("piece_bpe_32k.model"), public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
    at, plain = docs.columns.index(text_col), [x.split()[0] for x in MEASURED.split(", ")]

    def both(batches):
        import pyarrow as pa

        for batch in batches:
            for m in inner([pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(at)], ["id", "text"])]):
                yield pa.RecordBatch.from_arrays([*batch.columns, *m.columns[1:]], [f"c{i}" for i in range(batch.num_columns)] + plain)

    names = [f"c{i}" for i in range(len(docs.columns))]
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    good = docs.toDF(*names).mapInArrow(both, f"{schema}, {MEASURED}").where(~failed & F.coalesce(_inside(), F.lit(False)))
    return good.select(*names).toDF(*docs.columns)
