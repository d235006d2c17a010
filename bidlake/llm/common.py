"""What the training-data operators share: tables, shared folders, word hashing."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: What separates words: space and the five ASCII control blanks.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. One of our own where it is unset and the session is a single process."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="bidlake-shared-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def _remove(files, place) -> None:
    try:
        files.delete(place, True)
    except Exception:  # noqa: BLE001  the JVM is gone already
        pass


class Workspace:
    """Intermediate tables of one run, in the shared folder.

    A table cut here is read back from files, so a lost executor costs the tasks
    it ran and not the lineage behind them. Tables that later ones have taken in are dropped
    on the way; those that a result still reads go as the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/bidlake-{label}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._place = jvm.org.apache.hadoop.fs.Path
        place = self._place(self.path)
        self._files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        atexit.register(_remove, self._files, place)

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        for name in names:
            self._files.delete(self._place(f"{self.path}/{name}"), True)


# --- byte-level vocabularies in the fast library -------------------------------------------------

#: Unicode's white space, as a class of a regular expression.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LONG_RUN = 1000
_RUN = re.compile(f"[{WHITE}]{{{LONG_RUN},}}")


def library_ids(enc, text: str) -> np.ndarray:
    """Ids of a text by an encoding of the public pattern, strings of its special tokens as those tokens.

    The library's pattern goes back over a run of white space blank by blank and gives up beyond some hundred
    thousand. Such runs are cut out first: what stands before one always ends a word; the run but for its last
    blank is one word if anything but a special token follows, all of it at the end; and the last blank begins anew.
    """
    if _RUN.search(text) is None:
        return enc.encode_to_numpy(text, allowed_special="all")
    special, out = sorted(enc.special_tokens_set, key=len, reverse=True), []
    for k, part in enumerate(re.split(f"({'|'.join(map(re.escape, special))})", text) if special else [text]):
        if k % 2:
            out.append([enc.encode_single_token(part)])
            continue
        at = 0
        for m in _RUN.finditer(part):
            end = m.end() - (m.end() < len(part))
            out += [enc.encode_to_numpy(part[at : m.start()], disallowed_special=()), enc._encode_single_piece(part[m.start() : end])]
            at = end
        out.append(enc.encode_to_numpy(part[at:], disallowed_special=()))
    return np.concatenate([np.asarray(x, np.uint32) for x in out])


# --- words of UTF-8 bytes, hashed without a Python string for each --------------------------------

_RNG = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[list(BLANKS)] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n; grown by doubling."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, b in enumerate((_BASE, _INV)):
            out = np.ones(size, np.uint64)
            out[1:] = np.uint64(b)
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit values: every input bit reaches every output bit."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_slices(column, limit: int = 1 << 20):
    """Cut an Arrow string column into runs of whole rows of about `limit` bytes.

    Yields (first row, bounds, bytes): row first+i is bytes[bounds[i]:bounds[i+1]]. A null is empty.
    """
    import pyarrow as pa

    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
        yield first, off[first : last + 1] - off[first], data[off[first] : off[last]]
        first = last


def find_words(data: np.ndarray, bounds: np.ndarray, gaps: np.ndarray = _GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each row the number of its first word (one more at the end)."""
    word = ~gaps[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True  # words don't run on into the next row
    before = np.empty(len(data), bool)
    if len(data):
        before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    if len(data):
        after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """64-bit hashes of the words; with fold, A-Z count as a-z."""
    up, down = _power_tables(len(data) + 1)
    t = _BYTE[_LOWER[data]] if fold else _BYTE[data]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(t * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words, from the words' hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(_BASE) + words[k : k + n])
    return out
