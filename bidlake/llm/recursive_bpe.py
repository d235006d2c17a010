"""Byte-level BPE by recursive SQL: encoding and decoding with a DuckDB database in each Python worker.

The database holds the vocabulary and the merge table: every pair of tokens whose bytes together
are a token, with that token as rank and result (about two pairs a token, made from the vocabulary
by a join). Texts are cut into words by the pattern of the vocabulary; words that are tokens are
looked up, the others become rows (word, position, id), and a recursive query contracts in each
round every word's leftmost pair of least rank, until no word has a pair in the merge table.
Decoding joins ids with the vocabulary and aggregates the bytes in the order of positions.

Spark partitions the texts and each worker encodes a distinct word once: a bounded cache maps 64-bit
hashes of words to their ids. (Equal hashes of different words would show as a difference between a
text and its decoded ids, which the query's digest makes visible.)

Words of more than WIDE bytes (a run of blanks, text without blanks) would take a round for each
contraction, so the square of their length. They are contracted in many places a round: wherever a
pair has the least rank within the longest token's number of positions to either side, equal
neighbours in turns from the left. That gives the same ids where each token is built by merges of
lower ranks only: a merge elsewhere then only makes pairs of higher rank beside the token it made,
so it can reach this pair before its turn only by growing one token up to here. `regular` checks
this of a vocabulary; for others such words go the plain way.

Cutting: texts beyond SLICE bytes are read in pieces that end before a blank behind a printable ASCII
character, where a word always ends. So memory is bounded by SLICE and the longest word.

Defined cases. Null and empty texts have no ids. Special tokens are not known: their strings are ordinary
text. Repeated rows are encoded each. All columns but id and text are ignored. Ids that are not in the
vocabulary can't be decoded: ValueError. Empty tables give an empty result.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlake.llm.common import hash_words, text_slices

#: Bytes of text handled together, bytes of a word beyond which it is wide, words kept, tokens decoded together.
SLICE, WIDE, CACHED, DECODED = 1 << 19, 256, 800_000, 1 << 19
LETTER, NUMBER, BLANK = 1, 2, 3
_tools: dict = {}

VOCAB = "CREATE TABLE vocab AS SELECT id::INTEGER AS id, hex FROM given ORDER BY id"
MERGES = """
CREATE TABLE merges AS
SELECT l.id AS a, r.id AS b, v.id AS c
FROM (SELECT id, hex, unnest(range(2, length(hex), 2)) AS cut FROM vocab) v
JOIN vocab l ON l.hex = substring(v.hex, 1, cut) JOIN vocab r ON r.hex = substring(v.hex, cut + 1)
"""
#: One contraction for each word and round: its leftmost pair of least rank. Positions stay gapless.
NARROW = """
WITH RECURSIVE step(word, pos, id, live) AS (
  SELECT word, pos, id, true FROM start
  UNION ALL
  SELECT s.word, s.pos - coalesce(s.pos > l.spot, false)::INTEGER, CASE WHEN s.pos = l.spot THEN l.c ELSE s.id END, l.spot IS NOT NULL
  FROM (SELECT word, pos, id FROM step WHERE live) s
  LEFT JOIN (
    SELECT word, min((m.c::BIGINT << 32) | p.pos) AS least, (least & 4294967295)::INTEGER AS spot, (least >> 32)::INTEGER AS c
    FROM (SELECT x.word, x.pos, x.id, y.id AS next FROM step x JOIN step y ON y.word = x.word AND y.pos = x.pos + 1 WHERE x.live AND y.live) p
    JOIN merges m ON m.a = p.id AND m.b = p.next
    GROUP BY word
  ) l ON l.word = s.word
  WHERE l.spot IS NULL OR s.pos <> l.spot + 1
)
SELECT word, id FROM step WHERE NOT live ORDER BY word, pos
"""
#: Contractions wherever a pair is the least within `reach` positions; of a run of equal neighbours the first, third and so on, as far as all before them in the run may go too.
BROAD = """
WITH RECURSIVE step(word, pos, id, live) AS (
  SELECT word, pos, id, true FROM start
  UNION ALL
  SELECT word, pos, CASE WHEN hit THEN c ELSE id END, alive
  FROM (
    SELECT word, pos, id, c, hit, alive, lag(hit, 1, false) OVER (PARTITION BY word ORDER BY pos) AS eaten
    FROM (
      SELECT word, pos, id, c, max(c) OVER (PARTITION BY word) IS NOT NULL AS alive,
             coalesce(bool_and(may) OVER run AND row_number() OVER run % 2 = 1, false) AS hit
      FROM (
        SELECT word, pos, id, c, may, sum(fresh::INTEGER) OVER (PARTITION BY word ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run
        FROM (
          SELECT word, pos, id, c, c IS DISTINCT FROM lag(c) OVER (PARTITION BY word ORDER BY pos) AS fresh,
                 c IS NOT NULL AND c = min(c) OVER (PARTITION BY word ORDER BY pos ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS may
          FROM (
            SELECT s.word, s.pos, s.id, m.c
            FROM (SELECT word, pos, id, lead(id) OVER (PARTITION BY word ORDER BY pos) AS next FROM step WHERE live) s
            LEFT JOIN merges m ON m.a = s.id AND m.b = s.next
          )
        )
      )
      WINDOW run AS (PARTITION BY word, run ORDER BY pos ROWS UNBOUNDED PRECEDING)
    )
  )
  WHERE NOT eaten
)
SELECT word, id FROM step WHERE NOT live ORDER BY word, pos
"""
DECODE = "SELECT piece, count(*) AS n, string_agg(bytes, '' ORDER BY pos) AS text FROM (SELECT piece, pos, bytes FROM ids JOIN letters USING (id)) GROUP BY piece ORDER BY piece"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token's bytes and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def kinds(library_pattern: str) -> np.ndarray:
    """For each code point whether the encoder library's Unicode tables have it in the class."""
    import tiktoken

    points = np.concatenate([np.arange(0xD800, dtype="<u4"), np.arange(0xE000, 0x110000, dtype="<u4")])
    text = points.tobytes().decode("utf-32-le")
    single = tiktoken.Encoding("bytes", pat_str=library_pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    out = np.zeros(0x110000, bool)
    for k in range(0, len(text), 1 << 16):  # what no match covers is left out
        out[np.frombuffer(single.decode(single.encode_ordinary(text[k : k + (1 << 16)])).encode("utf-32-le"), "<u4")] = True
    return out


class Splitter:
    """Words of the public byte-level pattern, found by classes of characters: contractions, runs of letters, numbers or other signs with a blank before them, blanks."""

    SHORT, LONG = ("s", "t", "m", "d"), ("re", "ve", "ll")

    def __init__(self):
        self.kind = np.zeros(0x110000, np.uint8)
        for k, p in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
            self.kind[kinds(p)] = k

    def starts(self, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where words start in the code points of texts that begin at bounds (the end of the last among them)."""
        n = len(points)
        if n == 0:
            return np.zeros(0, np.int64)
        kind, edge = self.kind[points], np.zeros(n + 1, bool)
        edge[bounds] = True
        change = edge[:n].copy()
        change[1:] |= kind[1:] != kind[:-1]
        blank = kind == BLANK
        last = np.empty(n, bool)  # a blank before something else, in the same text
        last[:-1], last[-1] = blank[:-1] & ~blank[1:], False
        last &= ~edge[1:]
        taken = np.zeros(n, bool)  # by the space before
        taken[1:] = (points[:-1] == 0x20) & ~edge[1:n]
        start = np.where(blank, change | last, change & ~taken)
        mark = np.flatnonzero(start & (points == 0x27))
        if len(mark):
            def at(k):
                inside = mark + k < n
                inside[inside] &= ~np.logical_or.reduce([edge[mark[inside] + j] for j in range(1, k + 1)])
                return np.where(inside, points[np.minimum(mark + k, n - 1)], 0)

            one, two = at(1), at(2)
            size = np.zeros(len(mark), np.int64)
            for s in self.SHORT:
                size[one == ord(s)] = 2
            for s in self.LONG:
                size[(one == ord(s[0])) & (two == ord(s[1]))] = 3
            mark, size = mark[size > 0], size[size > 0]
            start[mark + 1] = False
            after = mark + size
            start[after[after < n]] = True
        return np.flatnonzero(start)


class Merger:
    """The database of a vocabulary, and the ids of the words met so far."""

    def __init__(self, path: str):
        import duckdb
        import pyarrow as pa

        ranks = read_ranks(path)
        self.con = duckdb.connect()
        self.con.execute("SET threads = 1; SET memory_limit = '400MB'; SET preserve_insertion_order = false")
        self.con.register("given", pa.table({"id": pa.array(ranks.values(), pa.int32()), "hex": [t.hex() for t in ranks]}))
        self.con.execute(VOCAB)
        self.con.execute(MERGES)
        self.con.unregister("given")
        # bytes as characters of the same number, since tokens may end inside a character
        self.con.register("given", pa.table({"id": pa.array(ranks.values(), pa.int32()), "bytes": [t.decode("latin-1") for t in ranks]}))
        self.con.execute("CREATE TABLE letters AS SELECT id, bytes FROM given ORDER BY id")
        self.con.unregister("given")
        self.whole, self.reach = ranks, max(map(len, ranks))
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self._regular: bool | None = None
        self.forget()

    def forget(self) -> None:
        """Empty the cache: sorted hashes, and where each word's ids lie among all ids."""
        self.keys, self.first, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def query(self, sql: str, **tables):
        for name, t in tables.items():
            self.con.register(name, t)
        out = self.con.sql(sql).to_arrow_table()
        for name in tables:
            self.con.unregister(name)
        return out

    def contract(self, words: list[bytes], sql: str) -> list[np.ndarray]:
        """Ids of words, by a recursive query over their bytes."""
        import pyarrow as pa

        sizes = np.fromiter(map(len, words), np.int64, len(words))
        number = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        pos = (np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        got = self.query(sql, start=pa.table({"word": number, "pos": pos, "id": self.byte[np.frombuffer(b"".join(words), np.uint8)]}))
        number, ids = got["word"].to_numpy(), got["id"].to_numpy()
        return np.split(ids, np.searchsorted(number, np.arange(1, len(words))))

    @property
    def regular(self) -> bool:
        """Whether each token is built by merges of lower ranks alone, the last one giving the token itself."""
        if self._regular is None:
            import pyarrow as pa

            words = [t for t in self.whole if len(t) > 1]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            number = np.repeat(np.fromiter((self.whole[t] for t in words), np.int32, len(words)), sizes)
            pos = (np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            start = pa.table({"word": number, "pos": pos, "id": self.byte[np.frombuffer(b"".join(words), np.uint8)]})
            # words are numbered by their own id: a merge of a higher rank than that ends the check of its word
            out = self.query(NARROW.replace("GROUP BY word\n", "GROUP BY word HAVING min(m.c) <= word\n"), start=start)
            self._regular = out.num_rows == len(words) and bool((out["word"].to_numpy() == out["id"].to_numpy()).all())
        return self._regular

    def new_words(self, words: list[bytes]) -> list[np.ndarray]:
        out: list = [self.whole.get(w) for w in words]
        out = [x if x is None else np.array([x], np.int32) for x in out]
        for wide in (False, True):
            todo = [k for k, x in enumerate(out) if x is None and (len(words[k]) > WIDE) == wide]
            if todo:
                sql = BROAD.format(reach=self.reach) if wide and self.regular else NARROW
                for k, ids in zip(todo, self.contract([words[k] for k in todo], sql), strict=True):
                    out[k] = ids
        return out

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in order, and how many each word has."""
        keys, sample, back = np.unique(hash_words(data, starts, ends, fold=False), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHED:
            self.forget()
        spot = np.searchsorted(self.keys, keys)
        miss = np.ones(len(keys), bool)
        inside = spot < len(self.keys)
        miss[inside] = self.keys[spot[inside]] != keys[inside]
        if miss.any():
            at = sample[miss]
            got = self.new_words([data[a:b].tobytes() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            count = np.fromiter(map(len, got), np.int64, len(got))
            first = len(self.ids) + np.cumsum(count) - count
            self.ids = np.concatenate([self.ids, *got])
            self.first, self.count, self.keys = (np.insert(x, spot[miss], y) for x, y in ((self.first, first), (self.count, count), (self.keys, keys[miss])))
            spot = np.searchsorted(self.keys, keys)
        first, count = self.first[spot][back], self.count[spot][back]
        total = np.cumsum(count)
        return self.ids[np.arange(total[-1] if len(total) else 0) + np.repeat(first - (total - count), count)], count

    def decode(self, pieces: list[np.ndarray]) -> list[bytes]:
        """The bytes of each run of ids."""
        import pyarrow as pa

        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        if not sizes.sum():
            return [b""] * len(pieces)
        ids = np.concatenate(pieces).astype(np.int32)
        got = self.query(DECODE, ids=pa.table({"piece": np.repeat(np.arange(len(pieces), dtype=np.int32), sizes), "pos": np.arange(len(ids)), "id": ids}))
        if sum(got["n"].to_pylist()) != len(ids):
            raise ValueError("an id is not in the vocabulary")
        out = [b""] * len(pieces)
        for k, text in zip(got["piece"].to_pylist(), got["text"].to_pylist(), strict=True):
            out[k] = text.encode("latin-1")
        return out


def merger(path: str) -> Merger:
    if path not in _tools:
        _tools[path] = Merger(path)
    return _tools[path]


def splitter() -> Splitter:
    if "splitter" not in _tools:
        _tools["splitter"] = Splitter()
    return _tools["splitter"]


def pieces(data: np.ndarray, limit: int):
    """Cut a long text before blanks that follow a printable ASCII character, at every `limit` bytes or later."""
    at = 0
    while len(data) - at > limit:
        found, far = None, at + limit
        while found is None and far < len(data):
            part = data[far - 1 : far + limit]
            cuts = np.flatnonzero(((part[1:] == 0x20) | (part[1:] == 0x0A)) & (part[:-1] > 0x20) & (part[:-1] < 0x7F))
            found = far + int(cuts[0]) if len(cuts) else None
            far += limit
        if found is None:
            break
        yield data[at:found]
        at = found
    yield data[at:]


def encode_column(column, tools: Merger):
    """For each run of rows of an Arrow string column: the first row and a list of ids (arrays) of each."""
    split = splitter()
    for first, bounds, data in text_slices(column, SLICE):
        if len(data) > 2 * SLICE:  # longer than a slice, so a single text
            yield first, [np.concatenate([encode_slice(np.array([0, len(p)]), p, tools, split)[0] for p in pieces(data, SLICE)])]
        else:
            yield first, encode_slice(bounds, data, tools, split)


def encode_slice(bounds: np.ndarray, data: np.ndarray, tools: Merger, split: Splitter) -> list[np.ndarray]:
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), "<u4")
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    size[(points >= 0xDC80) & (points < 0xDD00)] = 1  # bytes that are no UTF-8
    place = np.concatenate([[0], np.cumsum(size)])
    starts = place[split.starts(points, np.searchsorted(place, bounds))]
    ends = np.append(starts[1:], len(data))[: len(starts)]
    ids, count = tools.look_up(data, starts, ends)
    total = np.concatenate([[0], np.cumsum(count)])
    return np.split(ids, total[np.searchsorted(starts, bounds[1:-1])])


def _encoder(path: str):
    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            for first, rows in encode_column(batch.column(1), merger(path)):
                ids = batch.column(0).slice(first, len(rows))
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(r) for r in rows], pa.int64()), pa.array([r.astype("<u4").tobytes() for r in rows], pa.binary())], ["id", "n_tokens", "ids"])

    return encode


def _decoder(path: str):
    def decode(batches):
        import pyarrow as pa

        tools = merger(path)
        for batch in batches:
            held, rows, size = [], [], 0

            def flush():
                texts = tools.decode(held)
                out, k = [], 0
                for n in rows:
                    out.append(b"".join(texts[k : k + n]))
                    k += n
                return out

            at = batch.schema.get_field_index("ids")
            done: list[bytes] = []
            for ids in batch.column(at):
                ids = np.frombuffer(ids.as_py() or b"", "<u4")
                cut = [ids[k : k + DECODED] for k in range(0, len(ids), DECODED)]
                held += cut
                rows.append(len(cut))
                size += len(ids)
                if size >= DECODED:
                    done += flush()
                    held, rows, size = [], [], 0
            done += flush()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.binary())], [*batch.schema.names, "decoded"])

    return decode


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Id, n_tokens and ids (little-endian unsigned 32-bit) of each row's text."""
    import public_tokenizers as public

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_encoder(path or public.path("byte_bpe_50k.tiktoken")), f"id {kind}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """`encoded` and then `decoded` in one worker with one database."""
    import public_tokenizers as public

    path = path or public.path("byte_bpe_50k.tiktoken")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind, encode, decode = rows.schema["id"].dataType.simpleString(), _encoder(path), _decoder(path)
    return rows.mapInArrow(lambda batches: decode(encode(batches)), f"id {kind}, n_tokens long, ids binary, decoded binary").withColumnRenamed("id", id_col)


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of `encoded` with a column `decoded`, the bytes of their ids."""
    import public_tokenizers as public

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return tokens.mapInArrow(_decoder(path or public.path("byte_bpe_50k.tiktoken")), f"{schema}, decoded binary")
