"""Centroid clustering, vector codes and recursive byte-pair encoding against plain versions."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from bidlake.llm import delta_lloyd, heap_lloyd, queries, recursive_bpe
from bidlake.llm.common import table

VECTORS = "vec_id long, embedding array<float>, label int, id long, vec string, owner int, error string, labels string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def usable(row, dims=64):
    v = row[1]
    return v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)


def plain_lloyd(rows, k=16, rounds=3, scale=64, dims=64):
    """[(vec_id, cluster, distance, cluster inertia, inertia, centroid digest)] by whole passes in plain integers."""
    pts = [(i, tuple(math.floor(scale * x) for x in v)) for i, v, *_ in rows if usable((i, v), dims)]
    start = sorted(((sha(f"1:{i}"), v) for i, v in pts if i is not None))[:k]
    centroids = [v for _, v in start]

    def assign():
        out = []
        for _, v in pts:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        members = defaultdict(list)
        for (_, v), (c, _) in zip(pts, assign(), strict=True):
            members[c].append(v)
        centroids = [tuple(sum(x) // len(members[j]) for x in zip(*members[j], strict=True)) if members[j] else c for j, c in enumerate(centroids)]
    got = assign()
    by = Counter()
    for c, d in got:
        by[c] += d
    digest = [sha(",".join(map(str, c))) for c in centroids]
    return sorted(((i, c, d, by[c], sum(by.values()), digest[c]) for (i, _), (c, d) in zip(pts, got, strict=True)), key=repr)


def plain_codes(rows, positions=16, entries=64, rounds=2, scale=256, dims=64):
    pts = [(i, lab, [math.floor(scale * x) for x in v]) for i, v, lab, *_ in rows if usable((i, v), dims)]
    size = dims // positions
    start = [v for _, v in sorted((i, v) for i, _, v in pts if i is not None)[:entries]]
    books = [[v[p * size : (p + 1) * size] for v in start] for p in range(positions)]

    def assign(v, p):
        d = [sum((a - b) ** 2 for a, b in zip(v[p * size : (p + 1) * size], e, strict=True)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(positions):
            members = defaultdict(list)
            for _, _, v in pts:
                members[assign(v, p)[0]].append(v[p * size : (p + 1) * size])
            books[p] = [[sum(x) // len(members[j]) for x in zip(*members[j], strict=True)] if members[j] else e for j, e in enumerate(books[p])]
    out, by = [], Counter()
    for i, lab, v in pts:
        got = [assign(v, p) for p in range(positions)]
        error = sum(d for _, d in got)
        by[lab] += error
        out.append((i, lab, "".join(f"{c:02x}" for c, _ in got), error))
    digest = sha(",".join(str(x) for b in books for e in b for x in e))
    return sorted(((i, c, e, by[lab], digest) for i, lab, c, e in out), key=repr)


def edge_rows(seed, n=260):
    rnd = random.Random(seed)
    base = [[rnd.gauss(0, 1) for _ in range(64)] for _ in range(12)]
    rows = [(i, [x + rnd.gauss(0, 0.2) for x in rnd.choice(base)], rnd.choice([None, 1, 2, 3])) for i in range(n)]
    rows += [(1000 + i, [0.5] * 64, 7) for i in range(90)]  # a crowd of ties
    rows += [(5, rows[5][1], 1), (5, rows[5][1], 1), (6, rows[7][1], 2)]  # repeated rows and ids
    rows += [(None, rows[9][1], None), (None, [0.25] * 64, 4), (2001, None, 1), (2002, [0.1] * 63, 1), (2003, [0.1] * 63 + [None], 1), (2004, [0.1] * 63 + [float("nan")], None), (2005, [float("inf")] + [0.0] * 63, 1), (2006, [], 1), (2007, [-0.001] * 64, 1)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "e", "l") for r in rows], VECTORS).repartition(3)


def lloyd_rows(spark, df, **kw):
    rows, centroids = delta_lloyd.clustered(spark, df, **kw)
    out = delta_lloyd.with_inertia(spark, rows, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_delta_lloyd_against_whole_passes(spark, seed):
    rows = edge_rows(seed)
    assert lloyd_rows(spark, frame(spark, rows)) == plain_lloyd(rows)


@pytest.mark.parametrize("k, rounds", [(1, 2), (5, 6), (400, 3)])
def test_delta_lloyd_with_other_numbers(spark, k, rounds):
    rows = edge_rows(3, 60)
    assert lloyd_rows(spark, frame(spark, rows), k=k, rounds=rounds) == plain_lloyd(rows, k=k, rounds=rounds)


def test_lloyd_of_nothing(spark):
    for rows in ([], [(1, None, 1), (2, [1.0], 2)]):
        assert lloyd_rows(spark, frame(spark, rows)) == []
        out, _, _ = heap_lloyd.compressed(spark, frame(spark, rows))
        assert heap_lloyd.with_label_error(spark, out).collect() == []


def test_lloyd_of_rows_without_ids(spark):
    rows = [(None, [float(k)] * 64, None) for k in range(4)]
    assert [r[1:3] for r in lloyd_rows(spark, frame(spark, rows))] == [(k, 0) for k in range(4)]
    out, _, _ = heap_lloyd.compressed(spark, frame(spark, rows))
    assert [r.error for r in out.collect()] == [0] * 4


def test_huge_components_are_cut(spark):
    rows = [(1, [3e38] * 64, 1), (2, [-3e38] * 64, 1), (3, [0.0] * 64, 2)]
    assert [r[2] for r in lloyd_rows(spark, frame(spark, rows), k=2, rounds=1)] == lloyd_rows_cut(rows)


def lloyd_rows_cut(rows):
    cut = [(i, [max(-(2.0**21), min(2.0**21, x)) for x in v], lab) for i, v, lab in rows]
    return [r[2] for r in plain_lloyd(cut, k=2, rounds=1)]


def test_only_what_moved_is_compared(monkeypatch):
    """A vector whose owner stays is held against the moved centroids alone."""
    rng = np.random.default_rng(5)
    x, c = rng.integers(-50, 50, (500, 8)), rng.integers(-50, 50, (10, 8))
    owner, known = delta_lloyd.reassign(x, np.full(500, -1), np.zeros(500, np.int64), c, np.ones(10, bool))
    moved = np.zeros(10, bool)
    moved[[2, 7]] = True
    new = c.copy()
    new[moved] += rng.integers(-20, 20, (2, 8))
    done = []
    real = delta_lloyd.distances
    monkeypatch.setattr(delta_lloyd, "distances", lambda a, b: done.append(len(a) * len(b)) or real(a, b))
    got, near = delta_lloyd.reassign(x, owner, known, new, moved)
    d = real(x, new)
    assert (got == d.argmin(1)).all() and (near == d.min(1)).all()
    stale = int(moved[owner].sum())
    assert sum(done) == stale * 10 + (500 - stale) * 2


def test_distances_of_large_values_are_exact():
    x, c = np.array([[1 << 27, -(1 << 27)], [3, 4]]), np.array([[-(1 << 27), 1 << 27], [0, 0]])
    assert delta_lloyd.distances(x, c).tolist() == [[2 << 56, 2 << 54], [(3 + 2**27) ** 2 + (4 - 2**27) ** 2, 25]]


@pytest.mark.parametrize("seed, block", [(1, 2048), (2, 37)])
def test_codes_against_whole_passes(spark, monkeypatch, seed, block):
    monkeypatch.setattr(heap_lloyd, "BLOCK", block)
    rows = edge_rows(seed)
    out, books, looked = heap_lloyd.compressed(spark, frame(spark, rows))
    out = heap_lloyd.with_label_error(spark, out)
    got = sorted(((r.vec_id, r.code, r.error, r.label_error, heap_lloyd.codebooks_digest(books)) for r in out.collect()), key=repr)
    assert got == plain_codes(rows)
    assert looked[0] == 16 * len(got)


def test_codes_of_many_rounds_and_few_entries(spark):
    rows = edge_rows(4, 120)
    out, books, looked = heap_lloyd.compressed(spark, frame(spark, rows), entries=5, rounds=6)
    out = heap_lloyd.with_label_error(spark, out)
    got = sorted(((r.vec_id, r.code, r.error, r.label_error, heap_lloyd.codebooks_digest(books)) for r in out.collect()), key=repr)
    assert got == plain_codes(rows, entries=5, rounds=6)
    assert looked[-1] < looked[0] / 2  # late rounds move little, so few parts are popped


def test_salted_labels_give_the_same_sums(spark, monkeypatch):
    out, _, _ = heap_lloyd.compressed(spark, frame(spark, edge_rows(1)))
    few = sorted(map(tuple, heap_lloyd.with_label_error(spark, out).collect()), key=repr)
    monkeypatch.setattr(heap_lloyd, "FEW_LABELS", 0)
    many = heap_lloyd.with_label_error(spark, out)
    assert sorted(map(tuple, many.select("vec_id", "label", "code", "error", "label_error").collect()), key=repr) == few


def test_heaps_pop_what_the_drift_has_reached():
    rng = np.random.default_rng(2)
    owner, keys = rng.integers(0, 5, 200), rng.random(200)
    heap = heap_lloyd.Heaps.of(owner, keys, np.arange(200), 5)
    drift = np.array([0.0, 0.2, 0.5, 2.0, -1.0])
    out, rest = heap.pop(drift)
    assert sorted(out.tolist()) == [k for k in range(200) if keys[k] <= drift[owner[k]]]
    again = rest.push(owner[out], keys[out], out)
    assert (again.owners() == owner).all() and (again.keys == heap.keys).all()
    for a, b in zip(np.cumsum(again.sizes) - again.sizes, np.cumsum(again.sizes), strict=True):
        part = again.keys[a:b]
        assert all(part[(k - 1) // 2] <= part[k] for k in range(1, len(part)))


def test_vector_queries_on_the_tables(spark):
    data = table(spark, "/root/testdata/sf0.001", "embeddings")
    rows = [(r.vec_id, r.embedding, r.label) for r in data.collect()]
    got = queries.op11_delta_lloyd(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect()), key=repr) == plain_lloyd(rows)
    got = queries.op13_heap_lloyd(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect()), key=repr) == plain_codes(rows)


# --- byte-pair encoding ---------------------------------------------------------------------------

PATHS = [public.path("byte_bpe_50k.tiktoken"), public.path("byte_bpe_multi_50k.tiktoken")]


@pytest.fixture(scope="module", params=PATHS)
def both(request):
    ranks = recursive_bpe.read_ranks(request.param)
    return recursive_bpe.merger(request.param), tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(texts, tools):
    import pyarrow as pa

    return [r.tolist() for _, rows in recursive_bpe.encode_column(pa.array(texts, pa.string()), tools) for r in rows]


ALPHABET = "abst'remvldZé 0٣\n\t 　日本😀.,-'\x1c\x85 ŀ"


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(st.text(ALPHABET, max_size=30), st.text(st.characters(exclude_categories=["Cs"]), max_size=30)), max_size=4))
def test_any_text_is_encoded_as_the_library_does(texts):
    tools = recursive_bpe.merger(PATHS[0])
    enc = _library(PATHS[0])
    got = encode(texts, tools)
    assert got == [enc.encode_ordinary(t) for t in texts]
    assert tools.decode([np.array(g, np.int32) for g in got]) == [t.encode() for t in texts]


def _library(path, cache={}):  # noqa: B006
    if path not in cache:
        cache[path] = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=recursive_bpe.read_ranks(path), special_tokens={})
    return cache[path]


def test_each_token_is_built_by_lower_merges(both):
    assert both[0].regular


def test_irregular_vocabularies_are_seen(tmp_path):
    import base64

    tokens = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 260, b"bcd": 270, b"cd": 256}
    path = tmp_path / "odd"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in tokens.items()))
    tools = recursive_bpe.Merger(str(path))
    assert not tools.regular
    enc = tiktoken.Encoding("odd", pat_str=public.PATTERN, mergeable_ranks=tokens, special_tokens={})
    texts = ["abcd" * 100, "abcabcd", "bcdcdab" * 70]
    assert encode(texts, tools) == [enc.encode_ordinary(t) for t in texts]


def test_wide_words(both):
    tools, enc = both
    rnd = random.Random(4)
    texts = [
        "x" * 20_001, "ab" * 3000 + "c" * 1001, "x" * 3001 + "ab" + "x" * 2000 + "yx" * 777, "-" * 1200 + "=" * 999 + "-=" * 500, "thequickbrownfoxinternationalization" * 60,
        "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000)), "".join(rnd.choice("xyab") for _ in range(5000)), "".join(rnd.choice("日本語文章です") for _ in range(1500)), "".join(rnd.choice("=-_*#") for _ in range(4000)), "0123456789" * 300,
    ]
    assert encode(texts, tools) == [enc.encode_ordinary(t) for t in texts]


def test_narrow_and_broad_rounds_agree(both, monkeypatch):
    tools, enc = both
    words = [w.encode() for w in ("internationalization", "aaaaaaaaaaaa", "ababababa", "xxxyxxxyxx", "---===---", "日本語です", "zzzzqqqqzzzz")]
    want = [enc.encode_ordinary(w.decode()) for w in words]
    assert [x.tolist() for x in tools.contract(words, recursive_bpe.NARROW)] == want
    assert [x.tolist() for x in tools.contract(words, recursive_bpe.BROAD.format(reach=tools.reach))] == want


@pytest.mark.parametrize("blank", [" ", "\t", "\n"])
def test_three_million_blanks(blank):
    tools, enc = recursive_bpe.merger(PATHS[0]), _library(PATHS[0])
    small = encode([blank * 999 + "z"], tools)[0]
    assert small == enc.encode_ordinary(blank * 999 + "z")
    got = encode(["a" + blank * 3_000_000], tools)[0]
    assert tools.decode([np.array(got, np.int32)]) == [b"a" + blank.encode() * 3_000_000]
    whole = Counter(enc.encode_ordinary(blank * 4096))
    assert set(Counter(got)) <= set(whole) | set(small) | {enc.encode_ordinary("a")[0]}


def test_long_texts_are_cut_where_words_end(monkeypatch):
    text = table_text()
    tools, enc = recursive_bpe.merger(PATHS[0]), _library(PATHS[0])
    want = enc.encode_ordinary(text)
    for limit in (64, 1000):
        monkeypatch.setattr(recursive_bpe, "SLICE", limit)
        assert encode([text, None, text], tools) == [want, [], want]


def table_text():
    import duckdb

    return "".join(r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id LIMIT 20").fetchall()) + "don't 'tis we'll x  \n\n y" * 20


def test_a_small_cache_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(recursive_bpe, "CACHED", 50)
    monkeypatch.setattr(recursive_bpe, "SLICE", 300)
    tools = recursive_bpe.Merger(PATHS[0])
    texts = [f"word{i % 7} and thing{i} " * 3 for i in range(60)]
    assert encode(texts, tools) == [_library(PATHS[0]).encode_ordinary(t) for t in texts]


def test_encoded_and_decoded_tables(spark, docs, none, rows):
    got = recursive_bpe.decoded(recursive_bpe.encoded(docs)).collect()
    assert Counter(map(repr, got)) == Counter(map(repr, recursive_bpe.round_trip(docs).collect()))
    want = Counter((r[0], tuple(_library(PATHS[0]).encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in rows)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded)) for r in got) == want
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)
    assert recursive_bpe.decoded(recursive_bpe.encoded(none)).count() == 0


def test_unknown_ids_are_refused():
    with pytest.raises(ValueError):
        recursive_bpe.merger(PATHS[0]).decode([np.array([50_300], np.int32)])


def test_recursive_query_on_the_tables(spark):
    got = {r.doc_id: r[1:] for r in queries.op12_recursive_bpe(spark, "/root/testdata/sf0.001").collect()}
    for r in table(spark, "/root/testdata/sf0.001", "documents").collect():
        ids = _library(PATHS[0]).encode_ordinary(r.text or "")
        assert got[r.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(r.text or ""))
