"""Chat, WARC, the three dedups and the pipeline against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from bidlake.llm import chat, fertility, linededup, minhash, radix_dedup, warc
from bidlake.llm.common import Workspace, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# --- chat ---

TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, None, None, None), (2, 1, "assistant", "</s>[INST] x [/INST]"), (2, 1, "assistant", "</s>[INST] x [/INST]"), (3, 0, "tool:]x", "a\\b [/ROLE] \\l"),
    (4, 2, "system", " lead and trail "), (4, 1, "assistant", ""), (None, 0, "user", "no id"), (5, 0, "assistant", "é" * 50_000), (6, 0, "user", "[INST"), (6, 1, "user", "[/INST] <s>"),
    *((7, 0, "user", t) for t in ("a\t", "a", "a b", "a!", "[INST", "[/INST] z", "[ plain", "", "a \\\\ [BOT", "a \\\\ b")), (8, 0, "assistant", "b </s>"), (8, 0, "assistant", "b"), (8, 0, "assistant", "b\n"),
]


def plain_conversation(turns):
    said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
    loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_digests(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").repartition(3)
    segments = chat.formatted(chat.with_planted(spark, df))
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    planted = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    by = defaultdict(list)
    for t in [*TURNS, *planted]:
        by[t[0]].append(t)
    assert set(got) == set(by)
    whole = {r.conv_id: r.formatted for r in chat.conversations(segments).collect()}
    for k, turns in by.items():
        turns.sort(key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        r = got[k]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == plain_conversation(turns)
        assert r.formatted_chars == len(whole[k])
        assert [(a, b) for a, b, _, _ in chat.parse(whole[k])] == [(t[2] or "", t[3] or "") for t in turns]
    assert got[-7].n_escaped == 2 and got[1].n_escaped == 0
    assert chat.read_back(chat.formatted(df.limit(0))).count() == 0


def test_loss_mask_is_the_assistants_text(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    for r in chat.formatted(df).collect():
        assert (r.loss_start is None) == (r.role != "assistant")
        if r.loss_start is not None:
            body = r.segment[r.loss_start : r.loss_start + r.loss_length]
            assert r.segment == f"[BOT{'' if r.escaped is None else '*'}] {body} </s>"


def test_digest_follows_the_mask():
    """A mask over other text than the assistants' gives that text's digest."""
    d, shown = chat.Digest(), [("user", "one </s>"), ("assistant", "two")]
    for (role, text), masked in zip(shown, (True, False), strict=True):
        segment, _, start, length = chat.rendered(role, text)
        d.add(segment, *((start, length) if masked else (None, None)))
    assert d.row()[2:4] == (8, hashlib.sha256(b"one </s>").hexdigest())
    d = chat.Digest()
    with pytest.raises(ValueError):
        d.add(chat.rendered("user", "one")[0], 0, 5)


PARTS = st.lists(st.sampled_from(["[INST", "[/INST]", "</s>", "<s>", "\\", "[", "]", " ", "b", "l", "[ROLE:x] ", "*", "\n", "é"]), max_size=12).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), PARTS), PARTS), max_size=5))
def test_any_turns_come_back(turns):
    stream = "".join(chat.rendered(r, t)[0] for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.parse(stream)] == turns
    for step in (1, 3, 7):  # the borders come from the grammar, however the stream is cut
        reader = chat.Reader()
        got = [x for at in range(0, len(stream), step) for x in reader.feed(stream[at : at + step])]
        reader.close()
        assert [x[:2] for x in got] == turns and all(stream[x[2] : x[2] + len(x[3])] == x[3] for x in got)


@pytest.mark.parametrize("bad", ["x", "[INST] x", "[ROLE] x [/ROLE]", "[INST*] [SYS [/INST]", "[INST] [SYS [/INST]", "[INST", "[INST] a [/INST]b", "[INST] a [/INST][BOT"])
def test_parser_refuses(bad):
    with pytest.raises(ValueError):
        chat.parse(bad)


# --- WARC ---

PAGES = [(1, "http://a/é x\r\nEvil: 1", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://b", None), (4, "http://c", ""), (5, "http://d", "z" * 300_000), (6, "http://e", "WARC/1.1\r\n\r\n\x1f\x8b\x08 \r\n\r\n"), (7, "http://f", "日本"), (None, "http://g", "<p>same</p>"), (None, "http://h", "alone")]


def plain_warc(pages):
    import base64

    top = {}
    for i, _, h in pages:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", i))
    out = []
    for i, _, h in pages:
        p = (h or "").encode()
        t = top.get(h or "")
        many = sum((x[2] or "") == (h or "") for x in pages) > 1
        refers = t if many and t is not None and t != i else None
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if refers is None else "revisit", refers))
    return Counter(out)


def warc_rows(df):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    ws = Workspace(spark, "warctest")
    manifest = ws.cut(warc.write(pages, f"{ws.path}/archives"), "manifest")
    want = plain_warc(PAGES)
    for size in (64, 1000, 1 << 20):  # ranges that begin anywhere own each record once
        assert warc_rows(warc.read(manifest, size)) == want
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_warc_of_the_tables(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    assert warc_rows(warc.round_trip(spark, pages)) == plain_warc([(r.page_id, r.url, r.html) for r in pages.collect()])


def test_incompressible_payloads_hold_magic_bytes_inside(tmp_path):
    import random
    import zlib

    r = random.Random(5)
    noise = bytes(r.randrange(256) for _ in range(5000))
    inner = warc.record(99, "http://inner", b"nested", None, "2024-01-01T00:00:00Z")[:20]
    data = [warc.record(k, "http://x", noise + warc.MAGIC + inner[:6] + noise, None, "2024-01-01T00:00:00Z") for k in range(4)]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(data))
    starts = [sum(map(len, data[:k])) for k in range(4)]
    for step in (700, 3333, 10**6):
        got = [x[0] for at in range(0, path.stat().st_size, step) for x in warc.read_range(str(path), at, at + step)]
        assert got == starts
    assert zlib.decompress(data[0], 31).startswith(b"WARC/1.1")


# --- exact dedup ---


@pytest.mark.parametrize("first,widen", [(16, 16), (1, 2), (3, 3)])
def test_radix_classes(spark, docs, rows, first, widen):
    got = radix_dedup.radix_classes(spark, docs, first=first, widen=widen).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_radix_of_nothing(spark, none):
    assert radix_dedup.radix_classes(spark, none).count() == 0


# --- near dedup ---


def shingles(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))) if w else frozenset()


def plain_components(sets):
    """Smallest id reachable over links of 80 %, by comparing all pairs."""
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            k = len(a & b)
            if k and 100 * k >= 80 * (len(a) + len(b) - k):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_near_duplicates_of_edge_cases(spark, docs, rows, none):
    sets = {r[0]: shingles(r[1], 4) for r in rows if r[0] is not None}
    want = plain_components(sets)
    got = minhash.near_duplicates(spark, docs, width=4).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(spark, none).count() == 0


def test_near_duplicates_of_chains_and_crowds(spark):
    """A crowd of copies with few and many edits, chains, and texts that share one passage."""
    import random

    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    texts = []
    for k in range(150):
        w = list(base)
        for _ in range(k % 12):
            w[r.randrange(120)] = r.choice(["the", "of", word()])
        texts.append(w)
    chain = [word() for _ in range(100)]
    for k in range(12):
        texts.append(chain[k * 4 :] + [word() for _ in range(k * 4)])
    texts += [passage + [word() for _ in range(r.randrange(20, 90))] for _ in range(60)]
    r.shuffle(texts)
    d = {i: " ".join(t) for i, t in enumerate(texts)}
    want = plain_components({i: shingles(t, 4) for i, t in d.items()})
    got = minhash.near_duplicates(spark, spark.createDataFrame(list(d.items()), "doc_id long, text string"), width=4).collect()
    assert {x.doc_id: x.component_id for x in got} == want


def test_near_duplicates_loses_no_link_that_bands_miss(spark):
    """With two bands nearly no pair at the threshold meets in a bucket: what they miss is found all the same, for any number of bands."""
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    shared, texts = [word() for _ in range(20)], []
    for k in range(40):
        base = [word() for _ in range(60 + k)] + shared  # a common end, so that shingles of unlinked texts meet too
        for edits in (0, 1, 2, 3, 4):
            w = list(base)
            for _ in range(edits):
                w[r.randrange(len(w) - 20)] = word()
            texts.append(w)
    r.shuffle(texts)
    d = {i: " ".join(t) for i, t in enumerate(texts)} | {1000: "one two", 1001: "one two three", 1002: ""}
    want = plain_components({i: shingles(t, 4) for i, t in d.items()})
    got = minhash.near_duplicates(spark, spark.createDataFrame(list(d.items()), "doc_id long, text string"), width=4, bands=2).collect()
    assert {x.doc_id: x.component_id for x in got} == want


def test_few_candidates_do_not_shuffle_every_text(spark):
    """Sets of a few of many texts: their texts are shuffled, not all; too many ids for a broadcast."""
    import random

    def written():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    r = random.Random(3)
    rows = [(k, " ".join(f"{r.getrandbits(64):x}" for _ in range(120))) for k in range(2000)] + [(None, "a b c d"), (5, "another text of the id")]
    docs, ids = spark.createDataFrame(rows, "id long, text string"), spark.range(0, 2000, 40).toDF("id_")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        got = minhash._sets(docs, ids, 4).collect()
        moved = written() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert sorted(x.id for x in got) == list(range(0, 2000, 40))
    assert moved < sum(len(t) for _, t in rows) / 5  # the sets of a fortieth are a twentieth of that


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100)]
    got = minhash.components(spark, spark.createDataFrame(edges, "u long, v long"), Workspace(spark, "cc"), "t").collect()
    want = {i: 0 for i in range(1, 61)} | {101: 100, 102: 100}
    assert {r.id: r.component for r in got} == want


# --- line dedup ---


def corpus():
    import random

    r = random.Random(4)
    pool = [" ".join(r.choice(["ab", "cd", "ef", "gh"]) for _ in range(r.randrange(0, 14))) for _ in range(60)]
    docs = {}
    for i in range(40):
        lines = [r.choice(pool) for _ in range(r.randrange(1, 25))]
        if i > 3 and r.random() < 0.6:
            src = docs[r.randrange(i)].split("\n")
            a = r.randrange(len(src))
            lines[r.randrange(len(lines)) : 0] = src[a : a + r.randrange(1, 15)]
        docs[i] = "\n".join(lines)
    return docs


def test_repeated_runs_of_fifty_words_go(spark):
    run = [" ".join(f"w{i}x{k}" for k in range(9)) for i in range(6)]
    d = {1: "\n".join(["a b c", *run, "d"]), 2: "\n".join(["x", *run, "y z"]), 3: " ".join(f"long{k}" for k in range(60)), 4: "q\n" + " ".join(f"long{k}" for k in range(60)), 5: "only here"}
    got = {r.doc_id: r.text for r in linededup.deduplicated(spark, spark.createDataFrame(list(d.items()), "doc_id long, text string")).collect()}
    assert got == {1: d[1], 2: "x\ny z", 3: d[3], 4: "q", 5: d[5]}


def repeated_lines(docs, words):
    """By document, the lines with words in a run of so many words that an earlier place holds too; no fingerprints."""
    lines = {i: [(k, x, len(WORD.findall(x))) for k, x in enumerate(t.split("\n")) if WORD.search(x)] for i, t in docs.items()}
    order = [(i, p) for i in sorted(lines) for p in range(len(lines[i]))]
    by = defaultdict(list)
    for i, p in order:
        by[lines[i][p][1]].append((i, p))
    out = defaultdict(set)
    for i, p in order:
        for j, q in by[lines[i][p][1]]:
            if (j, q) >= (i, p):
                break
            a, b, n = lines[i], lines[j], 0
            while p + n < len(a) and q + n < len(b) and a[p + n][1] == b[q + n][1]:
                n += 1
            if sum(w for _, _, w in a[p : p + n]) >= words:
                out[i] |= {k for k, _, _ in a[p : p + n]}
    return out


def shared_runs():
    """Runs of twelve lines in two texts each, and a part of each alone in an earlier text; runs repeated inside a text; chains of parts."""
    import random

    r = random.Random(8)
    line = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(r.randrange(1, 11)))
    docs, runs = {}, [[line() for _ in range(12)] for _ in range(60)]
    for k, run in enumerate(runs):
        at = r.randrange(8)
        docs[k] = "\n".join([line(), *run[at : at + 5], line()])
        docs[100 + k] = "\n".join([line(), line(), *run, line()])
        docs[200 + k] = "\n".join([line(), *run, "", line(), *run[2:11]])
        docs[300 + k] = "\n".join([*run[3:], *runs[k - 1][:9], line(), *run[3:]])
    return docs


@pytest.mark.parametrize("make", ["shared_runs", "corpus"])
def test_no_repeated_run_is_left(spark, make):
    d = {"shared_runs": shared_runs, "corpus": corpus}[make]()
    got = {r.doc_id: r.text for r in linededup.deduplicated(spark, spark.createDataFrame(list(d.items()), "doc_id long, text string").repartition(3)).collect()}
    want, hit = repeated_lines(d, 2 * linededup.NOISE_WORDS), 0
    earlier = set()
    for i in sorted(d):
        was, now = d[i].split("\n"), iter([*got[i].split("\n"), None])
        stays, x = [], next(now)
        for k, y in enumerate(was):  # which lines stayed: what is deleted equals an earlier line, so the first of equal ones stays
            if x == y and k not in want[i]:
                stays.append(k)
                x = next(now)
        hit += len(want[i])
        assert x is None, (i, "a line of a repeated run stayed")
        assert all(was[k] in earlier or was[k] in was[:k] for k in set(range(len(was))) - set(stays)), i
        earlier |= set(was)
    assert hit > 50


def test_line_dedup_of_edge_cases(spark, docs, none, rows):
    got = linededup.deduplicated(spark, docs)
    assert got.columns == [*docs.columns, "__lines", "__deleted"]
    out = got.collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    by = {r.doc_id: r for r in out}
    assert by[2].text is None and by[3].text == "" and by[4].text == "   \n\t " and by[None].text == "without an id"
    assert by[7]["__deleted"] == 0 and by[8].text == "" and by[8]["__deleted"] == 4000
    assert linededup.deduplicated(spark, none).count() == 0


def longest_line_dedup(docs, noise, reach):
    """The definition, against every earlier place of a mark, pair by pair."""
    lines = {i: [(k, x, len(WORD.findall(x))) for k, x in enumerate(t.split("\n")) if WORD.search(x)] for i, t in docs.items()}
    h = lambda line: (lambda v: v - 2**64 if v >= 2**63 else v)(xxhash.xxh64(line.encode(), seed=42).intdigest())
    places = defaultdict(list)
    for i, ls in lines.items():
        wins = {}
        for p in range(len(ls)):
            for q in range(p, len(ls)):
                if sum(w for _, _, w in ls[p : q + 1]) >= noise:
                    wins[p] = tuple(x for _, x, _ in ls[p : q + 1])
                    break
        for p in {min((h(x), p + k) for k, x in enumerate(win))[1] for p, win in wins.items()} & set(wins):
            places[wins[p]].append((i, p))
    same = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    gone = defaultdict(set)
    for mark, at in places.items():
        for i, p in at:
            a = [x for _, x, _ in lines[i]]
            for j, q in (o for o in at if o < (i, p)):
                b, n = [x for _, x, _ in lines[j]], len(mark)
                back = same(a[max(0, p - reach) : p][::-1], b[max(0, q - reach) : q][::-1])
                gone[i] |= {lines[i][k][0] for k in range(p - back, p + n + same(a[p + n :][:reach], b[q + n :][:reach]))}
    return {i: ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]), len(gone[i])) for i, t in docs.items()}


@pytest.mark.parametrize("noise,reach", [(25, 50), (6, 12), (10, 3)])
def test_line_dedup_finds_the_longest_earlier_run(spark, noise, reach):
    d = corpus()
    got = linededup.deduplicated(spark, spark.createDataFrame(list(d.items()), "doc_id long, text string").repartition(3), noise=noise, reach=reach).collect()
    assert {r.doc_id: (r.text, r["__deleted"]) for r in got} == longest_line_dedup(d, noise, reach)


def test_line_dedup_beyond_the_earliest_place(spark):
    h = lambda line: xxhash.xxh64(line.encode(), seed=42).intdigest() ^ 2**63  # noqa: E731  ordered as signed
    # lines of ten words by their hash: the run's least is c3, and c5 and the lines around come before c4, c1 and c2
    pool = sorted((" ".join(f"{w}{i}" for w in "abcdefghij") for i in range(40)), key=h)
    c3, c5, before, c6, c4, c1, c2, x, y = pool[0], pool[1], pool[2:4], pool[10], pool[11], pool[12], pool[13], pool[30], pool[31]
    run = [c1, c2, c3, c4, c5, c6]
    d = {1: "\n".join([x, c3, c4, c5, y]), 2: "\n".join([before[0], *run, pool[32]]), 3: "\n".join([before[1], *run, pool[33]])}
    docs = spark.createDataFrame(list(d.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.deduplicated(spark, docs).collect()}
    assert got[3] == "\n".join([before[1], pool[33]])
    assert c1 in got[2] and c2 in got[2] and c6 in got[2]


# --- the pipeline ---


def test_pipeline_keeps_one_of_each_and_packs_whole_texts(spark, tmp_path):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    import corpus_pipeline

    table(spark, "/root/testdata/sf0.001", "documents").write.parquet(f"{tmp_path}/documents.parquet")
    docs, names = table(spark, str(tmp_path), "documents"), [n for n, _ in corpus_pipeline.STAGES]
    ws, seen = Workspace(spark, "test"), [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = ws.cut(stage(spark, seen[-1], str(tmp_path)), name)
        if name != names[-1]:
            assert out.columns == docs.columns
        seen.append(out)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and len(ids[-1]) > 100
    before = {r.doc_id: r.text for r in seen[2].collect()}
    lines = longest_line_dedup(before, linededup.NOISE_WORDS, linededup.REACH)
    assert {r.doc_id: r.text for r in seen[3].collect()} == {i: t for i, (t, _) in lines.items()}
    comp = plain_components({i: shingles(t, 5) for i, (t, _) in lines.items()})
    assert ids[4] == {i for i, c in comp.items() if i == c}
    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    total = sum(len(tok.encode(lines[i][0], add_special_tokens=False).ids) + 1 for i in ids[4])
    assert seen[-1].selectExpr("sum(length) AS n").first().n == total


def stage_by_stage(spark, docs):
    """What each stage of the pipeline returns on a table of edge cases."""
    import corpus_pipeline

    ws, out = Workspace(spark, "stages"), [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(ws.cut(stage(spark, out[-1], ""), name))
    return out


def test_stages_on_edge_cases(spark, docs, rows):
    """Nulls, repeated rows and extra columns with clashing names; every stage keeps the columns."""
    texts = [x.text for x in fertility.keep_good(table(spark, "/root/testdata/sf0.001", "documents")).where("length(text) BETWEEN 500 AND 1500 AND NOT text LIKE '%\\n%' AND lang = 'en'").orderBy("doc_id").collect()]
    first, other = texts[0], next(t for t in texts[1:] if not shingles(t, 5) & shingles(texts[0], 5))
    more = [(None, first, "en", "s", 1), (50, first, "en", "s", 1), (50, first, "en", "t", 1), (51, first, None, "s", 1), (52, other + " end", "en", "s", 1), (53, other, "en", None, 1), (54, "short tail", "en", "s", 1)]
    table_ = docs.unionByName(spark.createDataFrame([(*x, 99, "g", 1, 2, "l", "c") for x in more], docs.schema))
    quality, language, lines, near, packed = stage_by_stage(spark, table_)[1:]
    for d in (quality, language, lines, near):
        assert d.columns == docs.columns
    kept = Counter(x.doc_id for x in quality.collect())
    assert {50: 2, 51: 1, None: 1}.items() <= kept.items() and not {2, 3, 4, 18} & set(kept)
    assert {x.doc_id: x.lang for x in language.collect()}[51] == "en"
    assert lines.count() == language.count()
    assert {x.doc_id: x.text for x in lines.collect()}[51] == ""  # its one line is a later copy; the row stays
    ids = Counter(x.doc_id for x in near.collect())
    assert max(n for i, n in ids.items() if i is not None) == 1 and ids[None] == 1 and {50, 51} <= set(ids) and len({52, 53} & set(ids)) == 1
    assert {x.doc_id for x in packed.select("doc_id").distinct().collect()} == set(ids)


def test_stages_on_nothing(spark, none):
    for d in stage_by_stage(spark, none):
        assert d.count() == 0


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from bidlake.llm import common

    def session(master, conf=None, checkpoint=None):
        sc = SimpleNamespace(master=master, getConf=lambda: {}, getCheckpointDir=lambda: checkpoint)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: conf), sparkContext=sc)

    assert common.shared_dir(session("yarn", conf="hdfs:///x/")) == "hdfs:///x"
    assert common.shared_dir(session("spark://h:7077", checkpoint="s3a://b/c")) == "s3a://b/c"
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            common.shared_dir(session(master))
