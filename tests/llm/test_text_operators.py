"""Encoding, packing, quality rules, licence scans and language ID against plain versions."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bidlake.llm import common, fertility, langid, license_scan, packing, piece_dropout
from bidlake.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = public.path("piece_bpe_32k.model")


def keys(n, seed=0):
    return np.arange(n, dtype=np.uint64) + np.uint64(seed)


def test_word_hashes_follow_the_words():
    import pyarrow as pa

    texts = ["A b  c\x0bd", None, "", "ü é x", "b A"]
    got = []
    for _, bounds, data in common.text_slices(pa.array(texts), limit=4):
        starts, ends, first = common.find_words(data, bounds)
        h = common.hash_words(data, starts, ends, fold=True)
        got += [h[first[i] : first[i + 1]].tolist() for i in range(len(bounds) - 1)]
    want = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    seen = {}
    for g, w in zip(sum(got, []), sum(want, []), strict=True):
        assert seen.setdefault(w, g) == g
    assert len(set(seen.values())) == len(seen)


TEXTS = ["", "Hello world", "  a  b\nhe llo 日本\t x ", "a" * 300, "\n\n \n", "naïve 😀😀 ü", " " * 40 + "x" * 70, "the quick brown fox " * 30]


def test_without_dropout_it_is_the_librarys_encoding():
    p, sp = piece_dropout.pieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert [g.tolist() for g in p.encode(TEXTS, keys(len(TEXTS)), 0.0)] == sp.encode(TEXTS)


def test_dropout_is_lossless_seeded_and_varied():
    p = piece_dropout.pieces(MODEL)
    texts = [*TEXTS, "▁ kept ▁"]
    a, b, c = (p.encode(texts, keys(len(texts), s), 0.3) for s in (1, 1, 1000))
    assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))
    assert sum(not np.array_equal(x, y) for x, y in zip(a, c, strict=True)) >= 4
    assert [p.decode(x.tolist()) for x in a] == texts
    assert len({tuple(x) for x in p.encode(["international"] * 50, keys(50), 0.3)}) > 5
    text = ["international " * 50]
    parts = "".join("|" + x.decode() for x in map(p.bytes.__getitem__, p.encode(text, keys(1), 0.3)[0].tolist())).split("| ")
    assert len(set(parts)) > 5  # repeated words vary within a text


def test_heap_and_matrix_agree(monkeypatch):
    p = piece_dropout.pieces(MODEL)
    a = p.encode(TEXTS, keys(len(TEXTS)), 0.2)
    monkeypatch.setattr(piece_dropout, "WIDE", 0)
    assert all(np.array_equal(x, y) for x, y in zip(a, p.encode(TEXTS, keys(len(TEXTS)), 0.2), strict=True))


def plain_dropout(p, text, key, rate):
    """The agenda by trying every pair again and again: ids of one text, in plain integers."""
    most = 2**64 - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & most
        x = (x ^ x >> 27) * 0x94D049BB133111EB & most
        return x ^ x >> 31

    out = []
    for ordinal, chunk in enumerate(re.findall(r"\n| +[^ \n]*|[^ \n]+", " " + text if text else "")):
        own = mixed((key + ordinal * 0x9FB21C651E98DF25) & most)
        symbols = [(int(p.char[ord(c)]), k) for k, c in enumerate(chunk)]
        while True:
            can = []
            for k, ((a, at), (b, _)) in enumerate(zip(symbols, symbols[1:], strict=False)):
                piece = p.pair.get((a, b))
                if piece is not None and mixed((own + at * 0xD6E8FEB86659FD93 + piece * 0xA0761D6478BD642F) & most) >= int(rate * 2**64):
                    can.append((int(p.place[piece]), k, piece))
            if not can:
                break
            _, k, piece = min(can)
            symbols[k : k + 2] = [(piece, symbols[k][1])]
        for s, _ in symbols:
            out += [s] if s < piece_dropout._UNKNOWN else [int(p.byte_id[b]) for b in chr(s - piece_dropout._UNKNOWN).encode()]
    return out


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 0.9])
def test_dropout_against_brute_force(rate):
    p = piece_dropout.pieces(MODEL)
    texts = [*TEXTS, "supercalifragilisticexpialidociousinternationalisation " * 2, "".join(chr(97 + k * k % 26) for k in range(90)), "日本語の文章です。" * 8, "a\n\nb  c"]
    got = p.encode(texts, keys(len(texts), 5), rate)
    assert [g.tolist() for g in got] == [plain_dropout(p, t, int(k), rate) for t, k in zip(texts, keys(len(texts), 5), strict=True)]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_text_comes_back(text):
    p = piece_dropout.pieces(MODEL)
    text = text.encode("utf-8", "ignore").decode()
    assert p.decode(p.encode([text], keys(1), 0.25)[0].tolist()) == text


def test_encoding_and_decoding_tables(docs, none, rows):
    e = piece_dropout.encoded(docs, seed=3)
    got = piece_dropout.decoded(e).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1] or "") for r in rows)
    assert piece_dropout.encoded(none).count() == 0


def check_packing(pieces, texts):
    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    ids = {k: np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], np.uint32) for k, t in texts.items()}
    by_doc, by_seq = {}, {}
    for r in pieces:
        assert bytes(r.ids) == ids[r.doc_id][r.start : r.start + r.length].tobytes() and r.doc_tokens == len(ids[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, v in by_doc.items():
        copies = sum(s == 0 for s, _ in v)
        assert sum(n for _, n in v) == copies * len(ids[k])
    assert set(by_doc) == set(ids)
    for v in by_seq.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0  # a power of two: nothing is padded


def test_packing(spark, docs, none, rows):
    check_packing(packing.packed(docs).collect(), {r[0]: r[1] for r in rows})
    assert packing.packed(none).count() == 0
    d = table(spark, "/root/testdata/sf0.001", "documents")
    check_packing(packing.packed(d).collect(), {r.doc_id: r.text for r in d.collect()})


def test_encoder_gives_the_ids_of_the_files_own_library():
    import random

    tok, enc = Tokenizer.from_file(public.path("byte_bpe_50k.json")), packing.encoder(public.path("byte_bpe_50k.json"), public.PATTERN)
    r = random.Random(3)
    parts = ["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "a", "The", "don't", "12", "é", "日本", "😀", "\t", "||", "\x00", "x" * 30]
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<<|endoftext|>>", *("".join(r.choices(parts, k=r.randrange(12))) for _ in range(5000))]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [64, 220, 50256, 275]
    assert [enc.encode_to_numpy(t, allowed_special="all").tolist() for t in texts] == want


def test_packing_in_small_blocks_gives_whole_documents(monkeypatch):
    shard = packing.Shard(0)
    g = np.random.default_rng(1)
    docs = [(i, np.arange(g.integers(1, 3000), dtype=np.uint32)) for i in range(300)]
    out = []
    for k in range(0, 300, 25):
        out += shard.block(docs[k : k + 25], last=k == 275)
    assert sum(r[2] for r in out) == sum(len(d[1]) for d in docs)
    tiers = Counter(r[7] for r in out)
    assert {1024, 512, 256} <= set(tiers)
    costs = {}
    for r in out:
        if r[7] == 1024:
            costs.setdefault(r[8], Counter())[r[5]] += r[2]
    assert all(len(c) <= 16 for c in costs.values())


def plain_counts(text):
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(grams)
    cover = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 8)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


def test_quality_counts(spark, docs, none, rows):
    texts = [r[1] or "" for r in rows]
    got = fertility.measured(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((r[0], *plain_counts(t)) for r, t in zip(rows, texts, strict=True))
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert fertility.measured(none).count() == 0
    assert fertility.keep_good(none).columns == none.columns
    kept = fertility.keep_good(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)


def test_cached_tokens_are_the_librarys():
    v = fertility.Vocabularies(MODEL, public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for t, (ids, multi) in zip(TEXTS, v.read(TEXTS), strict=True):
        assert ids.tolist() == [i for i in sp.encode(t) if i != v.newline]
        assert multi > 0 or not t


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\r\n", ";\r", "\u3000", "\xa0", "\x1c", "word", "'s", "12", "日本", "!", "é", " the"]), max_size=12).map("".join))
def test_chunks_give_both_libraries_counts(text):
    import tiktoken

    from bidlake.llm.recursive_bpe import read_ranks

    if "fertility" not in _kept:
        path = public.path("byte_bpe_multi_50k.tiktoken")
        _kept["fertility"] = fertility.Vocabularies(MODEL, path, public.PATTERN), sentencepiece.SentencePieceProcessor(model_file=MODEL), tiktoken.Encoding("m", pat_str=public.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    v, sp, multi = _kept["fertility"]
    ((ids, n),) = v.read([text])
    assert ids.tolist() == [i for i in sp.encode(text) if i != v.newline]
    assert n == len(multi.encode_ordinary(text))


_kept: dict = {}
BLANKS = [" ", "\t", "\n", " \n", "\u3000"]


@pytest.mark.parametrize("blank", BLANKS)
def test_long_blank_runs_give_the_librarys_ids(blank, monkeypatch):
    """Texts that the library can still encode, with the bound for cutting far below."""
    enc = packing.encoder(public.path("byte_bpe_50k.json"), public.PATTERN)
    run = blank * 1500
    for text in (run, run + "a b", "a b" + run, f"x{run}y {run}<|endoftext|>{run}z'{run}", run + "<|endoftext|>", f"<|endoftext|>{run}\r"):
        assert common.library_ids(enc, text).tolist() == enc.encode(text, allowed_special="all")


@pytest.mark.parametrize("blank", BLANKS[:3])
def test_three_million_blanks_are_packed_and_measured(spark, blank):
    n = 3_000_000
    texts = ["Some words. " + blank * n + "and the end of it", blank * n, "plain text of a few words"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    path = public.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    want = []
    for t in texts:  # by the file's own library, run by run: it keeps to the pattern's words in any length
        want.append([*tok.encode(t, add_special_tokens=False).ids, 0])
    got = {}
    for r in packing.packed(d).collect():
        got.setdefault(r.doc_id, {})[r.start] = bytes(r.ids)
    for k, ids in enumerate(want):
        assert b"".join(got[k][at] for at in sorted(got[k])) == np.array(ids, "<u4").tobytes()
    m = {r.doc_id: r for r in fertility.measured(d).collect()}
    assert [m[k].n_words for k in range(3)] == [7, 0, 6] and not any(m[k].kept for k in range(3))
    small = fertility.Vocabularies(MODEL, public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
    short = small.read([texts[0].replace(blank * n, blank * 2000)])[0]
    assert m[0].n_tokens >= len(short[0]) and fertility.keep_good(d).count() == 0


SCRIPTS = {
    "latin": "The committee will meet again next month to review the proposal and to decide about the budget of the coming year. ", "greek": "Η επιτροπή θα συνεδριάσει ξανά τον επόμενο μήνα για να εξετάσει την πρόταση και να αποφασίσει για τον προϋπολογισμό. ",
    "cyrillic": "Комитет снова соберётся в следующем месяце, чтобы рассмотреть предложение и принять решение о бюджете на будущий год. ", "hebrew": "הוועדה תתכנס שוב בחודש הבא כדי לבחון את ההצעה ולהחליט על התקציב של השנה הקרובה. ",
    "arabic": "ستجتمع اللجنة مرة أخرى في الشهر القادم لمراجعة الاقتراح واتخاذ قرار بشأن ميزانية العام المقبل. ", "indic": "समिति अगले महीने फिर बैठेगी ताकि प्रस्ताव की समीक्षा की जा सके और आने वाले वर्ष के बजट पर निर्णय लिया जा सके। ",
    "thai": "คณะกรรมการ จะประชุม อีกครั้ง ในเดือนหน้า เพื่อทบทวน ข้อเสนอ และตัดสินใจ เกี่ยวกับ งบประมาณ ของปีหน้า ", "hangul": "위원회는 다음 달에 다시 모여 제안을 검토하고 내년 예산에 대해 결정할 예정입니다. ",
    "kana": "いいんかいは らいげつ ふたたび あつまり ていあんを けんとうし らいねんの よさんについて きめる よていです。 ", "han": "委员会 将于 下个月 再次 开会 审议 这项 提案 并 决定 明年 的 预算 安排 和 具体 计划。 ",
}


def plain_measures(text):
    """Measures by the libraries over the whole text."""
    import base64
    import math

    import tiktoken

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    with open(public.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        multi = tiktoken.Encoding("plain", pat_str=public.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    ids = [i for i in sp.encode(text) if i != sp.piece_to_id("<0x0A>")]
    chars, n = len(text) - text.count("\n"), len(ids)
    tokens = len(multi.encode_ordinary(text))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values()) if n else None
    return n, chars / n if n else None, sum(sp.is_byte(i) for i in ids) / n if n else None, chars / tokens if tokens else None, (entropy / min(math.log2(n), fertility.TOP_BITS) if n > 1 else 0.0) if n else None


def test_measures_and_verdicts_against_brute_force(spark, rows):
    """Also every script: prose lies in its band, the same letters as noise of one word or in symbols don't."""
    texts = [r[1] or "" for r in rows] + list(SCRIPTS.values()) + [" ".join(t.split()[0] for _ in range(200)) for t in SCRIPTS.values()]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in fertility.measured(d).collect():
        n, *want = plain_measures(texts[r.doc_id])
        assert r.n_tokens == n
        for x, y in zip((r.chars_per_token, r.byte_share, r.chars_per_multi, r.entropy_share), want, strict=True):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-9), (r, want)
        inside = False
        if n:
            lo, hi, share, lo2, hi2, entropy = fertility.BANDS[r.script]
            inside = lo <= want[0] <= hi and want[1] <= share and lo2 <= want[2] <= hi2 and (n < fertility.MIN_TOKENS or want[3] >= entropy)
        words, *_, repeated = plain_counts(texts[r.doc_id])
        assert r.kept == (inside and not (words < 20 or 100 * repeated > 30 * words))
        k = r.doc_id - len(rows)
        if 0 <= k < len(SCRIPTS):
            assert r.script == list(SCRIPTS)[k] and inside, r
        elif k >= len(SCRIPTS):
            assert not r.kept


def test_small_cache_gives_the_same_tokens(monkeypatch):
    v = fertility.Vocabularies(MODEL, public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
    texts = [" ".join(f"word{k % 70} x{(k * i) % 90}" for k in range(100)) for i in range(1, 30)]
    want = [(i.tolist(), m) for i, m in v.read(texts)]
    monkeypatch.setattr(fertility, "CACHED", 40)
    small = fertility.Vocabularies(MODEL, public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
    assert [(i.tolist(), m) for i, m in small.read(texts)] == want
    assert len(small.cache) <= 200  # one text's chunks at most beyond the bound


def test_noise_is_rejected_and_prose_kept(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents").join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id")
    m = fertility.measured(d).join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("NOT base_failed").toPandas()
    assert m[m.quality == 1].kept.mean() > 0.99
    assert m[m.quality == 0].kept.mean() < 0.5


def naive_longest(words, templates, end):
    best = 0
    for t in templates:
        for n in range(best + 1, end + 2):
            w = words[end + 1 - n : end + 1]
            if any(t[k : k + n] == w for k in range(len(t) - n + 1)):
                best = n
    return best


def test_matching_statistics_are_the_longest_runs():
    a = license_scan.Automaton([("x", "a b c a b d"), ("y", "b c a b c"), ("z", "d a")])
    vocab = {w: int(a.known_words(license_scan._hashes([w]))[0]) for w in "abcd"}
    g = np.random.default_rng(3)
    for _ in range(200):
        words = [str(x) for x in g.choice(list("abcd"), 12)]
        state = n = 0
        for k, w in enumerate(words):
            c = vocab[w]
            while state and c not in a.next[state]:
                state = a.link[state]
                n = a.length[state]
            if c in a.next[state]:
                state, n = a.next[state][c], n + 1
            assert n == naive_longest(words, a.words, k)


def plain_base(text):
    w = license_scan.tokens(text)
    places, labels = [], set()
    for p, label in license_scan.BASE.items():
        p = p.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan(spark, docs, none, rows):
    for d in (docs, table(spark, "/root/testdata/sf0.001", "documents")):
        texts = Counter((r.doc_id, *plain_base(r.text or "")) for r in d.collect())
        got = license_scan.scanned(d).collect()
        assert texts == Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got)
        for r in got:
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert license_scan.scanned(none).count() == 0


def test_licence_texts_get_their_labels():
    text = "x y Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, and sell copies of the Software. z"
    hashes = license_scan._hashes(license_scan.tokens(text))
    a = license_scan.automaton()
    assert license_scan.scan(hashes, a)[5] == "mit"
    assert license_scan.scan(license_scan._hashes(license_scan.tokens("a licence of the software is free of charge to any person")), a)[5] == ""


def plain_spans(words, texts):
    """By label, the best cover of a chained span: every maximal match by comparing words, chained by trying every predecessor."""
    told, best = [license_scan.tokens(t) for _, t in texts], {}
    longest = []
    held = {tuple(t[j:k]) for t in told for j in range(len(t)) for k in range(j + 1, len(t) + 1)}
    for i in range(len(words)):
        longest.append(next((k for k in range(i + 1, 0, -1) if tuple(words[i - k + 1 : i + 1]) in held), 0))
    runs = [(i - n + 1, n) for i, n in enumerate(longest) if n >= license_scan.MIN_RUN and (i + 1 == len(words) or longest[i + 1] != n + 1)]
    for (label, _), t in zip(texts, told, strict=True):
        found = sorted((s, j, n) for s, n in runs for j in range(len(t) - n + 1) if t[j : j + n] == words[s : s + n])
        value = []
        for k, (s, j, n) in enumerate(found):
            most = n
            for (s0, j0, n0), (v0, first) in zip(found[:k], value, strict=True):
                over = max(0, s0 + n0 - s)
                if first <= s and over < n and s + over <= s0 + n0 + license_scan.GAP and j0 + n0 <= j + over <= j0 + n0 + license_scan.GAP:
                    most = max(most, v0 + n - over)
            # the first word of the chain, as the operator picks it
            first = next((f for (s0, j0, n0), (v0, f) in zip(found[:k], value, strict=True) if most > n and f <= s and (o := max(0, s0 + n0 - s)) < n and s + o <= s0 + n0 + license_scan.GAP and j0 + n0 <= j + o <= j0 + n0 + license_scan.GAP and v0 + n - o == most), s)
            value.append((most, first))
        best[label] = max([best.get(label, 0), *(v / len(t) for v, _ in value)])
    return {k: v for k, v in best.items() if v >= license_scan.COVER}


def test_labels_against_brute_force():
    import random

    r = random.Random(12)
    for trial in range(150):
        vocab = [f"w{k}" for k in range(r.choice([4, 12, 40]))]
        texts = [(f"l{k % 4}", " ".join(r.choices(vocab, k=r.randrange(4, 30)))) for k in range(6)]
        words = []
        for _ in range(r.randrange(1, 6)):
            part = license_scan.tokens(r.choice(texts)[1])
            for _ in range(r.randrange(3)):
                part[r.randrange(len(part))] = r.choice([*vocab, "zz"])
            words += part + r.choices([*vocab, "yy"], k=r.randrange(6))
        got = license_scan.scan(license_scan._hashes(words), license_scan.Automaton(texts))
        want = plain_spans(words, texts)
        assert got[5] == ",".join(sorted(want)), (trial, texts, words)
        assert abs(got[6] - min(1.0, max(want.values(), default=0.0))) < 1e-12


def test_twelve_open_chains():
    """A span is found however many chains of its template are open beside it."""
    parts = [f"a{k} b{k} c{k} d{k}" for k in range(40)]
    text = " ".join(parts)
    # the first part, then twelve later parts that open chains of their own, then the rest of the template, all within GAP words
    license = license_scan.Automaton([("x", f"{parts[0]} e f g h i j k l m n o p")])
    words = license_scan.tokens(f"{parts[0]} q e f g h i j k l m n o p")
    assert license_scan.scan(license_scan._hashes(words), license)[5] == "x"
    repeated = " ".join(["s t u", *(["v w x"] * 14), text])
    got = license_scan.scan(license_scan._hashes(license_scan.tokens(f"s t u v w x {text}")), license_scan.Automaton([("y", repeated)]))
    assert got[5] == "y" and got[6] > 0.75


def test_whole_licences():
    for label, text in license_scan.templates():
        words = license_scan._hashes(license_scan.tokens(text))
        got = license_scan.scan(words, license_scan.automaton())
        assert label in got[5].split(",") and got[6] == 1.0
    gpl = next(t for x, t in license_scan.templates() if x == "gpl-3.0" and len(t) > 20_000)
    words = license_scan.tokens(gpl)
    for k in range(0, len(words), 40):
        words[k] = "changed"
    got = license_scan.scan(license_scan._hashes(words), license_scan.automaton())
    assert "gpl-3.0" in got[5].split(",")


def test_every_templates_language_is_found():
    m = langid.Model(["a", "b"], {"a": np.arange(100, dtype=np.uint64), "b": np.arange(50, 150, dtype=np.uint64)}, bits=14)
    found = None
    for s in langid.slots(np.arange(50, 100, dtype=np.uint64), 14):
        found = m.tables[0][s] if found is None else found & m.tables[0][s]
    assert (found & 3 == 3).all()


def test_more_languages_than_a_word_has_bits(spark):
    # 70 made-up languages, each of its own three letters; the last ones have fewest documents
    of = lambda k: " ".join("".join(chr(0x4E00 + 3 * k + (i + j) % 3) for j in range(3)) for i in range(6))
    rows = spark.createDataFrame([(f"l{k:02d}", of(k)) for k in range(70) for _ in range(80 - k)], "lang string, text string")
    model, fallback = langid.fit(spark, rows)
    assert len(model.langs) == 70
    assert [model.predict(of(k), fallback)[0] for k in range(70)] == [f"l{k:02d}" for k in range(70)]


def test_texts_without_a_known_gram_go(spark):
    rows = spark.createDataFrame([("a", "red green blue " * 5)] * 9 + [("b", "rouge vert bleu " * 5)] * 9 + [(None, "\u65e5\u672c\u8a9e"), (None, "red blue green")], "lang string, text string")
    assert {r.text for r in langid.keep_known(spark, rows).collect()} == {"red green blue " * 5, "rouge vert bleu " * 5, "red blue green"}


def test_texts_in_no_learned_language_go(spark):
    rows = [("red green blue yellow " * 5, "a")] * 9 + [("rouge vert bleu jaune " * 5, "b")] * 9 + [("красный зелёный синий red " * 5, None), ("blue green yellow", None), ("1 2 3", "a"), (None, "a")]
    got = {r.text: r.lang for r in langid.keep_known(spark, spark.createDataFrame(rows, "text string, lang string")).collect()}
    assert got == {rows[0][0]: "a", rows[9][0]: "b", "blue green yellow": "a"}


def test_language_of_held_out_documents(spark, docs, none):
    d = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    model, fallback = langid.fit(spark, d.where(~langid.held_out()))
    got = langid.predict(spark, d.where(langid.held_out()), model, fallback).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    edge = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark, docs.select("doc_id", "text"), model, fallback).collect()}
    assert all(edge[k] == ("und", 0.0) for k in (2, 3, 4, 19)) and edge[1][0] == "en"
    assert langid.predict(spark, none.select("doc_id", "text"), model, fallback).count() == 0
    empty, fallback = langid.fit(spark, none)
    assert {r.lang_pred for r in langid.predict(spark, docs, empty, fallback).collect()} == {"und"}
    kept = langid.keep_known(spark, docs)
    assert kept.columns == docs.columns and not {2, 3, 4, 19} & {r.doc_id for r in kept.collect()}


def test_copies_count_once_in_the_sample(spark):
    """One text with thousands of copies takes one place of its language's sample."""
    import random

    r = random.Random(2)
    word = lambda s: "".join(r.choice(s) for _ in range(r.randrange(2, 8)))
    text = lambda s: " ".join(word(s) for _ in range(40))
    rows = [(text("abcdefg"), "xx") for _ in range(60)] + [(text("defghij"), "yy") for _ in range(60)] + [("gg hh ii " * 20, "xx")] * 3000
    model, _ = langid.fit(spark, spark.createDataFrame(rows, "text string, lang string"), sample_docs=40)
    got = [model.predict(text(s), "und")[0] for s in ["abcdefg"] * 40 + ["defghij"] * 40]
    assert got == ["xx"] * 40 + ["yy"] * 40


@pytest.mark.parametrize("text,want", [("", 0), ("ab", 3 + 2 + 1), ("a b", 2 * (2 + 1))])
def test_grams_stay_within_words(text, want):
    assert len(langid.gram_hashes(langid.letters(text))) == want


def plain_grams(text):
    """Every 2- to 4-gram of a text's letter runs with a blank at either end, none with a blank inside."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out = Counter()
    for run in re.findall(r"[^\W\d_]+", low):
        run = f" {run} "
        for n in (2, 3, 4):
            out.update(run[k : k + n] for k in range(len(run) - n + 1))
    return out


def gram_number(gram):
    points = np.array([0 if c == " " else ord(c) for c in gram], np.uint32)
    return int(langid.gram_hashes(points, (len(gram),))[0])


PROSE = {
    "aa": ["the committee will meet again next month to review the proposal", "they decided about the budget of the coming year", "a review of the proposal and the budget is planned"] * 3,
    "bb": ["der ausschuss tritt im nächsten monat wieder zusammen um den vorschlag zu prüfen", "sie haben über den haushalt entschieden", "eine prüfung ist für das kommende jahr geplant"],
    "cc": ["zqx"],
}


def test_filters_and_counts_against_exact_sets(spark, monkeypatch):
    """The filters hold the n-grams that a plain count chooses; corrected counts and verdicts agree with exact sets."""
    kept = {}
    real = langid.Model

    def model(langs, grams, *rest):
        kept.update(grams)
        return real(langs, grams, *rest)

    monkeypatch.setattr(langid, "Model", model)
    rows = [(i, t, lang) for i, (lang, t) in enumerate((k, t) for k, ts in PROSE.items() for t in ts)]
    m, _ = langid.fit(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {lang: sum((plain_grams(t) for t in ts), Counter()) for lang, ts in PROSE.items()}
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    exact = {}
    for lang, c in counts.items():
        need = min(5.0, max(1.0, sum(c.values()) / langid.FULL_SAMPLE * 5))
        mean = lambda g: sum(s.get(g, 0) for s in share.values())
        exact[lang] = {g for g, n in c.items() if n >= need and share[lang][g] * 3 >= 1.5 * mean(g) - 1e-12}
        assert {int(x) for x in kept[lang]} == {gram_number(g) for g in exact[lang]}
    for lang, ts in PROSE.items():
        for t in ts:
            grams = plain_grams(t)
            hits = {name: sum(n for g, n in grams.items() if g in s) for name, s in exact.items()}
            got, score, cover = m.predict(t, "none")
            assert got == lang == max(sorted(hits), key=hits.get)
            n = sum(grams.values())
            assert abs(cover * n - hits[got]) < 0.01 * n + 1 and abs(score - hits[got] / sum(hits.values())) < 0.02


def test_false_positives_are_corrected(spark):
    """With nearly full filters, corrected counts stay close to those of exact sets."""
    rng = np.random.default_rng(3)
    grams = {lang: rng.integers(0, 2**62, 1500).astype(np.uint64) for lang in ("p", "q")}
    m = langid.Model(["p", "q"], grams, bits=12)
    assert (m.rate > 0.1).all()
    text = rng.choice(grams["p"], 400)
    noise = rng.integers(0, 2**62, 4000).astype(np.uint64)
    h = np.concatenate([text, noise])
    hits = []
    for l in range(2):
        found = m.tables[0][next(iter(langid.slots(h, 12)))]
        for s in langid.slots(h, 12):
            found = found & m.tables[0][s]
        hits.append(np.count_nonzero(found & (1 << l)))
    true = [(x - r * len(h)) / (1 - r) for x, r in zip(hits, m.rate, strict=True)]
    assert abs(true[0] - 400) < 150 and abs(true[1]) < 150 and hits[1] > 400


def test_unlabelled_tables_stay_whole(spark):
    rows = [(i, "some words here", None) for i in range(5)]
    assert langid.keep_known(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string")).count() == 5
