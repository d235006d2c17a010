"""Pure functions, sources and streams on small cases of our own."""

import zipfile

import pytest
from pyspark.sql import functions as F

from bidlake.functions import scalars
from bidlake.operators.filters import closed_reason, in_region, is_open
from bidlake.plans.domain import priced, retrieval_metrics, stock_check
from bidlake.plans.rewrites import ancestors, prefix_join, similar
from bidlake.sources import ingest
from bidlake.streaming import incremental


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_spellings_and_terms(spark):
    spelt, term = lambda t: one(spark, scalars.spellings(F.lit(t))), lambda t: one(spark, scalars.canonical(F.lit(t).cast("string")))
    assert spelt("kabel")[:2] == ["kabel", "кабел"]
    assert spelt("стол") == ["стол", "stol", "cтoл"] and spelt("tsc") == ["tsc", "цц", "цк", "тсц", "тск"]
    assert len(spelt("cccccc")) == 6 and spelt(" ") == [] and spelt("5") == ["5"]
    assert term("Kabellar") == term("кабеллар") == term("kabel") and term("Коммутаторы") == term("Kommutatorlar") == term("kommutator")
    assert term("stolb") != term("stul") and term("monitor") != term("monitoring") and term(None) is None


def test_chunks_cover_the_text_and_point_into_it(spark):
    cut = lambda t: one(spark, scalars.chunks(F.lit(t).cast("string")))
    text = ("A sentence of some length. " * 30 + "\n\n") * 8
    parts = cut(text)
    assert all(text[c["start"] : c["end"]] == c["text"] and len(c["text"]) <= scalars.CHUNK for c in parts)
    assert parts[0]["start"] == 0 and parts[-1]["end"] == len(text)
    assert all(b["start"] == a["end"] - scalars.OVERLAP for a, b in zip(parts, parts[1:], strict=False))
    assert parts[0]["text"].endswith("\n\n") and parts[1]["text"].endswith((". ", "\n\n"))
    assert cut(None) == [] and cut("") == [] and cut(" \n ") == [] and [c["text"] for c in cut("tiny")] == ["tiny"]
    assert [(c["start"], c["end"]) for c in cut("x" * 2000)] == [(0, 1000), (850, 1850), (1700, 2000)]


def test_excerpts_merge_and_keep_the_budget(spark):
    take = lambda t, **k: one(spark, scalars.excerpts(F.lit(t).cast("string"), ["key", "zz zz"], pad=40, **k))
    text = "x" * 100 + "key" + "y" * 30 + "key" + "w" * 500 + "key"
    got = take(text)
    assert got.text == f"…{text[60:173]}…\n---\n…{text[596:639]}" and got.used == 113 + 43
    assert take(text, budget=120).text == f"…{text[60:173]}…\n---\n…{text[596:603]}" and take(text, budget=100).used == 100
    assert tuple(take(None)) == (0, "") and tuple(take("a  b\n\n\n\nc ")) == (6, "a b\n\nc")


@pytest.mark.parametrize("text,want", [("3 000.00 t", 3000.0), ("12,5 kg", 12.5), ("10-15", None), ("2x3", None), ("", None), ("abc", None), ("7", 7.0)])
def test_amounts(spark, text, want):
    got = one(spark, scalars.amount(F.lit(text)))
    assert (None if got is None else float(got)) == want


def test_money_rounds_half_away_from_zero(spark):
    assert one(spark, scalars.round2(F.lit(1.005))) == 1.01 and one(spark, scalars.round2(F.lit(-2.675))) == -2.68


def test_price_steps(spark):
    df = spark.createDataFrame([(650.0, 1000.0), (100.0, None)], "cost double, budget double")
    a, b = priced(df, "cost", 10.0, 5.0, 20.0, 12.0, "budget").collect()
    assert (a.logistics, a.risk, a.total, a.ex_vat, a.vat, a.final, a.left) == (65.0, 32.5, 747.5, 897.0, 107.64, 1004.64, -4.64)
    assert b["left"] is None


def test_stock_pool_is_empty_after_a_short_position(spark):
    pos = spark.createDataFrame([(1, 1, n, n, "bolt", u, a) for n, u, a in [(1, "kg", 4.0), (2, "dona", 9.0), (3, "kg", None), (4, "kg", 8.0), (5, "kg", 1.0)]], "tender_id long, lot_id int, good_no int, part_id long, name string, unit string, amount double")
    pro = spark.createDataFrame([(7, "bolt", "kg", 10.0)], "product_id long, name string, unit string, stock_qty double")
    got = {r.good_no: (r.taken, r.state) for r in stock_check(pos, pro).collect()}
    assert got == {1: (4.0, "enough"), 2: (0.0, "unit_differs"), 3: (0.0, "unknown_need"), 4: (6.0, "short"), 5: (0.0, "short")}


def test_open_and_regions(spark):
    t = spark.createDataFrame([("open", None, "33.2"), ("open", "1999-01-01", "33.21"), ("open", "1990-01-01", "33.2.1"), ("closed", None, None)], "status string, close_at string, area string").withColumn("close_at", F.to_timestamp("close_at"))
    got = t.select(is_open().alias("o"), in_region(F.col("area"), ["33.2"]).alias("r"), closed_reason().alias("c")).collect()
    assert [r.o for r in got] == [True, True, False, False] and [r.r for r in got] == [True, False, True, None]
    assert [r.c for r in got] == [None, None, "deadline", "status:closed"]


def test_prefix_join_is_an_equi_join(spark):
    left = spark.createDataFrame([(1, "33.2.1"), (2, "33.21"), (3, None)], "id int, path string")
    right = spark.createDataFrame([("33.2", "two"), ("33", "all")], "code string, name string")
    got = {(r.id, r.name) for r in prefix_join(left, "path", right, "code", "left").collect()}
    assert got == {(1, "two"), (1, "all"), (2, "all"), (3, None)}
    assert one(spark, ancestors(F.lit("a.b.c"))) == ["a", "a.b", "a.b.c"]


def test_trigram_similarity(spark):
    a = spark.createDataFrame([(1, "steel bolt"), (2, "glass")], "id int, t string")
    b = spark.createDataFrame([(9, "steel bolts"), (8, "xx")], "id int, t string")
    assert [(r.lid, r.rid) for r in similar(a, "id", "t", b, "id", "t", 0.5).collect()] == [(1, 9)]


def test_metrics_are_null_where_nothing_is_relevant(spark):
    found = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 1)], "q string, id int, rank int")
    rel = spark.createDataFrame([("a", 2)], "q string, id int")
    got = {r.q: r for r in retrieval_metrics(found, rel, 2).collect()}
    assert (got["a"].recall, got["a"].precision, got["a"].mrr) == (1.0, 0.5, 0.5) and got["b"].recall is None


def test_html_and_archives(tmp_path, spark):
    assert ingest.html_text("<p>a</p><script>b</script><p>c &amp; d</p>") == "a\nc & d"
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("x.txt", "plain text that is long enough to read")
        z.writestr("d.html", "<p>page</p>")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>document words are here for all to see</w:t></w:p>")
    (tmp_path / "p.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "t.txt").write_bytes("привет всем, это текст файла".encode("cp1251"))
    got = {r.path.rpartition("/")[2]: r for r in ingest.extracted(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got["f.zip"].text == "plain text that is long enough to read\npage" and got["f.zip"].state == "ok"
    assert got["d.docx"].kind == "docx" and got["d.docx"].text.startswith("document words") and got["p.pdf"].state == "unsupported"
    assert got["t.txt"].text.startswith("привет") and got["t.txt"].state == "ok"


def test_catalogue_file(tmp_path, spark):
    path = tmp_path / "c.csv"
    path.write_text("comment\nNomi;Sotuv narxi;Kategoriya\nbolt;1 200,50;small\n;5;small\nnut;10-15;odd\nBolt;7;small\n", encoding="utf-8")
    got = ingest.validated(ingest.read_catalogue(spark, str(path)), ["small"]).orderBy("row").collect()
    assert [(r.row, r.errors, r.warnings) for r in got] == [(3, [], []), (4, ["name_missing"], []), (5, ["price_range", "category_unknown"], []), (6, [], ["name_repeated"])]


def test_workbooks_and_encodings(tmp_path, spark):
    cell = lambda ref, v: f'<c r="{ref}" t="s"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{ref}"><v>{v}</v></c>'
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{t}</t></si>" for t in ["note", "Nomi", "Narx", "bolt &amp; nut"]) + "<si><r><t>ri</t></r><r><t>ch</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1">{cell("A1", 0)}</row><row r="2">{cell("B2", 1)}{cell("D2", 2)}</row><row r="5">{cell("B5", 3)}{cell("D5", "12.5")}</row><row r="6">{cell("B6", 4)}</row></sheetData></worksheet>')
    (tmp_path / "b.csv").write_bytes("Наименование,Цена\n\"стол, большой\nвторой\",5\nстул,6\n".encode("cp1251"))
    (tmp_path / "c.csv").write_text("nothing\nhere\n")
    (tmp_path / "d.xlsx").write_bytes(b"PK\x03\x04 broken")
    got = sorted((r.path.rpartition("/")[2], r.row, r.name, r.price, r.error) for r in ingest.read_catalogue(spark, str(tmp_path)).collect())
    assert got == [("a.xlsx", 5, "bolt & nut", "12.5", None), ("a.xlsx", 6, "rich", None, None), ("b.csv", 2, "стол, большой\nвторой", "5", None), ("b.csv", 4, "стул", "6", None), ("c.csv", None, None, None, "no_header"), ("d.xlsx", None, None, None, "unreadable")]


def test_page_text(spark):
    html = "<title>T</title><style>x{}</style><SCRIPT>var a='</p>'</SCRIPT><p class='a'>one &amp;lt; &#8364;&#65; two</p><!-- no --><br/>three  <b>bold</b> 1 < 2"
    assert one(spark, ingest.page_text(F.lit(html))) == "T\none &lt; €A two\nthree  bold 1 < 2" and one(spark, ingest.page_text(F.lit(None).cast("string"))) == ""


def test_nearest_is_brute_force(spark):
    import random

    from bidlake.operators.joins import nearest

    r = random.Random(6)
    rows = [(i, r.randrange(4), r.choice([1, 1, 2, 3, 5, 8, 8, 8, 9])) for i in range(60)]
    for k in (1, 2, 3):
        got = {(x.i, x.other, x.rn) for x in nearest(spark.createDataFrame(rows, "i int, g int, v int"), "g", "i", "v", k).collect()}
        assert got == {(i, o, n + 1) for i, g, v in rows for n, (_, o) in enumerate(sorted((abs(v - w), j) for j, h, w in rows if h == g and j != i)[:k])}


def test_portal_records(tmp_path, spark):
    rec = '{"id":1,"name":"%s","meta":{"lots":[{"lot_id":1}],"good_maps":[{"lot_id":1,"id":"g","name":"a","totalcost_item":5,"category":{"code":"c","title":"t"}},{"lot_id":1,"id":"g","name":"b","totalcost_item":9}]}}\n'
    (tmp_path / "p1.json").write_text(rec % "first")
    (tmp_path / "p2.json").write_text(rec % "second")
    records = ingest.read_portal(spark, str(tmp_path))
    assert [r.name for r in records.collect()] == ["second"]
    parts = ingest.flatten_portal(records)
    assert [r.name for r in parts["goods"].collect()] == ["b"] and parts["categories"].count() == 1 and parts["lots"].count() == 1


def test_streams_end_like_batches(tmp_path, spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.orderBy("ts").repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    far = F.lit("2030-01-01").cast("timestamp")
    events.limit(1).withColumn("ts", far).select(*events.columns).write.parquet(str(tmp_path / "zz"))
    for name, f in (("tumbling", incremental.tumbling), ("sessions", incremental.sessions), ("sliding", incremental.sliding)):
        s = f(incremental.event_stream(spark, str(tmp_path / "in"), 10))
        got = incremental.run_available(s, f"t_{name}", str(tmp_path / f"c_{name}"), "complete" if name != "sessions" else "append")
        want = f(events)
        if name == "sessions":  # the last ones stay open until the watermark passes them
            assert got.count() <= want.count() and got.exceptAll(want).count() == 0
        else:
            assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_micro_batches_are_merged_once(tmp_path, spark):
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: incremental.event_stream(spark, str(tmp_path / "in"), 10)
    incremental.upsert_batches(stream(), str(tmp_path / "out"), ["id"], str(tmp_path / "ck")).awaitTermination()
    spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    incremental.upsert_batches(stream(), str(tmp_path / "out"), ["id"], str(tmp_path / "ck")).awaitTermination()
    assert {(r.id, r.v) for r in incremental.current(spark, str(tmp_path / "out")).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    spark.createDataFrame([(3, "e")], "id int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    incremental.upsert_batches(stream(), str(tmp_path / "out"), ["id"], str(tmp_path / "ck")).awaitTermination()
    assert {(r.id, r.v) for r in incremental.current(spark, str(tmp_path / "out")).collect()} == {(1, "a"), (2, "c"), (3, "e")}
    assert len(list((tmp_path / "out/version=2").glob("bucket=*"))) == 1  # other buckets are as they were
