"""Files, streams and tables that are empty or broken."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foliant import storage
from foliant.operators import books as B
from foliant.operators import entities as G
from foliant.operators import lifecycle as L
from foliant.operators import retrieval as R
from foliant.operators import sessions as S
from foliant.operators import users as U
from foliant.sources import files as D
from foliant.streaming import queues


def test_page_files(spark, tmp_path):
    page = {"page_number": 2, "text": "b", "lines": [{"text": "b", "score": 0.5, "bbox": {"x1": 1}}]}
    (tmp_path / "a.json").write_text("﻿" + json.dumps({"book_id": "a", "ocr_engine": "e", "pages": [page, {"page_number": 1}]}))
    (tmp_path / "broken.json").write_text('{"pages": [')
    (tmp_path / "list.json").write_text('{"pages": 7}')
    (tmp_path / "none.json").write_text("{}")
    rows = D.read_pages(spark, str(tmp_path)).collect()
    assert sorted((r.book_id, r.page_number, r.text) for r in rows) == [("a", 1, None), ("a", 2, "b")]
    assert all(r.book_engine == "e" for r in rows)


def test_markdown_of_a_book(spark, tmp_path):
    pages = spark.createDataFrame([("b", 2, " two ", 0.5), ("b", 1, None, None)], "book_id string, page_number int, text string, avg_confidence double")
    value = D.book_markdown(pages, {"ocr_engine": F.lit("e")}).first().value
    assert value == "<!-- OCR_ENGINE: e -->\n<!-- BOOK_ID: b -->\n\n<!-- OCR_PAGE: 1 -->\n\n\n<!-- OCR_PAGE: 2 -->\n<!-- OCR_AVG_CONFIDENCE: 0.5 -->\ntwo\n"
    (tmp_path / "my_book.md").write_text("text")
    assert [tuple(r) for r in D.read_markdown(spark, str(tmp_path), "*.md").collect()] == [("my_book", "text")]


def test_lessons_and_contents(spark, tmp_path):
    (tmp_path / "b_lessons.json").write_text(json.dumps({"l1": {"lesson_id": "l1", "grade": 12, "learning_objectives": ["o"]}, "l2": {"lesson_id": "l2"}}))
    (tmp_path / "c_lessons.json").write_text("{broken")
    assert sorted(r.lesson_id for r in D.read_lessons(spark, str(tmp_path)).collect()) == ["l1", "l2"]
    assert D.read_lessons(spark, str(tmp_path / "nowhere")).count() == 0
    toc = {"l2": {"pdf_start": "5", "pdf_end": 9, "title": "B"}, "l1": {"pdf_start": 1, "pdf_end": 4, "title": "A"}, "bad": {"pdf_start": "x", "pdf_end": 1, "title": "C"}, "short": {"pdf_start": 1}}
    (tmp_path / "book.json").write_text(json.dumps(toc))
    want = {("book", "l2", 5, 9, "B", 0), ("book", "l1", 1, 4, "A", 1)}
    assert {tuple(r) for r in D.read_toc(spark, str(tmp_path), "book.json").collect()} == want == {tuple(r) for r in D.toc_of(spark, toc, "book").collect()}
    books = spark.createDataFrame([("book",), ("other",)], "book_id string")
    assert D.toc_for(D.toc_of(spark, toc, "book"), books, "book").groupBy("book_id").count().collect() == [("book", 2), ("other", 2)] or D.toc_for(D.toc_of(spark, toc, "book"), books, "book").count() == 4


def test_csv_with_a_mark(spark, tmp_path):
    (tmp_path / "q.csv").write_text('﻿question,truth\n"a ""b"",\nc",d\n', encoding="utf-8")
    assert [tuple(r) for r in D.read_csv(spark, str(tmp_path / "q.csv")).collect()] == [('a "b",\nc', "d")]
    D.write_csv(D.read_csv(spark, str(tmp_path / "q.csv")), str(tmp_path / "out"))
    back = D.read_csv(spark, str(tmp_path / "out"))
    assert back.columns == ["question", "truth"] and back.first().question == 'a "b",\nc'
    assert next((tmp_path / "out").glob("*.csv")).read_text(encoding="utf-8").startswith("﻿question")


def test_images_and_references(spark, tmp_path):
    for n in (1, 10):
        (tmp_path / f"page_0001_img_{n}.png").write_bytes(b"x")
    refs = D.image_refs(spark, str(tmp_path), "b").select("local_ref", F.concat(F.lit("https://h/"), F.regexp_extract("local_ref", r"_(\d+)\.png", 1)).alias("url"))
    rows = spark.createDataFrame([(1, "x /static/extracted_images/b/page_0001_img_10.png y /static/extracted_images/b/page_0001_img_1.png"), (2, None), (3, "no")], "k int, t string")
    assert {r.k: r.t for r in B.rewrite_by(rows, "t", refs).collect()} == {1: "x https://h/10 y https://h/1", 2: None, 3: "no"}


def test_small_files_are_whole(spark, tmp_path):
    path = str(tmp_path / "d" / "x.json")
    D.write_text(spark, path, "é1")
    D.write_text(spark, path, "é2")
    assert (tmp_path / "d" / "x.json").read_text(encoding="utf-8") == "é2" and D.exists(spark, path) and not D.exists(spark, path + ".tmp")
    rests = []
    (tmp_path / "f").write_text("")
    with pytest.raises(Exception):
        D.write_text(spark, str(tmp_path / "f" / "x"), "y", tries=3, sleep=rests.append)
    assert len(rests) == 2


def events(spark, path, rows):
    start = datetime(2024, 1, 1)
    spark.createDataFrame([(u, e, start + timedelta(seconds=t)) for u, e, t in rows], "user_id long, event_id long, ts timestamp").coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("delay", [None, "5 seconds"])
def test_cooldown_of_a_stream(spark, tmp_path, delay):
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    batches = [[(1, 1, 0), (1, 2, 3), (2, 3, 1), (1, 4, 5)], [(1, 5, 9), (1, 6, 10), (2, 7, 4)], [(1, 8, 400), (2, 9, 401), (2, 10, 402)]]
    for rows in batches:
        events(spark, path, rows)
        stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
        queues.drain(queues.cooldown(stream, 5, delay), out, state)
    got = {r.event_id: r.accepted for r in spark.read.parquet(out).collect()}
    batch = {r.event_id: r.accepted for r in S.accepted_requests(spark.read.parquet(path), 5).collect()}
    assert got == batch == {1: True, 2: False, 3: True, 4: True, 5: False, 6: True, 7: False, 8: True, 9: True, 10: False}


def test_work_in_batches_and_its_end(spark, tmp_path):
    path, done = str(tmp_path / "in"), []
    events(spark, path, [(1, 1, 0), (1, 2, 1)])
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    query = queues.work(stream, lambda batch, n: done.append(batch.count()), str(tmp_path / "c"), str(tmp_path / "p"))
    assert queues.until_stopped(query, lambda: False) and done == [2]
    assert [(r.batch, r.rows) for r in spark.read.parquet(str(tmp_path / "p")).collect()] == [(0, 2)]
    slow = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c2")).trigger(processingTime="1 second").start()
    assert not queues.until_stopped(slow, lambda: True)


def test_cooldown_of_odd_requests(spark):
    rows = [(1, 1, None), (None, 2, 5), (1, 3, 7), (1, 4, 7), (1, 5, 12)]
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(u, e, t if t is None else start + timedelta(seconds=t)) for u, e, t in rows], "user_id long, event_id long, ts timestamp")
    assert {r.event_id: r.accepted for r in S.accepted_requests(df, 5).collect()} == {1: False, 2: False, 3: True, 4: False, 5: True}
    assert S.accepted_requests(df.limit(0), 5).count() == 0
    assert df.select(S.wait_message(5, F.lit(1.5)).alias("m")).first().m.startswith("Vui lòng đợi 3 giây")


def test_sessions(spark):
    asked = spark.createDataFrame([(1, "u", None, "q" * 60, 5), (2, "u", "s1", "x", 6), (3, "v", "", "y", 7)], "request_id int, user_id string, session_id string, query string, at long")
    new = {r.request_id: r for r in S.new_sessions(asked).collect()}
    assert sorted(new) == [1, 3] and new[1].title == "q" * 50 + "..." and len(new[1].session_id) == 36 and new[1].messages == []
    held = spark.createDataFrame([("s1", "u", "t", 1), ("s2", "u", "t", 3), ("s3", "v", "t", 2)], "session_id string, user_id string, title string, created_at long").withColumn("messages", F.array())
    assert [r.session_id for r in S.history(held, "u").collect()] == ["s2", "s1"] and "messages" not in S.history(held, "u").columns
    assert S.session(held, "s1", "v").count() == 0 and S.session(held, "s1", "u").count() == 1
    left, n = S.without_session(held, "s1", "u")
    assert left.count() == 2 and n.first().deleted == 1 and S.without_session(held, "s1", "v")[1].first().deleted == 0


def test_replaced_books_are_what_upsert_and_purge_leave(spark):
    base = spark.createDataFrame([(1, "a", "x", 10, True, None), (2, "a", "y", 20, True, None), (3, "b", "z", 30, True, None)], "k int, book string, body string, kept int, active boolean, replaced_by string")
    delta = spark.createDataFrame([(1, "a", "new"), (9, "a", "new")], "k int, book string, body string")
    want = sorted(map(tuple, B.purge(B.upsert(base, delta, "k", ["kept"], "book", "r"), "book", ["a"]).collect()))
    assert sorted(map(tuple, B.replace_books(base, delta, "k", ["kept"], "book").select(base.columns).collect())) == want == [(1, "a", "new", 10, True, None), (3, "b", "z", 30, True, None), (9, "a", "new", None, True, None)]


def test_graphs_that_are_added_to(spark):
    none = spark.range(1).select(G.normalised(F.lit(None).cast("string")).alias("entities"))
    chunk = lambda i, title: none.select(F.lit(i).alias("chunk_id"), F.lit("b").alias("book_id"), F.lit(None).cast("string").alias("lesson_id"), F.lit("L").alias("lesson_title"), F.lit(title).alias("section_title"), F.lit(1).alias("global_chunk_index"), "entities")
    nodes, edges = G.graph(chunk("c1", "old").union(chunk("c2", "t")))
    new_nodes, new_edges = G.graph(chunk("c1", "new"))
    merged = {r.key: r.section_title for r in G.merged_nodes(nodes["PhanDoanV2"], new_nodes["PhanDoanV2"]).collect()}
    assert merged == {"c1": "new", "c2": "t"} and G.merged_edges(edges, new_edges).count() == edges.count() == 3
    assert [r.key for r in nodes["BaiHocV2"].collect()] == ["b_L"] and nodes["KhaiNiemV2"].count() == 0


def test_progress(spark):
    rows = L.progress(spark, "p3", "running", 1, 9, "c1", "t1").union(L.progress(spark, "p3", "complete", 9, 9, None, "t2")).union(L.progress(spark, "p4", "error", 2, 9, "c", "t1", "odd"))
    assert {r.phase: r.status for r in L.latest_progress(rows).collect()} == {"p3": "complete", "p4": "error"}
    none = spark.createDataFrame([], "status string")
    assert tuple(L.final_status(none).first()) == ("complete", 0, 0)


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "doc_id long, source string, lesson_id string, lesson_title string, page_number int, text string")
    blocks = B.lesson_blocks(pages, ["source", "lesson_id"], "doc_id", "lesson_title")
    assert B.chunks(blocks, "source", "lesson_id", "lesson_title").count() == 0
    items = spark.createDataFrame([], "chunk_id long, text string, embedding array<float>")
    asked = spark.createDataFrame([(1, "x", [1.0])], "query_id long, text string, vector array<float>")
    assert R.hybrid(items, asked).count() == 0 and R.hybrid(items, asked.limit(0)).count() == 0
    users = spark.createDataFrame([(1, None, None, None)], "uid long, email string, disabled boolean, claims map<string,string>")
    assert U.me(users, "a@b").first().role == "user" and U.set_admin(users, users.select("uid", F.lit(True).alias("admin")), "x").first().claims == {"admin": "true"}


def test_null_texts_and_keys(spark):
    rows = [(1, None, None, "T", 7, None), (2, "s", "l", "T", 8, "BÀI MỘT HAI\nx"), (3, "s", "l", "T", 9, None), (4, None, None, "T", 7, "y")]
    pages = spark.createDataFrame(rows, "doc_id long, source string, lesson_id string, lesson_title string, page_number int, text string")
    blocks = {(r.source, r.section, r.text, tuple(r.pages)) for r in B.lesson_blocks(pages, ["source", "lesson_id"], "doc_id", "lesson_title").collect()}
    assert blocks == {(None, "T", "y", (7,)), ("s", "BÀI MỘT HAI", "BÀI MỘT HAI\nx", (8,))}


def test_scratch_needs_a_shared_folder():
    class Session:
        conf = type("Conf", (), {"get": lambda self, *_: None})()
        sparkContext = type("C", (), {"master": "yarn"})

    with pytest.raises(RuntimeError):
        storage.scratch_path(Session(), "x")
