"""Books of many pages as JSON files: lines that tasks write and read one by one, and files of other layouts beside them."""

import glob
import json
import os

from pyspark.sql import functions as F

from foliant.sources import files as D


def books(spark):
    text = F.concat(F.lit('a"b\n,{} ]}"pages":['), F.col("id").cast("string"))
    rows = spark.range(400, numPartitions=7).select(F.concat(F.lit("b "), (F.col("id") % 3).cast("string")).alias("book_id"),
        F.when(F.col("id") != 5, ((F.col("id") * 7) % 400).cast("int")).alias("page_number"), F.when(F.col("id") != 9, text).alias("text"))
    return rows.unionByName(spark.createDataFrame([("one", 1, "x")], rows.schema))


def test_a_book_is_written_and_read_in_lines(spark, tmp_path):
    path = str(tmp_path / "out")
    D.write_books(D.book_json(books(spark), {"status": F.lit("s")}), path)
    found = glob.glob(f"{path}/book_id=*/*.txt")
    assert len(found) == 4
    numbers = 0
    for f in found:
        whole = open(f, encoding="utf-8").read()
        book = json.loads(whole)
        assert len(whole.split("\n")) == len(book["pages"]) + 3 and book["completed_pages"] == len(book["pages"])
        at = [p.get("page_number") or 0 for p in book["pages"]]
        assert at == sorted(at)
        numbers += len(at)
    assert numbers == 401
    # no row of the files holds more than a page
    read = D.read_pages(spark, path, "*.txt")
    assert "wholetext" not in read._jdf.queryExecution().toString().lower()
    got = sorted((r.book_id, r.page_number or 0, r.text or "", r.completed_pages, r.status) for r in read.collect())
    counts = {"b 0": 134, "b 1": 133, "b 2": 133, "one": 1}
    assert got == sorted((r.book_id, r.page_number or 0, r.text or "", counts[r.book_id], "s") for r in books(spark).collect())


def test_other_layouts_and_broken_lines(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text, encoding="utf-8")
    put("one line.json", '{"book_id":"w","pages":[{"page_number":1,"text":"a"},{"page_number":2}]}')
    put("indented.json", json.dumps({"book_id": "i", "pages": [{"page_number": 3, "text": "b"}]}, indent=1))
    put("lines.json", '﻿{"book_id":"l","pages":[\n{"page_number":4}\n,{"page_number":5}\n]}\n')
    put("empty.json", '{"book_id":"e","pages":[\n]}\n')
    put("cut.json", '{"book_id":"c","pages":[\n{"page_number":6}\n')
    put("comma.json", '{"book_id":"k","pages":[\n{"page_number":7}\n{"page_number":8}\n]}\n')
    put("torn.json", '{"book_id":"t","pages":[\n{"page_number":9}\n,{"page_nu\n]}\n')
    got = sorted((r.book_id, r.page_number) for r in D.read_pages(spark, str(tmp_path)).collect())
    assert got == [("i", 3), ("l", 4), ("l", 5), ("w", 1), ("w", 2)]


def test_a_long_book_keeps_its_order_beyond_memory(spark, tmp_path):
    limit = spark.conf.get("spark.sql.shuffle.partitions")
    rows = spark.range(30_000, numPartitions=5).select(F.lit("b").alias("book_id"), ((F.col("id") * 7919) % 30_000).cast("int").alias("page_number"), F.lit("t").alias("text"))
    path = str(tmp_path / "long")
    D.write_books(D.book_json(rows, {}), path)
    (file,) = glob.glob(os.path.join(path, "*", "*.txt"))
    assert [p["page_number"] for p in json.load(open(file))["pages"]] == list(range(30_000)) and limit
