"""Rules against cases written by hand."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import answers as A
from foliant.operators import books as B
from foliant.operators import entities as G
from foliant.operators import evaluation as V
from foliant.operators import extraction as E
from foliant.operators import objectives as O
from foliant.operators import ocr as R
from foliant.operators import retrieval as S


def values(spark, inputs, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_headings(spark):
    cases = {
        "Bài1 Gen": True, "Bài 12abc x": False, "bài 3": True, "CHƯƠNG2 DI TRUYỀN": True, "Chuong 10: abc": True, "I. Khái niệm": True, "xii. cuối": True, "xiii. không": False,
        "1. Mở đầu": True, "2) Tiếp": True, "1.Mở": False, "1. " + "x" * 88: False, "Hình 1 BÀI 1": False, "BẢNG SỐ LIỆU": False, "BẢNG": False, "SƠ ĐỒ GEN": False, "ĐỘT BIẾN GEN": True, "ĐỘT": False,
        "ĐỘT BIẾN GEN LÀ GÌ?": False, "Bài 1?": False, "## BÀI 4 ##": True, "- I. x -": True, "AB": False, "": False, None: False, "A B C D": False, "A " * 20: False, "T" * 141: False, "Đột biến gen": False,
        "NST Và ADN Của": True, "Bài  7   Gen": True, " Chương\t3 ": True,
    }
    assert dict(zip(cases, values(spark, list(cases), X.is_heading), strict=True)) == cases


def test_case_folding(spark):
    words = ["Straße", "STRASSE", "ΣΊΣΥΦΟΣ", "ſ", "İ", "ǅ", "ﬃ", "plain", "", "Ǆ🙂ß", "ὈΔΥΣΣΕΎΣ"]
    assert values(spark, words, X.casefold) == [w.casefold() for w in words]


def test_titles_labels_and_ids(spark):
    assert values(spark, ["  # a  b :-", "--", "x y "], X.clean_title) == ["a b", "", "x y"]
    assert values(spark, [[], [3], [3, 9]], X.pages_label, "array<int>") == ["", "3", "3-9"]
    assert values(spark, ["sinh_hoc_12", "x", "a7b8", None], X.grade_of) == [12, None, 7, None]
    uid = lambda c: X.chunk_uid(F.lit("b"), c, F.lit(7))
    assert values(spark, ["Bài 1/2", "", None, "_x_"], uid) == ["b:B_i_1_2:0007", "b:unknown:0007", "b:unknown:0007", "b:x:0007"]
    assert values(spark, ["a " * 5, "x" * 12, None], lambda c: X.preview(c, 10)) == ["a a a a a", "x" * 10 + "...", None]
    assert values(spark, ["k AIza" + "b" * 20 + " s"], lambda c: X.redact(c, known=("s",))) == ["k [REDACTED_API_KEY] [REDACTED_API_KEY]"]


def test_objectives(spark):
    text = "Mở\nYÊU CẦU CẦN ĐẠT\n• Nêu được khái niệm gen\nvà ví dụ ;\nTrình bày được cơ chế khác\n• Nêu được khái niệm gen và ví dụ.\n• ngắn\nI. Phần sau\n• Kể được sau cùng nhé"
    opened = "yêu cầu cần đạt\nTrình bày được cơ chế phiên mã\n• Vẽ sơ đồ đầy đủ\nĐây là gì?\n• Nêu được thêm nữa"
    got = values(spark, [text, opened, "không có", None, "", "yeu cau can dat"], O.extract)
    assert got[0] == ["Nêu được khái niệm gen và ví dụ Trình bày được cơ chế khác.", "Nêu được khái niệm gen và ví dụ."]
    assert got[1] == ["Trình bày được cơ chế phiên mã.", "Vẽ sơ đồ đầy đủ."] and got[2:] == [[], [], [], []]


def test_objective_windows(spark):
    toc = spark.createDataFrame([("a", 1, 1, "A", 0), ("b", 2, 9, "B", 1), ("c", 20, 21, "C", 2)], "lesson_id string, pdf_start int, pdf_end int, title string, ord int")
    pages = spark.createDataFrame([(1, "p1", 0), (2, "old", 1), (2, "new", 2), (3, "p3", 3), (4, "p4", 4)], "page_number int, text string, ord int")
    rows = lambda n: {r.lesson_id: r.text for r in B.objective_texts(pages, toc, n).collect()}
    assert rows(2) == {"a": "p1", "b": "new\np3", "c": ""} and rows(0) == {"a": "p1", "b": "new", "c": ""}


def test_lessons_of_several_books(spark):
    toc = spark.createDataFrame([("x", "l2", 5, 9, "two", 0), ("x", "l1", 1, 5, "one", 1), ("y", "m1", 1, 9, "em", 0)], "book string, lesson_id string, pdf_start int, pdf_end int, title string, ord int")
    pages = spark.createDataFrame([("x", 5), ("x", 6), ("y", 5), ("z", 5), ("x", 99), (None, 5)], "book string, page_number int")
    got = {(r.book, r.page_number): r.lesson_id for r in B.lessons_of_pages(pages, toc, book="book").collect()}
    assert got == {("x", 5): "l1", ("x", 6): "l2", ("y", 5): "m1", ("z", 5): B.OUTSIDE, ("x", 99): B.OUTSIDE, (None, 5): B.OUTSIDE}
    assert {r.book for r in B.lessons_of_pages(pages, toc, keep_outside=False, book="book").collect()} == {"x", "y"}


def test_markers(spark):
    assert values(spark, ["<!-- ocr_page: 3 -->x", "no", None], B.has_markers) == [True, False, False]
    rows = B.split_pages(spark.createDataFrame([(1, "lost<!-- OCR_PAGE: 2 -->a<!-- x\ny -->\n<!--OCR_PAGE:2-->"), (2, None), (3, "none")], "k int, t string"), "k", "t").collect()
    assert [(r.k, r.ord, r.page_number, r.text) for r in rows] == [(1, 0, 2, "a"), (1, 1, 2, "")]


def test_packing_of_lines(spark):
    limit, texts = 10, ["short", "aaaa\nbbbb\ncc", "x" * 30 + "\nab", "", "a\n\nb\n" + "c" * 9]
    for text, pieces in zip(texts, values(spark, texts, lambda c: B.pack_lines(c, limit)), strict=True):
        assert "\n".join(pieces) == text
        assert all(len(p) + 1 <= limit or "\n" not in p for p in pieces) or len(text) <= limit


def test_responses(spark):
    said = ['{"a":1}', ' ```json\n{"a":1}\n``` ', 'x {"a":[1,],} y}', '{"a":"}{\\""} tail', "[1]", "", None, "no", '{"a":1', '{"b":{"c":"\\\\"}} {"d":1}', "```\n[2]\n```"]
    got = values(spark, said, lambda c: F.to_json(E.parsed(c)))
    assert got == ['{"a":1}', '{"a":1}', '{"a":[1]}', '{"a":"}{\\""}', "[1]", None, None, None, None, '{"b":{"c":"\\\\"}}', "[2]"]
    assert values(spark, said, E.response_problem) == [None, None, None, None, "not an object", "empty", "empty", "not JSON", "not JSON", None, "not an object"]


def test_error_kinds_by_type(spark):
    rows = spark.createDataFrame([("bad JSON", "ValueError"), ("bad JSON", "IOError"), ("429 bad JSON", "IOError"), (None, "ValueError")], "m string, t string")
    assert [r.k for r in rows.select(E.error_kind(F.col("m"), F.col("t")).alias("k")).collect()] == ["json", "fatal", "quota", "fatal"]


def test_entities_of_any_shape(spark):
    raws = ['{"khai_niem_dinh_nghia":[{"ten":""," x":1},{"title":" T "},["a",[true,null]],1.5,"ß","SS"],"tom_tat_cot_loi":{"b":1,"a":"é"}}', '["x",null,"X",{"tom_tat_cot_loi":" y "}]', "3", "null", None, "{", "{}", '{"khai_niem_dinh_nghia":["  a ","A","b",null]}']
    rows = [r.asDict(True) for r in values(spark, raws, G.normalised)]
    names = [r["khai_niem_dinh_nghia"] for r in rows]
    assert names[0] == ['{" x": 1, "ten": ""}', "T", "a; True", "1.5", "ß"] and names[7] == ["a", "b"] and names[1:7] == [[]] * 6
    assert [r[E.SUMMARY] for r in rows] == ['{"a": "é", "b": 1}', "x y", "3", "", "", "", "", ""]


def test_boxes(spark):
    boxes = ['{"x1":1,"y1":2,"x2":3,"y2":4}', "[4,3,2,1]", "[[1,9],[5,2],[3,4]]", '{"x1":1}', "[]", '"x"', "null", None, "[[1,2],[3,null]]", "[[1]]", "[1,2,3]", '["a","b","c","d"]']
    got = [r and tuple(r) for r in values(spark, boxes, lambda c: R.rect_of(F.parse_json(c)))]
    assert got == [(1, 2, 3, 4), (4, 3, 2, 1), (1, 2, 5, 9), *[None] * 9]


def test_lines_of_odd_results(spark):
    lists = ['{"res":{"texts":[" b ","","a",null],"scores":["0.123456",0.5]}}', '{"rec_texts":"one","rec_scores":0.5,"rec_boxes":null}', "{}", "[]", "null", None]
    df = spark.createDataFrame(list(enumerate(lists)), "k int, r string").select("k", F.try_parse_json("r").alias("r"))
    got = {(r.k, r.ord): (r.text, r.score) for r in R.lines_of_lists(df, ["k"], "r").collect()}
    assert got == {(0, 0): ("b", 0.1235), (0, 2): ("a", None), (1, 0): ("one", 0.5)}
    rows = ['[[[[0,0],["a",0.5]],[[0,1],[" "]]],[[[1,1],["b"]]]]', '[[0],["c",1]]', '[["x"],7]', "null", None]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, r string").select("k", F.try_parse_json("r").alias("r"))
    assert sorted((r.k, r.text, r.score) for r in R.lines_of_rows(df, ["k"], "r").collect()) == [(0, "a", 0.5), (0, "b", None), (1, "c", 1.0)]


def test_fusion(spark):
    v = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2), (2, "a", 0.7, 1)], "query_id int, chunk_id string, score double, rank int")
    k = spark.createDataFrame([(1, "b", 5.0, 1), (1, "c", 4.0, 2)], "query_id int, chunk_id string, score double, rank int")
    got = sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in S.fuse(v, k, silent=True).collect())
    assert got == [(1, 1, "b", round(1 / 62 + 1 / 61, 6)), (1, 2, "a", round(1 / 61, 6)), (1, 3, "c", round(1 / 62, 6)), (2, 1, "a", 0.7)]
    assert {r.score for r in S.fuse(v, k).where("query_id = 2").collect()} == {round(1 / 61, 6)}


def test_vector_search_in_rounds_and_by_index(spark, sf_dir, monkeypatch):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    items, asked = e.select(F.col("vec_id").alias("chunk_id"), "embedding"), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    whole = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in S.vector_search(items, asked, 5).collect()}
    monkeypatch.setattr(S, "QUERIES_AT_ONCE", 3)
    assert {(r.query_id, r.rank): (r.chunk_id, r.score) for r in S.vector_search(items, asked, 5).collect()} == whole
    odd = spark.createDataFrame([(-1, None), (-2, [0.0] * 64), (-3, [1.0])], "chunk_id long, embedding array<float>")
    assert {(r.query_id, r.rank): (r.chunk_id, r.score) for r in S.vector_search(items.union(odd), asked, 5).collect()} == whole
    near = {(r.query_id, r.chunk_id) for r in S.near_buckets(items, asked, 5, 64).collect()}
    assert len(near & {(q, c) for (q, _), (c, _) in whole.items()}) >= 0.9 * len(whole)


def test_evaluation_steps(spark):
    rows = spark.createDataFrame([(1, "a", [1.0, 0.0], [1.0, 0.0])], "question_id int, q string, vector array<double>, made array<double>")
    empty = spark.createDataFrame([], "question_id int, rank int, verdict int, supported boolean")
    got = V.metrics(empty, empty, empty, rows).collect()
    assert [tuple(r) for r in got] == [(1, None, None, None, 1.0)]
    full = spark.createDataFrame([(0.1, 0.2, 0.3, 0.4, "ERROR"), (0.1, None, 0.3, 0.4, "PENDING")], "context_precision double, context_recall double, faithfulness double, answer_relevancy double, status string")
    assert [r.status for r in V.finished(full).collect()] == ["DONE", "PENDING"]


@pytest.mark.parametrize("f", [lambda c: A.escaped(c)])
def test_escaping(spark, f):
    assert values(spark, ["a+b?", "\\", None, "x"], f) == ["a\\+b\\?", "\\\\", None, "x"]
