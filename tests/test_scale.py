"""Steps whose cost grew faster than their input: what they do now, and that they give the same rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import books as B
from foliant.operators import extraction as E
from foliant.operators import nearest
from foliant.operators import retrieval as R
from foliant.plans import catalog as C


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_case_folding_reads_few_ranges(spark):
    # every range is a comparison for each character; single members were 300 and more
    assert X._FOLDED.count("-") < 120 and len(X._FOLDS) > 200
    texts = [*X._FOLDS, *(c + "x" for c in X._FOLDS), "STRASSE", "Straße", "ΣΑΣ", "Đường", "ı", " ", "", "a\nB", *map(chr, range(1, 0x250))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.casefold(F.col("t")).alias("f")).collect()
    assert [r.f for r in got] == [t.casefold() for t in texts]


def test_edges_of_unique_values_are_not_shuffled(spark, sf_dir):
    values = spark.createDataFrame([("a", "x"), ("a", "y")], "s string, v string")
    assert "Exchange" not in plan(E.edges(values, "K", "s", "v", unique=True)) and "Exchange" in plan(E.edges(values, "K", "s", "v"))
    assert plan(C.graph_edges(spark, sf_dir)).count("Exchange") == 2  # of the sections, and of the values


def test_nodes_need_no_sort(spark, sf_dir):
    assert plan(C.graph_nodes(spark, sf_dir)).count("SortAggregate") == plan(C.entity_dedupe(spark, sf_dir)).count("SortAggregate")


def brute(items, asked, k):
    """Rows by Spark's own arithmetic, pair by pair."""
    pairs = items.crossJoin(asked).where(F.size("embedding") == F.size("vector"))
    d = lambda c: R.doubles(F.col(c))
    norm = lambda c: F.sqrt(R.dot(d(c), d(c)))
    pairs = pairs.where((norm("embedding") > 0) & (norm("vector") > 0))
    scored = pairs.select("query_id", "chunk_id", F.round(R.dot(d("embedding"), d("vector")) / (norm("embedding") * norm("vector")), 6).alias("score"))
    return R.top_k(scored.where("score IS NOT NULL"), k, "chunk_id")


@pytest.mark.parametrize("named", ["long", "string"])
def test_vector_search_of_copies_ties_and_odd_vectors(spark, monkeypatch, named):
    for name, n in (("ITEMS", 16), ("ASKED", 8), ("PAIRS", 40)):
        monkeypatch.setattr(nearest, name, n)
    rng = np.random.default_rng(7)
    some = rng.integers(-2, 3, (60, 4)).astype(float).tolist()  # many scores tie
    rows = [(i, some[i % 60]) for i in range(200)] + [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(90)]
    rows += [(2000, None), (2001, [0.0] * 4), (2002, [1.0, None, 1.0, 1.0]), (2003, [1.0, 2.0]), (2004, []), (2005, [1e-170] * 4), (2006, [1e170] * 4), (2007, [float("nan"), 1.0, 1.0, 1.0])]
    items = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(3)
    items = items.withColumn("chunk_id", F.col("chunk_id").cast(named))
    asked = [(i, some[i % 30]) for i in range(40)] + [(50, [1.0, 2.0, 3.0, 4.0]), (51, [2.0, 1.0]), (52, None), (53, [0.0] * 4), (54, [1.0, None, 2.0, 2.0])]
    queries = spark.createDataFrame(asked, "query_id long, vector array<double>")
    found = R.vector_search(items, queries, 7)
    assert "Generate" not in plan(found) and "Join" not in plan(found)
    row = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, repr(r.score)) for r in df.collect())
    assert row(found) == row(brute(items, queries, 7))


def test_rounding_is_that_of_spark(spark):
    x = [0.1234565, 0.0000005, -0.0000005, 2.5e-7, 0.9999995, -0.1234565, 0.3, float("nan"), -0.0, 0.12345649999999999, 1e300, *np.random.default_rng(1).normal(size=500)]
    got = [r.r for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 6).alias("r")).collect()]
    assert list(map(repr, got)) == list(map(repr, nearest.rounded(np.array(x)).tolist()))


def folded_objectives(text):
    """extract() as one fold over the lines, each step of which copies what is done."""
    from foliant.operators import objectives as O

    lines = F.filter(F.transform(F.split(text, r"\R"), X.clean_title), lambda x: x != "")
    start = F.array_position(F.transform(lines, lambda x: X.match_key(x).contains(O.OPENING)), True).cast("int")
    seed = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(False).alias("over"))

    def step(a, line):
        some = (F.size(a["done"]) > 0) | a["open"].isNotNull()
        key = X.match_key(line)
        stop = key.rlike(rf"^({O.CLOSING})") | key.rlike(r"^(i|ii|iii|iv|v|vi|vii|viii|ix|x)\s") | (some & (line.endswith("?") | X.is_heading(line)))
        bullet, clean = line.rlike(O.BULLET), F.btrim(F.regexp_replace(line, O.BULLET, ""), F.lit(" ;,.\t"))
        opens = X.match_key(clean).rlike(f"^({O.VERBS})") & (F.length(clean) > O.LEAST)
        over = a["over"] | stop
        skip = over | (clean == "")
        done = F.when(~skip & bullet & a["open"].isNotNull(), F.array_compact(F.concat(a["done"], F.array(O._finished(a["open"]))))).otherwise(a["done"])
        held = F.when(skip, a["open"]).when(bullet, clean).when(a["open"].isNotNull(), F.concat_ws(" ", a["open"], clean)).when(opens, clean)
        return F.struct(done.alias("done"), held.alias("open"), over.alias("over"))

    found = F.aggregate(F.slice(lines, start + 1, F.size(lines) + 1), seed, step, lambda a: F.array_compact(F.concat(a["done"], F.array(O._finished(a["open"])))))
    return F.when(start > 0, O.unique(found)).otherwise(F.array().cast("array<string>"))


def test_objectives_without_a_fold(spark):
    import random

    from foliant.operators import objectives as O

    kinds = ["YÊU CẦU CẦN ĐẠT", "• Nêu được vai trò của nước", "- ngắn", "• ", "Trình bày được cấu tạo tế bào;", "tiếp theo của dòng trước", "Luyện tập", "II. Nội dung", "Vì sao?",
        "CHƯƠNG MỚI BẮT ĐẦU", "", "   ", "• nêu được vai trò của nước.", "o Kể được tên", "Kể được", "* Bài 3 mở", ";,.", "• Mục tiêu", "i gì đó"]
    rng = random.Random(11)
    texts = [None, "", "YÊU CẦU CẦN ĐẠT", *("\n".join(rng.choices(kinds, k=rng.randint(1, 14))) for _ in range(600)), *("YÊU CẦU CẦN ĐẠT\n" + "\n".join(rng.choices(kinds[1:6] + kinds[9:], k=12)) for _ in range(600))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(O.extract(F.col("t")).alias("a"), folded_objectives(F.col("t")).alias("b"))
    rows = df.collect()
    assert [r.a for r in rows] == [r.b for r in rows] and sum(len(r.a) > 1 for r in rows) > 100
    # nothing grows by copies
    assert "aggregate(" not in df._jdf.queryExecution().analyzed().toString().split("AS a#")[0]


def test_terms_are_broadcast_and_scores_made_where_the_counts_are(spark, sf_dir):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(C.bm25_topk(spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # of the counts by chunk, and of a task's best by query
    assert "SortMergeJoin" not in p and p.count("Exchange hashpartitioning") == 2 and "WindowGroupLimit" in p


def test_responses_are_parsed_once_a_use(spark):
    from foliant.operators import entities as G

    df = spark.createDataFrame([('{"khai_niem_dinh_nghia":["a"]}',)], "t string").select(G.normalised(F.col("t")).alias("n"))
    whole = df._jdf.queryExecution().optimizedPlan().toString()
    assert whole.count("tryParseJson") + whole.count("try_parse_json") + whole.count("parseJson") < 12 and whole.count("from_json") <= 2


def test_preview_class_has_ranges_alone(spark):
    texts = ["aZ [b]\n@c`{|}~0/9 é\t\x00\U0001f600x", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.regexp_replace("t", C._ODD, "").alias("a"), F.regexp_replace("t", "[^a-zA-Z \n]", "").alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and "^" not in C._ODD


WORDS = ["BÀI", "bài", "Bài 3", "Chương", "chuong 10", "CHUONG2", "3.", "12)", "I.", "xii.", "Hình", "BẢNG", "SƠ ĐỒ", "ĐỘT BIẾN", "Gen", "GEN", "of", "and the", "x" * 45, "Y" * 30,
    "\u212a", "\u0130", "\u0301", "a\u0301", "\U0001f600", "ß", "é", "É", "ǅ", "?", "#", ":", "-", "7"]
GAPS = [" ", " ", " ", "  ", "\t", "\xa0", " \u2003\u3000", "", "\x1f"]


def odd_lines(seed, n, ends=()):
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) + rng.choice([*GAPS, *ends]) for _ in range(rng.choice([1, 2, 3, 5, 9, 30]))) for _ in range(n)]


def searched_heading(line):
    """is_heading() with every line collapsed and folded whole."""
    t = F.trim(F.regexp_replace(F.btrim(line, F.lit(" #:-\t")), X.SPACE + "+", " "))
    low = X.folded(t)
    numbered = low.rlike(r"^(bai|chuong)\s*\d+\b") | low.rlike(rf"^({X.ROMAN})\.\s+") | (low.rlike(r"^\d+[.)]\s+") & (F.length(t) <= 90))
    shouted = (X.letters(t) >= 5) & (X.letters(t, True) >= 0.65 * X.letters(t)) & F.size(F.split(t, " ")).between(2, 16)
    return F.coalesce(F.length(t).between(3, 140) & ~t.endswith("?") & ~low.rlike(rf"^({X.CAPTIONS})\s") & (numbered | shouted), F.lit(False))


def test_headings_are_told_without_searching_every_line(spark):
    edges = [f"{a}{'A' * n}{gap}B{b}" for n in range(130, 146) for gap in ("", " ", "  ", "\xa0" * 90) for a in ("", "\xa0", "# ", "1. ") for b in ("", "\u2003", " :")]
    lines = [None, "", *edges, *odd_lines(5, 6000)]
    df = spark.createDataFrame([(t,) for t in lines], "t string")
    rows = df.select(X.is_heading(F.col("t")).alias("a"), searched_heading(F.col("t")).alias("b"), X.strip_space(F.col("t")).alias("c"),
        F.regexp_replace("t", f"^{X.SPACE}+|{X.SPACE}+$", "").alias("d")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and 500 < sum(r.a for r in rows) < len(rows) - 500
    assert [r.c for r in rows] == [r.d for r in rows]
    every = spark.createDataFrame([(chr(c),) for c in range(0x10000) if not 0xD800 <= c < 0xE000], "t string")
    white = r"[\s\u0085\xa0\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    for pattern in (X.SPACE, white):
        assert sorted(r.t for r in every.where(F.col("t").rlike(pattern)).collect()) == sorted(X.SPACES)
    # a pattern tries every white space in a text, and every place of a run of it once more
    assert "regexp" not in plan(df.select(X.strip_space(F.col("t"))))


def folded_pieces(text, limit):
    """pack_lines() line by line, with a copy of the pieces for each one."""
    lines, done, held = text.split("\n"), [], None
    for line in lines if len(text) > limit else []:
        if held is not None and len(held) + len(line) + 2 > limit:
            done, held = [*done, held], None
        held = line if held is None else f"{held}\n{line}"
    return [*done, held] if len(text) > limit else [text]


@pytest.mark.parametrize("limit", [1, 2, 60, 500])
def test_pieces_are_matched_and_not_copied(spark, limit):
    texts = ["", "\n", "\n\n\n", "a\n" * 200, "x" * (limit - 1) + "\n", "x" * limit + "\n\n", "x" * 999, "\n" + "x" * 999, "\n\n" + "x" * (limit - 1) + "\n" + "x" * 999, ("\U0001f600a" * limit + "\n") * 3, *odd_lines(7, 400, ["\n", "\n\n", "\r\n"])]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select(B.pack_lines(F.col("t"), limit).alias("a"))
    assert [r.a for r in df.collect()] == [*[folded_pieces(t, limit) for t in texts], None]
    assert "aggregate(" not in df._jdf.queryExecution().analyzed().toString()


def test_parts_of_pages_with_odd_line_ends(spark):
    ends = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
    texts = [*odd_lines(9, 400, ends), *(f"a{e}b" for e in ends), "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(B.page_parts(F.col("t")).alias("p")).collect()
    want = [[x for x in (y.strip(X.SPACES) for y in re.split("[" + "".join(ends[2:]) + "\n]", t or "")) if x] + [""] for t in texts]
    assert [[x for p in r.p for x in p.lines] for r in rows] == want


def test_blocks_are_made_once(spark, sf_dir, monkeypatch):
    made, gone = {}, []
    monkeypatch.setattr(B, "stored", lambda df, name: made.setdefault(name, df))
    monkeypatch.setattr(B, "release", lambda *tables: gone.extend(tables))
    C.section_blocks(spark, sf_dir)
    # the texts don't lie there twice
    assert gone == [made["page_parts"], made["headings_before"]]
    p = made["blocks"]._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("array_join(transform(pieces") == 1


def test_results_are_read_once_and_boxes_without_schemas(spark, sf_dir):
    from foliant.plans import services as V

    for query in (V.ocr_lists, V.page_images, V.ocr_rows):
        p = query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        # 88 times the schema of results and boxes before; rows of results ask for that of their texts
        assert p.count("parseJson") == 1 and (query is V.ocr_rows or "schemaOfVariant" not in p)


def schema_rect(box):
    """rect_of() by the schema of every box."""
    field = lambda n: F.try_variant_get(box, f"$.{n}", "double")
    x1, y1, x2, y2 = map(field, ("x1", "y1", "x2", "y2"))
    flat = F.filter(box.try_cast("array<double>"), lambda x: x.isNotNull())
    points = F.filter(F.transform(box.try_cast("array<array<double>>"), lambda p: F.when(F.size(p) >= 2, p)), lambda p: p.isNotNull())
    side = lambda k: F.transform(points, lambda p: F.get(p, F.lit(k)))
    rect = lambda *c: F.struct(*[x.alias(n) for x, n in zip(c, ("left", "top", "right", "bottom"), strict=True)])
    known = x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull()
    of_points = F.when((F.size(points) > 0) & F.forall(points, lambda p: F.forall(p, lambda x: x.isNotNull())),
        rect(F.array_min(side(0)), F.array_min(side(1)), F.array_max(side(0)), F.array_max(side(1))))
    of_list = F.when((F.size(flat) == 4) & (F.size(box.try_cast("array<variant>")) == 4), rect(*[F.get(flat, F.lit(k)) for k in range(4)])).otherwise(of_points)
    return F.when(F.schema_of_variant(box).startswith("OBJECT"), F.when(known, rect(x1, y1, x2, y2))).otherwise(of_list)


def test_boxes_and_lists_of_any_kind(spark):
    from foliant.operators import ocr

    parts = ["1", "2.5", "-3", '"4"', '"x"', "null", "true", "[1,2]", "[3,4]", "[5]", "[null,1]", "{}", "[]", "1e300", '{"x1":1}']
    rng = random.Random(3)
    boxes = [f"[{','.join(rng.choices(parts, k=rng.choice([1, 2, 3, 4, 4, 4, 5])))}]" for _ in range(1500)] + [f"[{','.join(rng.choices(parts[:3], k=4))}]" for _ in range(100)]
    boxes += ["{" + ",".join(f'"{n}":{rng.choice(parts[:9])}' for n in rng.sample(["x1", "y1", "x2", "y2", "z"], rng.choice([2, 4, 5]))) + "}" for _ in range(600)] + [*parts, None]
    df = spark.createDataFrame([(b,) for b in boxes], "b string").select("b", F.parse_json("b").alias("v"))
    rows = df.select("b", ocr.rect_of(F.col("v")).alias("x"), schema_rect(F.col("v")).alias("y")).collect()
    assert [(r.b, r.x) for r in rows] == [(r.b, r.y) for r in rows] and 100 < sum(r.x is not None for r in rows) < len(rows) - 100
    lists = ['{"rec_texts":null,"texts":["a"],"rec_scores":[1,2,3]}', '{"res":[],"texts":"b"}', '{"res":null,"texts":{"c":1}}', '{"res":{},"texts":["d"]}', '{"rec_texts":[],"texts":["e"]}',
        '{"texts":[1,true,"f",["g"]],"dt_polys":[[1,2,3,4]]}', '["h"]', '"i"', "null", None]
    df = spark.createDataFrame(list(enumerate(lists)), "k int, r string").select("k", F.try_parse_json("r").alias("r"))
    got = [(r.k, r.ord, r.text, r.score) for r in ocr.lines_of_lists(df, ["k"], "r").orderBy("k", "ord").collect()]
    assert got == [(0, 0, "a", 1.0), (1, 0, "b", None), (2, 0, '{"c":1}', None), (5, 0, "1", None), (5, 1, "true", None), (5, 2, "f", None), (5, 3, '["g"]', None)]
