"""Keys in turn, retries, calls from tasks and checked answers, with stand-ins."""

import json

import pytest
from pyspark.sql import functions as F

from foliant import providers as P
from foliant.config import Settings
from foliant.operators import answers as A


def test_keys_go_in_turn_and_rest():
    rests = []
    ring = P.KeyRing(list("abcde"), group=2, pause=1, long_pause=9, sleep=rests.append)
    assert [ring.take() for _ in range(3)] == [0, 1, 0] and rests == [1]
    ring.report(0, "quota")
    assert [ring.take(), ring.take()] == [1, 1] and rests == [1, 1]
    ring.report(1, "key")
    assert [ring.take(), ring.take()] == [2, 3]
    for k in (2, 3, 4):
        ring.report(k, "quota")
    assert ring.take() == 0 and rests == [1, 1, 9] and ring.exhausted == set()
    for k in range(5):
        ring.report(k, "key")
    with pytest.raises(P.NoValidKey):
        ring.take()


class Flaky:
    def __init__(self, said):
        self.said, self.asked = list(said), []

    def generate(self, prompt, as_json=False, temperature=0.0):
        self.asked.append(prompt)
        said = self.said.pop(0)
        if isinstance(said, Exception):
            raise said
        return said


def test_retries():
    rests = []
    tries = P.Retries(transient=2, unreadable=1, sleep=rests.append)
    model = Flaky([RuntimeError("503"), "no", '{"a": 1}'])
    again = lambda prompt, text, error: f"{prompt}|{text}|{type(error).__name__}"
    assert tries.read(model, "p", P.read_object, again) == {"a": 1}
    assert model.asked == ["p", "p", "p|no|JSONDecodeError"] and rests == [30.0, 5.0]
    with pytest.raises(RuntimeError, match="504"):
        tries.call(Flaky([RuntimeError("504")] * 3), "p")
    with pytest.raises(RuntimeError, match="429"):
        tries.call(Flaky([RuntimeError("429 and 503")]), "p")
    with pytest.raises(ValueError, match="JSON"):
        tries.read(Flaky(["x", "[1]"]), "p", P.read_object, again)


def test_objects_in_responses():
    said = {'{"a":1}': {"a": 1}, ' ```json\n{"a":1}\n```': {"a": 1}, 'x {"a":[1,],} y}': {"a": [1]}, '{"a":"}{"} t': {"a": "}{"}}
    assert {t: P.read_object(t) for t in said} == said
    for bad in ("", None, "no", "[1]", '{"a"', "x } y"):
        with pytest.raises(ValueError):
            P.read_object(bad)


def test_enrichment_of_a_task(spark):
    class Scripted:
        """Fails for good at prompts that say so."""

        def __init__(self, key):
            self.key = key

        def generate(self, prompt, as_json=False, temperature=0.0):
            if self.key == "spent":
                raise RuntimeError("429")
            if "fatal" in prompt:
                raise KeyError("odd")
            return "no JSON" if "bad" in prompt else json.dumps({"khai_niem_dinh_nghia": prompt, "extra": 1})

    def quiet(_):
        return None

    prompts = spark.createDataFrame([(0, "a"), (1, "bad"), (2, "fatal"), (3, "b")], "chunk_id int, prompt string").coalesce(1)
    run = lambda keys: {r.chunk_id: r for r in P.enrich(prompts, Scripted, keys, lambda p, t, e: p, P.Retries(sleep=quiet), ring={"sleep": quiet}).collect()}
    got = run(["spent", "good"])
    assert [got[i].status for i in range(4)] == ["done", "json_error_skipped", "error", "error"]
    assert json.loads(got[0].entities)["khai_niem_dinh_nghia"] == ["a"] and json.loads(got[0].entities)["extra"] == 1
    assert got[2].error_type == got[3].error_type == "KeyError"


def test_failed_batches_of_vectors(spark):
    class Bad(P.HashEmbedder):
        def embed(self, texts, task):
            assert task == P.FOR_QUERIES and len(texts) <= 2
            if "x" in texts:
                raise RuntimeError("AIza" + "k" * 25)
            return super().embed(texts, task)

    rows = spark.createDataFrame([(0, "a b"), (1, None), (2, "x"), (3, "c"), (4, "d")], "chunk_id int, text string").coalesce(1)
    got = {r.chunk_id: r for r in P.embed(rows, Bad, P.FOR_QUERIES, size=2).collect()}
    assert [got[i].embedding is None for i in range(5)] == [False, False, True, True, False]
    assert got[2].error == "RuntimeError: [REDACTED_API_KEY]" and got[0].error is None


def test_recognition_of_files(spark, tmp_path):
    from foliant.operators import ocr
    from foliant.sources import files

    (tmp_path / "b1.pdf").write_bytes("one\n\ntwo\fthree".encode())
    pages = P.recognise(files.read_files(spark, str(tmp_path)), P.TextOcr).select("page_number", F.parse_json("result").alias("r"))
    got = ocr.pages_of(ocr.lines_of_lists(pages, ["page_number"], "r"), ["page_number"]).collect()
    assert {r.page_number: (r.text, r.avg_confidence) for r in got} == {1: ("one\ntwo", 1.0), 2: ("three", 1.0)}


ITEMS = [(1, "gen và DNA", [1.0, 0.0]), (2, "DNA tái bản", [0.9, 0.1]), (3, "hoa lá", [0.0, 1.0]), (4, None, [0.5, 0.5]), (5, "DNA", None)]


def test_reranked_retrieval(spark):
    items = spark.createDataFrame(ITEMS, "chunk_id int, text string, embedding array<double>")
    asked = spark.createDataFrame([(1, "DNA tái bản", [1.0, 0.0]), (2, "  ", [0.0, 1.0]), (3, "zzz", [1.0, 0.0]), (4, None, [1.0, 0.0])], "query_id int, text string, vector array<double>")
    rows = A.retrieve_context(items, asked, 2, P.OverlapReranker).collect()
    got = {q: [(r.chunk_id, r.score) for r in sorted(rows, key=lambda r: r.rank) if r.query_id == q] for q in (1, 2, 3, 4)}
    assert got[1] == [(2, 1.0), (1, round(1 / 3, 6))] and [c for c, _ in got[2]] == [3, 4]
    assert len(got[3]) == 1 and got[3][0][1] == 0.0 and [c for c, _ in got[4]] == [1, 2]
    plain = {(r.query_id, r.rank) for r in A.retrieve_context(items, asked, 2).collect()}
    assert plain == {(q, k) for q in (1, 2, 3, 4) for k in (1, 2)}

    class Broken:
        def score(self, query, texts):
            raise RuntimeError("503")

    fallback = A.retrieve_context(items, asked.where("query_id = 1"), 2, Broken).select("chunk_id", "rank").collect()
    assert {(r.chunk_id, r.rank) for r in fallback} == {(r.chunk_id, r.rank) for r in A.retrieve_context(items, asked.where("query_id = 1"), 2).select("chunk_id", "rank").collect()}


def test_checked_answers(spark):
    class Judge:
        """Answers with what it was told to avoid; doesn't like a first answer to "twice", breaks at "broken"."""

        def generate(self, prompt, as_json=False, temperature=0.0):
            if not as_json:
                return "second" if "tránh" in prompt else "first"
            if "broken" in prompt:
                return "no JSON"
            return json.dumps({"is_faithful": "first" not in prompt or "twice" not in prompt, "issues": ["made up"]})

    rows = [(1, "once", "ctx"), (2, "twice", "ctx"), (3, "none", None), (4, "broken", "ctx"), (5, None, "")]
    asked = spark.createDataFrame(rows, "query_id int, query string, context string")
    got = {r.query_id: r for r in A.answer(asked, Judge).collect()}
    assert [got[i].answer for i in range(1, 6)] == ["first", "second", A.REFUSAL, "first", A.REFUSAL]
    assert [got[i].regenerated for i in range(1, 6)] == [False, True, False, False, False]
    assert [got[i].verification.verdict for i in range(1, 6)] == ["PASS"] * 5 and got[3].verification.skipped and got[4].verification.error
    assert all(r.verification.skipped for r in A.answer(asked, Judge, verify=False).collect())


def test_prompts(spark):
    chunks = spark.createDataFrame([("b", "l", None, ["o1"], [1, 2], "text")], "book_id string, lesson_title string, section string, learning_objectives array<string>, pages array<int>, markdown_content string")
    prompt = chunks.select(A.extraction_prompt(chunks).alias("p")).first().p
    assert all(x in prompt for x in ("Sách: b", "Bài: l", '["o1"]', "[1,2]", "tom_tat_cot_loi")) and prompt.endswith("text")
    again = A.extraction_again(prompt, "bad " * 900, ValueError("odd"))
    assert "ValueError: odd" in again and len(again) < len(prompt) + 1500 and again.endswith(prompt)
    assert "- a\n- b" in A.answer_prompt("c", "q", ["a", "b"]) and A.UNKNOWN_ISSUES in A.answer_prompt("c", "q", []) and "tránh" not in A.answer_prompt("c", "q")


def test_graph_expansion_and_sources(spark):
    hits = spark.createDataFrame([(1, "c1", 0.5, 1), (1, "c2", 0.4, 2), (1, "c3", 0.3, 3)], "query_id int, chunk_id string, score double, rank int")
    edge = lambda *rows: spark.createDataFrame(list(rows), "src string, dst string")
    lessons = spark.createDataFrame([("l1", "One"), ("l2", "Two")], "key string, lesson_title string")
    out = A.expanded(hits, edge(("l1", "c1"), ("l2", "c1"), ("l1", "c2")), lessons, edge(("c1", "b"), ("c1", "a"), ("c1", "b"), ("c9", "z")))
    assert sorted((r.chunk_id, r.lesson, r.concepts) for r in out.collect()) == [("c1", "One", ["a", "b"]), ("c1", "Two", ["a", "b"]), ("c2", "One", [])]
    records = out.withColumn("text", F.lit("t")).withColumn("section", F.lit(None).cast("string")).withColumn("pages", F.array(F.lit(1)))
    shown = A.sources(records).first().sources
    assert len(shown) == 3 and shown[0].asDict() == {"lesson": "One", "text": "t", "concepts": ["a", "b"], "score": 0.5, "section": None, "pages": [1]}


def test_settings():
    s = Settings.read({"FOLIANT_KEYS": "a, b,,", "FOLIANT_FORCE_REOCR": "Yes", "FOLIANT_PDF_DPI": "300", "OTHER": "x"})
    assert (s.keys, s.force_reocr, s.pdf_dpi, s.enable_answer_verify) == (("a", "b"), True, 300, True)
    with pytest.raises(ValueError):
        Settings.read({"FOLIANT_PDF_DPI": "many"})
