"""Queries of recognition, model runs, files, accounts and evaluation over the driver's tables, each beside its SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import providers as P
from foliant import storage
from foliant.functions import text as X
from foliant.operators import answers as A
from foliant.operators import books as B
from foliant.operators import entities as G
from foliant.operators import evaluation as V
from foliant.operators import extraction as E
from foliant.operators import lifecycle as L
from foliant.operators import ocr as O
from foliant.operators import sessions as S
from foliant.operators import users as U
from foliant.sources import files as D
from foliant.streaming import queues

COOLDOWN = 6 * 3600


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark, sf):
    return _t(spark, sf, "documents")


# Recognition: every document is a page, its lines lie by a rule.

_LEFT, _TOP = "((i * 53) % 7) * 5", "((i * 37) % 11) * 10"


def _score(i):
    return ((F.col("doc_id") * 31 + i * 17) % 16) / 16.0


def _place(i):
    return (i * 53) % 7 * 5, (i * 37) % 11 * 10


def _page(lines, keys=("doc_id",)):
    pages = O.pages_of(lines, list(keys))
    return pages.select(*keys, F.md5("text").alias("hash"), "avg_confidence")


def ocr_lists(spark, sf):
    box = lambda i: F.array(_place(i)[0], _place(i)[1], _place(i)[0] + 10, _place(i)[1] + 9)
    lines = F.split("text", "\n")
    each = lambda f: F.transform(lines, lambda t, i: f(i))
    result = F.struct(F.struct(lines.alias("rec_texts"), each(_score).alias("rec_scores"), each(box).alias("rec_boxes")).alias("res"))
    return _page(O.lines_of_lists(_docs(spark, sf).select("doc_id", F.parse_json(F.to_json(result)).alias("r")), ["doc_id"], "r"))


def ocr_rows(spark, sf):
    def row(t, i):
        x, y = (c.cast("string") for c in _place(i))
        x2, y2 = ((c + d).cast("string") for c, d in zip(_place(i), (10, 9), strict=True))
        pair = F.regexp_replace(F.to_json(F.array(t)), r"\]$", "")
        return F.concat(F.lit("[[["), x, F.lit(","), y, F.lit("],["), x2, F.lit(","), y, F.lit("],["), x2, F.lit(","), y2, F.lit("]],"), pair,
            F.lit(","), _score(i).cast("string"), F.lit("]]"))

    result = F.concat(F.lit("[["), F.array_join(F.transform(F.split("text", "\n"), row), ","), F.lit("]]"))
    return _page(O.lines_of_rows(_docs(spark, sf).select("doc_id", F.parse_json(result).alias("r")), ["doc_id"], "r"))


def page_images(spark, sf):
    """Pages with an image in the midst of their lines, without changing their confidence."""
    lines = F.split("text", "\n")
    box = lambda i: F.array(F.lit(0), i * 10, F.lit(10), i * 10 + 9)
    result = F.struct(lines.alias("texts"), F.transform(lines, lambda t, i: _score(i)).alias("scores"), F.transform(lines, lambda t, i: box(i)).alias("dt_polys"))
    pages = _docs(spark, sf).select("doc_id", F.parse_json(F.to_json(result)).alias("r"))
    point = lambda v: F.lit(v * 72 / 220)
    url = F.concat(F.lit("/img/"), O.image_name(F.col("doc_id").cast("int"), F.lit(1)))
    images = _docs(spark, sf).where("doc_id % 3 = 0").select("doc_id", F.lit(1).alias("number"), url.alias("url"), point(0.0).alias("x0"),
        point(15.0).alias("y0"), point(5.0).alias("x1"), point(20.0).alias("y1"))
    out = O.pages_of(O.lines_of_lists(pages, ["doc_id"], "r"), ["doc_id"], O.image_lines(images, ["doc_id"]))
    return out.select("doc_id", F.md5("text").alias("hash"), "avg_confidence")


def box_kinds(spark, sf):
    """Boxes of every form, cropped to an image of 60 by 50."""
    n = F.col("event_id").cast("string")
    x, y, x2, y2 = ((F.col("event_id") * a % b).cast("string") for a, b in ((7, 60), (11, 50), (13, 60), (17, 50)))
    join = lambda *c: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in c])
    forms = [join('{"x1":', x, ',"y1":', y, ',"x2":', x2, ',"y2":', y2, "}"), join("[", x, ",", y, ",", x2, ",", y2, "]"),
        join("[[", x, ",", y, "],[", x2, ",", y2, "]]"), join('{"x1":', n, "}"), F.lit('"none"')]
    kind = (F.col("event_id") % len(forms)).cast("int")
    rect = O.rect_of(F.parse_json(F.get(F.array(*forms), kind)))
    rows = _t(spark, sf, "events").select("event_id", rect.alias("r")).select("event_id", "r", B.crop(F.col("r"), F.lit(60), F.lit(50)).alias("c"))
    return rows.select("event_id", *[F.col(f"r.{s}").alias(s) for s in ("left", "top", "right", "bottom")],
        F.col("c.left").cast("int").alias("crop_left"), F.col("c.bottom").cast("int").alias("crop_bottom"))


def line_fallback(spark, sf):
    k = F.col("event_id") % 3
    second = F.when(k == 0, F.lit("  ")).when(k == 1, F.concat(F.lit(" "), F.col("props"), F.lit(" ")))
    return _t(spark, sf, "events").select("event_id", O.recognised(second, F.col("event_type")).alias("text"))


_OCR_SQL = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
 s AS (SELECT doc_id, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS t, i, ((doc_id * 31 + i * 17) % 16) / 16.0 AS score, {_LEFT} AS x, {_TOP} AS y FROM l)
 SELECT doc_id, md5(string_agg(t, chr(10) ORDER BY y, x, i)) AS hash, round(avg(score), 4) AS avg_confidence FROM s WHERE t <> '' GROUP BY doc_id"""

SQL = {
    "ocr_lists": _OCR_SQL,
    "ocr_rows": _OCR_SQL,
    "page_images": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
 s AS (SELECT doc_id, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t, i * 10.0 AS y, ((doc_id * 31 + i * 17) % 16) / 16.0 AS score FROM l
 UNION ALL SELECT doc_id, printf('![Hình ảnh minh hoạ](/img/page_%04d_img_1.png)', doc_id), 15.0, NULL FROM documents WHERE doc_id % 3 = 0)
 SELECT doc_id, md5(string_agg(t, chr(10) ORDER BY y)) AS hash, round(avg(score), 4) AS avg_confidence FROM s WHERE t <> '' GROUP BY doc_id""",
    "box_kinds": """WITH e AS (SELECT event_id, event_id % 5 AS k, event_id * 7 % 60 AS a, event_id * 11 % 50 AS b, event_id * 13 % 60 AS c,
  event_id * 17 % 50 AS d FROM events),
 r AS (SELECT event_id, CASE WHEN k < 2 THEN a WHEN k = 2 THEN least(a, c) END AS l, CASE WHEN k < 2 THEN b WHEN k = 2 THEN least(b, d) END AS t, CASE
  WHEN k < 2 THEN c WHEN k = 2 THEN greatest(a, c) END AS r, CASE WHEN k < 2 THEN d WHEN k = 2 THEN greatest(b, d) END AS b FROM e),
 p AS (SELECT *, greatest(l - 4, 0) AS pl, greatest(t - 4, 0) AS pt, least(r + 4, 60) AS pr, least(b + 4, 50) AS pb FROM r)
 SELECT event_id, l::DOUBLE AS "left", t::DOUBLE AS top, r::DOUBLE AS "right", b::DOUBLE AS bottom, CASE WHEN pr > pl
  AND pb > pt THEN pl END::INTEGER AS crop_left, CASE WHEN pr > pl AND pb > pt THEN pb END::INTEGER AS crop_bottom FROM p""",
    "line_fallback": "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN props ELSE event_type END AS text FROM events",
}


# Model runs.


def entity_normalise(spark, sf):
    """Responses of many shapes: lists, scalars, objects, lists of objects, no object at all."""
    k = F.get_json_object("props", "$.k")
    forms = [
        F.concat(F.lit('{"khai_niem_dinh_nghia":[" Gene ","gene","K'), k, F.lit('",null],"tom_tat_cot_loi":" tóm "}')),
        F.concat(F.lit('{"khai_niem_dinh_nghia":{"name":"N'), k, F.lit('"},"co_che_qua_trinh":true,"tom_tat_cot_loi":null}')),
        F.concat(F.lit('[{"khai_niem_dinh_nghia":"A","tom_tat_cot_loi":"s"},"plain ",{"khai_niem_dinh_nghia":["a",['), k, F.lit(',"x"]],"tom_tat_cot_loi":"S"}]')),
        F.lit('"only text"'),
        F.lit("not json"),
    ]
    rows = _t(spark, sf, "events").select("event_id", G.normalised(F.get(F.array(*forms), (F.col("event_id") % len(forms)).cast("int"))).alias("n"))
    return rows.select("event_id", *[F.array_join(f"n.{c}", "|").alias(c) for c in ("khai_niem_dinh_nghia", "co_che_qua_trinh")],
        F.col(f"n.{E.SUMMARY}").alias("summary"))


def _chunks(spark, sf):
    """Documents as chunks of books, with entities in the asked-for shape."""
    words = F.filter(F.transform(F.split("text", " "), lambda w: F.regexp_replace(w, "[^a-zA-Z]", "")), lambda w: F.length(w) > 6)
    body = F.to_json(F.struct(words.alias("khai_niem_dinh_nghia"), F.array("lang").alias("co_che_qua_trinh"), F.lit("").alias(E.SUMMARY)))
    lesson = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("l"), (F.col("doc_id") % 7).cast("string")))
    return _docs(spark, sf).select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("book_id"), lesson.alias("lesson_id"),
            F.concat(F.lit("Lesson "), F.col("lang")).alias("lesson_title"),
        F.col("doc_id").cast("int").alias("global_chunk_index"), F.col("n_chars").alias("lesson_page_start"), G.normalised(body).alias("entities"),
    )


def graph_of_chunks(spark, sf):
    return G.graph(_chunks(spark, sf))[1]


def graph_lessons(spark, sf):
    return G.graph(_chunks(spark, sf))[0]["BaiHocV2"].select("key", "lesson_title", "lesson_page_start")


def _queued(spark, sf):
    flag = lambda n: F.when(F.col("doc_id") % n == 0, F.lit(True)).when(F.col("doc_id") % n == 1, F.lit(False))
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    return _docs(spark, sf).select(
        F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", F.col("doc_id").cast("int").alias("global_chunk_index"),
            (F.col("doc_id") % 4 == 0).alias("api_refined"), (F.col("doc_id") % 6 != 0).alias("active"),
        flag(3).alias("neo4j_synced"), F.col("lang").alias("markdown_content"), *none("extracted_entities", "refined_at", "refinement_model",
            "phase3_status", "phase3_error", "phase3_error_type", "phase3_error_at"),
        *none("neo4j_synced_at", "phase4_status", "phase4_error", "phase4_error_at"),
    )


class ScriptedModel:
    """Answers by the number in the prompt: one in ten never with JSON, one in seven first with a fenced object that has a comma too many; one key is spent,
  one refused."""

    def __init__(self, key: str):
        self.key, self.asked = key, 0

    def generate(self, prompt: str, as_json: bool = False, temperature: float = 0.0) -> str:
        if self.key in ("429", "401"):
            raise RuntimeError(f"{self.key} for this key")
        n = int(prompt.rpartition("#")[2])
        if n % 10 == 0:
            return "no object here"
        body = json.dumps({"khai_niem_dinh_nghia": f"K{n}", "tom_tat_cot_loi": None})
        return f"```json\n{body[:-1]},}}\n```" if n % 7 == 0 else body


def _quiet(seconds):
    return None


def enrich_run(spark, sf):
    chunks = _queued(spark, sf)
    queue = L.enrichment_queue(chunks).select("chunk_id", F.concat(F.lit("Đoạn #"), "chunk_id").alias("prompt"))
    again = lambda prompt, response, error: f"again: {prompt}"
    results = P.enrich(queue, ScriptedModel, ["429", "401", "good"], again, P.Retries(sleep=_quiet), ring={"sleep": _quiet})
    after = L.apply_enrichment(chunks, storage.stored(results, "enrichment"), "model-1", "2025-01-01T00:00:00")
    name = F.get_json_object("extracted_entities", "$.khai_niem_dinh_nghia[0]")
    return after.select("doc_id", "api_refined", "phase3_status", name.alias("concept"), "refined_at", "phase3_error_type")


def enrich_status(spark, sf):
    done = enrich_run(spark, sf).where("phase3_status IS NOT NULL").select(F.col("phase3_status").alias("status"))
    return L.final_status(done)


def graph_sync(spark, sf):
    chunks = _queued(spark, sf)
    results = L.graph_queue(chunks).select("chunk_id", F.when(F.col("doc_id") % 8 == 0, F.lit("lost connection")).alias("error"))
    return L.apply_graph(chunks, results, "2025-01-01T00:00:00").select("doc_id", "neo4j_synced", "phase4_status", "phase4_error")


class FailingEmbedder(P.HashEmbedder):
    def embed(self, texts: list[str], task: str) -> list[list[float]]:
        if any(len(t) % 11 == 0 for t in texts):
            raise RuntimeError("503 for a while")
        return super().embed(texts, task)


def embed_run(spark, sf):
    old = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    chunks = _docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("markdown_content"))
    new = P.embed(L.embedding_queue(chunks, old), FailingEmbedder, P.FOR_DOCUMENTS, text="markdown_content", size=1)
    after = L.apply_embeddings(old, storage.stored(new, "vectors"))
    return after.select("chunk_id", F.size("embedding").alias("n"))


#: One message for each word that marks an error, and some that name more than one kind or none.
MESSAGES = {
    "HTTP 429": "quota", "your quota is used up": "quota", "Rate limit hit": "quota", "rate_limit": "quota", "RateLimit": "quota",
        "rate exceeded": "quota", "RateExceeded": "quota", "Resource exhausted": "quota",
    "RESOURCE_EXHAUSTED": "quota", "ResourceExhausted": "quota", "Too Many Requests": "quota", "too_many_requests": "quota", "5 per minute": "quota",
        "50 per day": "quota", "free tier only": "quota", "Try again later": "quota",
    "API key not valid": "key", "API_KEY_INVALID": "key", "Invalid API key": "key", "invalid_api_key": "key", "API key expired": "key",
        "api key revoked": "key", "authentication failed": "key", "UNAUTHENTICATED": "key",
    "Unauthorized": "key", "Permission denied": "key", "PERMISSION_DENIED": "key", "Forbidden": "key", "code 403": "key", "code 401": "key",
        "api key loaded, 503": "transient", "api key loaded": "fatal",
    "read timeout": "transient", "Deadline exceeded": "transient", "DEADLINE_EXCEEDED": "transient", "temporarily unavailable": "transient",
        "Unavailable": "transient", "Service Unavailable": "transient",
    "Internal Server Error": "transient", "connection reset by peer": "transient", "connection aborted": "transient",
        "Connection refused": "transient", "remote disconnected": "transient", "DNS failure": "transient",
    "SSL: bad handshake": "transient", "socket closed": "transient", "503": "transient", "504": "transient", "500": "transient", "502": "transient",
        "connection lost": "fatal",
    "bad JSON": "json", "can't parse": "json", "parser stopped": "json", "decode error": "json", "JSON không hợp lệ": "json", "response rỗng": "json",
        "không có text hợp lệ": "json", "không phải object": "json",
    "JSON after 429": "quota", "403 and 503": "key", "timeout in parser": "transient", "odd": "fatal", "": "fatal",
}


def error_route(spark, sf):
    known = F.array(*map(F.lit, MESSAGES))
    message = F.get(known, (F.col("event_id") % len(MESSAGES)).cast("int"))
    return _t(spark, sf, "events").select("event_id", E.error_kind(message).alias("kind"))


def error_summaries(spark, sf):
    even = F.col("event_id") % 2 == 0
    code = F.when(F.col("event_id") % 3 == 0, F.lit("429"))
    long = F.concat(F.lit("key AIza"), F.repeat(F.lit("x"), 24), F.lit("  of\n"), F.col("event_type"), F.when(even, F.repeat(F.lit(" word"), 200)).otherwise(F.lit("")))
    out = E.error_summary(F.lit("ApiError"), long, code, F.lit("429"), F.lit(""), F.when(even, F.lit("RATE")))
    return _t(spark, sf, "events").select("event_id", out.alias("summary"))


SQL |= {
    "entity_normalise": """WITH e AS (SELECT event_id, event_id % 5 AS f, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events)
 SELECT event_id, CASE f WHEN 0 THEN 'Gene|K' || k WHEN 1 THEN 'N' || k WHEN 2 THEN 'A|' || k || '; x' ELSE '' END AS khai_niem_dinh_nghia, CASE f
  WHEN 1 THEN 'True' ELSE '' END AS co_che_qua_trinh,
 CASE f WHEN 0 THEN 'tóm' WHEN 2 THEN 's plain' WHEN 3 THEN 'only text' ELSE '' END AS summary FROM e""",
    "graph_of_chunks": """WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS id, source, lang, text, source || '_' || CASE
  WHEN doc_id % 5 <> 0 THEN 'l' || doc_id % 7 ELSE 'Lesson ' || lang END AS lesson FROM documents),
 w AS (SELECT id, regexp_replace(v, '[^a-zA-Z]', '', 'g') AS v, pos FROM (SELECT id, unnest(string_split(text, ' ')) AS v, generate_subscripts(string_split(text,
  ' '), 1) AS pos FROM c)),
 k AS (SELECT id, arg_min(v, pos) AS v FROM w WHERE length(v) > 6 GROUP BY id, lower(v))
 SELECT DISTINCT source AS src, 'BAO_GOM' AS type, lesson AS dst FROM c UNION SELECT lesson, 'CO_PHAN_DOAN', id FROM c UNION SELECT id, 'DINH_NGHIA', v FROM k
  UNION SELECT id, 'GIAI_THICH_CO_CHE', lang FROM c""",
    "graph_lessons": """WITH c AS (SELECT doc_id, 'Lesson ' || lang AS lesson_title, n_chars, source || '_' || CASE WHEN doc_id % 5 <> 0 THEN 'l' || doc_id % 7
  ELSE 'Lesson ' || lang END AS key FROM documents)
 SELECT key, arg_max(lesson_title, doc_id) AS lesson_title, arg_max(n_chars, doc_id) AS lesson_page_start FROM c GROUP BY key""",
    "enrich_run": """WITH q AS (SELECT doc_id, doc_id % 4 <> 0 AND doc_id % 6 <> 0 AS queued, doc_id % 10 = 0 AS bad FROM documents)
 SELECT doc_id, NOT queued AND doc_id % 4 = 0 OR queued AND NOT bad AS api_refined, CASE WHEN queued THEN CASE WHEN bad THEN 'json_error_skipped'
  ELSE 'done' END END AS phase3_status,
 CASE WHEN queued AND NOT bad THEN 'K' || doc_id END AS concept, CASE WHEN queued AND NOT bad THEN '2025-01-01T00:00:00' END AS refined_at, CASE WHEN queued
  AND bad THEN 'ValueError' END AS phase3_error_type FROM q""",
    "enrich_status": """WITH q AS (SELECT doc_id % 10 = 0 AS bad FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 6 <> 0)
 SELECT CASE WHEN bool_or(bad) THEN 'complete_with_skipped_chunks' ELSE 'complete' END AS status, count(*) AS n,
  CAST(count(*) FILTER (bad) AS BIGINT) AS skipped FROM q""",
    "graph_sync": """WITH q AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS synced, doc_id % 4 = 0 AND doc_id % 6 <> 0
  AND doc_id % 3 <> 0 AS queued, doc_id % 8 = 0 AS bad FROM documents)
 SELECT doc_id, CASE WHEN queued AND NOT bad THEN true ELSE synced END AS neo4j_synced, CASE WHEN queued THEN CASE WHEN bad THEN 'error'
  ELSE 'done' END END AS phase4_status, CASE WHEN queued AND bad THEN 'lost connection' END AS phase4_error FROM q""",
    "embed_run": """SELECT vec_id AS chunk_id, CAST(len(embedding) AS INTEGER) AS n FROM embeddings UNION ALL SELECT doc_id, 64 FROM documents WHERE text <> ''
  AND doc_id NOT IN (SELECT vec_id FROM embeddings) AND length(text) % 11 <> 0""",
    "error_route": f"SELECT event_id, [{', '.join(repr(k) for k in MESSAGES.values())}][event_id % {len(MESSAGES)} + 1] AS kind FROM events",
    "error_summaries": """WITH e AS (SELECT event_id, event_id % 2 = 0 AS even, CASE WHEN event_id % 3 = 0 THEN '429' END AS code,
 'ApiError: key [REDACTED_API_KEY] of ' || event_type AS head FROM events), m AS (SELECT *, trim(regexp_replace(head || CASE WHEN even THEN repeat(' word',
  200) ELSE '' END || ' ' || coalesce(code, '') || ' 429  ' || CASE WHEN even THEN 'RATE' ELSE '' END, '\\s+', ' ', 'g')) AS t FROM e)
 SELECT event_id, 'type=ApiError' || CASE WHEN code IS NOT NULL THEN ' | code=429' ELSE ' | status_code=429' END || CASE WHEN even THEN ' | reason=RATE'
  ELSE '' END || ' | message=' || CASE WHEN length(t) > 800 THEN rtrim(left(t, 800)) || '...' ELSE t END AS summary FROM m""",
}


# Files: written under the shared folder and read again.


def _book_pages(spark, sf):
    text = X.strip_space(X.strip_comments(F.col("text")))
    return _docs(spark, sf).select(F.col("source").alias("book_id"), F.col("doc_id").cast("int").alias("page_number"), text.alias("text"),
        (F.col("doc_id") % 100 / 100.0).alias("avg_confidence"))


def markdown_roundtrip(spark, sf):
    path = storage.scratch_path(spark, "markdown")
    D.write_books(D.book_markdown(_book_pages(spark, sf), {"ocr_engine": F.lit("engine"), "ocr_lang": F.lit("vi")}), path)
    return B.split_pages(D.read_markdown(spark, path), "book_id", "text").select("book_id", "page_number", F.md5("text").alias("hash"))


def pages_json_roundtrip(spark, sf):
    path = storage.scratch_path(spark, "pages")
    box = F.parse_json(F.lit("[1, 2, 3, 4]"))
    line = F.struct(F.col("text"), F.lit(0.5).alias("score"), box.alias("bbox"))
    D.write_books(D.book_json(_book_pages(spark, sf).withColumn("lines", F.array(line)), {"status": F.lit("running")}), path)
    rows = D.read_pages(spark, path, "*.txt")
    rect = O.rect_of(F.col("lines")[0]["bbox"])
    return rows.select("book_id", "status", "completed_pages", "page_number", F.md5("text").alias("hash"), "avg_confidence", rect["right"].alias("right"))


def csv_roundtrip(spark, sf):
    path = storage.scratch_path(spark, "csv")
    D.write_csv(_t(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.concat(F.lit('q "'), "text", F.lit('",\n2')).alias("question")), path)
    return D.read_csv(spark, path).select(F.col("question_id").cast("long").alias("question_id"), F.md5("question").alias("hash"))


def objective_scan(spark, sf):
    """What is searched for objectives at each lesson's start: of many pages of one number the last."""
    pages = _docs(spark, sf).select((F.col("doc_id") % 210).cast("int").alias("page_number"), "text", F.col("doc_id").alias("ord"))
    return B.objective_texts(pages, B.toc_table(spark)).select("lesson_id", F.md5("text").alias("hash"))


SQL |= {
    "markdown_roundtrip": r"""SELECT source AS book_id, CAST(doc_id AS INTEGER) AS page_number, md5(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'),
  '^\s+|\s+$', '', 'g')) AS hash FROM documents""",
    "pages_json_roundtrip": r"""SELECT source AS book_id, 'running' AS status, CAST(count(*) OVER (PARTITION BY source) AS INTEGER) AS completed_pages,
  CAST(doc_id AS INTEGER) AS page_number,
 md5(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '^\s+|\s+$', '', 'g')) AS hash, doc_id % 100 / 100.0 AS avg_confidence,
  3.0::DOUBLE AS "right" FROM documents""",
    "csv_roundtrip": "SELECT item_id AS question_id, md5('q \"' || text || '\",' || chr(10) || '2') AS hash FROM benchmark",
    "objective_scan": """WITH toc AS (SELECT printf('lesson_%02d', i + 1) AS lesson_id, 7 + (i * 191) // 44 AS a, 7 + ((i + 1) * 191) // 44 - 1 AS b FROM range(44) r(i)),
 p AS (SELECT doc_id % 210 AS n, arg_max(text, doc_id) AS text FROM documents GROUP BY 1),
 j AS (SELECT lesson_id, string_agg(text, chr(10) ORDER BY n) AS t FROM toc LEFT JOIN p ON n BETWEEN a AND least(b, a + 1) GROUP BY lesson_id)
 SELECT lesson_id, md5(coalesce(t, '')) AS hash FROM j""",
}


# Questions, accounts and evaluation.


def query_escape(spark, sf):
    text = F.concat(F.col("text"), F.lit(' gì? (a+b) [c]:"d" \\ /e/ !f ~g ^h {i} & | *-'))
    return _t(spark, sf, "benchmark").select("item_id", A.escaped(text).alias("escaped"))


def verification(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    body = F.when(k % 4 == 0, F.lit('{"is_faithful":false,"issues":["a","b"]}')).when(k % 4 == 1,
        F.lit('{"is_relevant":false,"verdict":"PASS"}')).when(k % 4 == 2, F.lit("{}"))
    v = A.verification(F.try_parse_json(body), F.col("event_id") % 9 == 0)
    return _t(spark, sf, "events").select("event_id", v.alias("v")).select("event_id", "v.verdict", "v.is_faithful", "v.is_relevant",
        F.array_join("v.issues", ",").alias("issues"), "v.skipped")


def _users(spark, sf):
    k = F.col("c_custkey")
    claim = lambda n, v: F.create_map(F.lit(n), F.lit(v))
    claims = F.when(k % 10 == 0, claim("admin", "true")).when(k % 50 == 7, claim("role", "super_admin")).when(k % 3 == 0, claim("admin", "false"))
    return _t(spark, sf, "customer").select(k.alias("uid"), F.concat(F.lit("U"), k.cast("string"), F.lit("@example.com")).alias("email"),
        (k % 4 == 0).alias("disabled"), claims.alias("claims"))


def token_check(spark, sf):
    k = F.col("event_id")
    flag = lambda n: F.when(k % n == 0, F.lit(True)).when(k % n == 1, F.lit(False))
    return _t(spark, sf, "events").select("event_id", U.token_status(k % 7 != 0, flag(11), flag(5)).alias("status"))


def user_me(spark, sf):
    return U.me(_users(spark, sf), "u12@EXAMPLE.com")


def user_admin(spark, sf):
    changes = _users(spark, sf).where("uid % 9 < 4").select("uid", (F.col("uid") % 2 == 0).alias("admin"))
    out = U.set_admin(_users(spark, sf), changes, "U4@example.com")
    return out.select("uid", "status", U.is_admin(F.col("claims")).alias("admin"))


def user_status(spark, sf):
    changes = _users(spark, sf).where("uid % 9 < 4").select("uid", (F.col("uid") % 2 == 0).alias("disabled"))
    return U.set_disabled(_users(spark, sf), changes, "U4@example.com").select("uid", "status", "disabled")


def user_super(spark, sf):
    out = U.make_super(_users(spark, sf), "U20@example.com").where("uid IN (10, 20, 21)")
    return out.select("uid", F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce("claims", F.create_map().cast("map<string,string>")))),
        lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("claims"))


def user_list(spark, sf):
    return U.listed(_users(spark, sf))


def user_reset(spark, sf):
    users = _users(spark, sf).withColumn("email", F.when(F.col("uid") % 6 != 0, F.col("email")))
    return U.reset_requests(users, F.concat(F.lit("https://reset.example/"), F.col("uid").cast("string")))


def user_history(spark, sf):
    c = _t(spark, sf, "conversations")
    made = c.groupBy(F.col("conv_id").alias("session_id")).agg(F.min_by(S.title(F.col("text")), "turn").alias("title"), F.max("turn").alias("created_at"))
    sessions = made.withColumn("user_id", F.concat(F.lit("u"), (F.col("session_id") % 5).cast("string"))).withColumn("messages", F.array())
    return S.history(sessions, "u3")


def messages_lost(spark, sf):
    c = _t(spark, sf, "conversations")
    sessions = c.where("conv_id % 10 <> 3").select(F.col("conv_id").alias("session_id")).distinct()
    return S.lost_messages(sessions, c.select(F.col("conv_id").alias("session_id"), "turn", "role"))


def chat_cooldown_stream(spark, sf):
    """The cooldown over a stream of requests, drained once."""
    out, state = storage.scratch_path(spark, "accepted"), storage.scratch_path(spark, "cooldown")
    # a pattern, since the source takes folders and patterns, and the table may be one file
    stream = spark.readStream.schema(_t(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")
    queues.drain(queues.cooldown(stream.select("user_id", "event_id", "ts"), COOLDOWN), out, state)
    return spark.read.parquet(out).where("accepted").select("user_id", "event_id")


def eval_metrics(spark, sf):
    labels, e = _t(spark, sf, "labels"), _t(spark, sf, "embeddings")
    q = F.floor(F.col("doc_id") / 10).cast("long").alias("question_id")
    contexts = labels.select(q, F.col("quality").alias("verdict"), F.expr("row_number() over (partition by floor(doc_id / 10) order by doc_id)").alias("rank"))
    made = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("made"))
    pairs = e.select("vec_id", F.col("embedding").alias("vector")).join(made,
        "vec_id").select(F.floor(F.col("vec_id") / 10).cast("long").alias("question_id"), "vector", "made")
    return V.metrics(contexts, labels.select(q, (F.col("toxic") == 0).alias("supported")),
        labels.where("doc_id % 2 = 0").select(q, (F.col("quality") == 1).alias("supported")), pairs)


def eval_open_cells(spark, sf):
    b = _t(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("question"), "item_id")
    cell = lambda n: F.when(F.col("item_id") % n == 0, F.lit(0.5))
    old = b.where("item_id % 4 <> 1").select("question", F.lit("a").alias("answer"), F.array(F.lit("c")).alias("contexts"),
        *[cell(n).alias(m) for n, m in enumerate(V.METRICS, 2)], F.when(F.col("item_id") % 5 == 0, F.lit("DONE")).otherwise(F.lit("ERROR")).alias("status"))
    return V.open_cells(V.resumed(b.drop("item_id"), old))


def eval_next_step(spark, sf):
    known = F.array(*map(F.lit, ("429 quota", "Limit reached", "ReadTimeout", "odd")))
    message = F.get(known, (F.col("event_id") % 4).cast("int"))
    step = V.next_step(message, F.lit("Error"), (F.col("event_id") % 5).cast("int"))
    return _t(spark, sf, "events").select("event_id", step["action"].alias("action"), step["rest"].alias("rest"))


_ME = "'U' || c_custkey || '@example.com'"
_ADMIN = "coalesce(c_custkey % 10 = 0, false)"
_SUPER = f"(c_custkey % 10 <> 0 AND c_custkey % 50 = 7 OR {_ME} = 'U4@example.com')"
SQL |= {
    "query_escape": r"""SELECT item_id, regexp_replace(text || ' gì? (a+b) [c]:"d" \ /e/ !f ~g ^h {i} & | *-', '([+\-&|!(){}\[\]^"~*?:\\/])', '\\\1',
  'g') AS escaped FROM benchmark""",
    "verification": """WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) % 4 AS k, event_id % 9 = 0 AS s FROM events)
 SELECT event_id, CASE WHEN NOT s AND k = 0 THEN 'FAIL' ELSE 'PASS' END AS verdict, s OR k <> 0 AS is_faithful, s OR k <> 1 AS is_relevant, CASE WHEN NOT s
  AND k = 0 THEN 'a,b' ELSE '' END AS issues, s AS skipped FROM e""",
    "token_check": """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'TOKEN_REVOKED' WHEN event_id % 5 = 0 THEN 'USER_DISABLED'
  WHEN event_id % 7 = 0 THEN 'INVALID' ELSE 'OK' END AS status FROM events""",
    "user_me": f"""SELECT c_custkey AS uid, CASE WHEN {_ADMIN} OR c_custkey = 12 THEN 'admin' ELSE 'user' END AS role, CASE
  WHEN c_custkey <> 12 THEN {_ME} END AS shown_email, c_custkey = 12 AS granted FROM customer""",
    "user_admin": f"""SELECT c_custkey AS uid, CASE WHEN c_custkey % 9 < 4 THEN CASE WHEN {_SUPER} THEN 403 ELSE 200 END END AS status,
 CASE WHEN c_custkey % 9 < 4 AND NOT {_SUPER} THEN c_custkey % 2 = 0 ELSE {_ADMIN} END AS admin FROM customer""",
    "user_status": f"""SELECT c_custkey AS uid, CASE WHEN c_custkey % 9 < 4 THEN CASE WHEN {_SUPER} AND c_custkey % 2 = 0 THEN 403 ELSE 200 END END AS status,
 CASE WHEN c_custkey % 9 < 4 AND NOT ({_SUPER} AND c_custkey % 2 = 0) THEN c_custkey % 2 = 0 ELSE c_custkey % 4 = 0 END AS disabled FROM customer""",
    "user_super": """SELECT c_custkey AS uid, CASE c_custkey WHEN 20 THEN 'admin=true,role=super_admin' WHEN 10 THEN 'admin=true'
  ELSE 'admin=false' END AS claims FROM customer WHERE c_custkey IN (10, 20, 21)""",
    "user_list": f"SELECT c_custkey AS uid, {_ME} AS email, c_custkey % 4 = 0 AS disabled, {_ADMIN} AS admin FROM customer ORDER BY c_custkey LIMIT 1000",
    "user_reset": """SELECT c_custkey AS uid, CASE WHEN c_custkey % 6 <> 0 THEN 200 ELSE 400 END AS status, CASE
  WHEN c_custkey % 6 <> 0 THEN 'https://reset.example/' || c_custkey END AS reset_link FROM customer""",
    "user_history": """SELECT conv_id AS session_id, min_by(CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END, turn) AS title,
  max(turn) AS created_at, 'u3' AS user_id FROM conversations WHERE conv_id % 5 = 3 GROUP BY conv_id""",
    "messages_lost": "SELECT conv_id AS session_id, turn, role FROM conversations WHERE conv_id % 10 = 3",
    "eval_metrics": """WITH v AS (SELECT doc_id // 10 AS question_id, quality AS verdict, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) AS rank
  FROM labels),
 p AS (SELECT *, sum(verdict) OVER (PARTITION BY question_id ORDER BY rank) / rank AS p FROM v),
 a AS (SELECT question_id, round(sum(p * verdict) / nullif(sum(verdict), 0), 6) AS context_precision FROM p GROUP BY 1),
 f AS (SELECT doc_id // 10 AS question_id, round(avg((toxic = 0)::INTEGER), 6) AS faithfulness FROM labels GROUP BY 1), r AS (SELECT doc_id // 10 AS question_id,
  round(avg((quality = 1)::INTEGER), 6) AS context_recall FROM labels WHERE doc_id % 2 = 0 GROUP BY 1),
 m AS (SELECT a.vec_id // 10 AS question_id, round(avg(list_dot_product(a.embedding::DOUBLE[],
  b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[],
  b.embedding::DOUBLE[])))), 6) AS answer_relevancy
 FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id + 1 GROUP BY 1)
 SELECT question_id, context_precision, context_recall, faithfulness, answer_relevancy FROM a FULL JOIN f USING (question_id) FULL
  JOIN r USING (question_id) FULL JOIN m USING (question_id)""",
    "eval_open_cells": """WITH m AS (SELECT unnest(['context_precision', 'context_recall', 'faithfulness', 'answer_relevancy']) AS metric, unnest([2, 3, 4, 5]) AS n)
 SELECT CAST(item_id AS VARCHAR) AS question, metric FROM benchmark, m WHERE CASE WHEN item_id % 4 = 1 THEN true ELSE item_id % 5 <> 0 AND item_id % n <> 0 END""",
    "eval_next_step": """SELECT event_id, CASE WHEN event_id % 4 < 2 THEN CASE WHEN event_id % 5 >= 3 THEN 'next_key' ELSE 'again' END
  WHEN event_id % 4 = 2 THEN 'again' ELSE 'give_up' END AS action,
 CASE WHEN event_id % 4 < 2 THEN CASE WHEN event_id % 5 >= 3 THEN 0 ELSE 65 END ELSE 10 END AS rest FROM events""",
}

NAMES = """ocr_lists ocr_rows page_images box_kinds line_fallback entity_normalise graph_of_chunks graph_lessons enrich_run enrich_status graph_sync embed_run
error_route error_summaries markdown_roundtrip pages_json_roundtrip csv_roundtrip objective_scan query_escape verification token_check user_me user_admin user_status user_super
user_list user_reset user_history messages_lost chat_cooldown_stream eval_metrics eval_open_cells eval_next_step""".split()
QUERIES = {n: globals()[n] for n in NAMES}
