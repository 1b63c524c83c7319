"""The query catalog over the driver's tables, each with SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import storage
from foliant.functions import text as X
from foliant.operators import books as B
from foliant.operators import extraction as E
from foliant.operators import objectives as O
from foliant.operators import retrieval as R
from foliant.operators import sessions as S
from foliant.plans import services

CHARS, COOLDOWN, QUERIES = 500, 6 * 3600, "benchmark"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark, sf):
    return _t(spark, sf, "documents")


def _lines(spark, sf):
    return _docs(spark, sf).select("doc_id", "source", (F.col("doc_id") % 210).cast("int").alias("page_number"), F.posexplode(F.split("text", "\n")).alias("ord", "line"))


def _boxes(spark, sf):
    rows = _lines(spark, sf)
    top, left = (F.col("ord") * 37 % 11) * 10.0, (F.col("ord") * 53 % 7) * 5.0
    score = (F.col("doc_id") * 31 + F.col("ord") * 17) % 128 / 128.0
    return rows.select("doc_id", "ord", F.col("line").alias("text"), top.alias("top"), left.alias("left"), score.alias("score"))


def _marked(spark, sf):
    n = (F.col("doc_id") % 210).cast("string")
    text = F.concat(F.lit("lost <!-- OCR_PAGE: "), n, F.lit(" -->\n"), F.replace("text", F.lit("\n"), F.lit("\n<!-- ocr_page:7-->  <!-- note -->")))
    return _docs(spark, sf).select("doc_id", text.alias("text"))


def html_comment_strip(spark, sf):
    return _t(spark, sf, "pages").select("page_id", X.strip_comments(F.col("html")).alias("body"))


def page_marker_split(spark, sf):
    return B.split_pages(_marked(spark, sf), "doc_id", "text").select("doc_id", "ord", "page_number", F.length("text").alias("n_chars"), F.md5("text").alias("hash"))


def reading_order(spark, sf):
    return B.reading_order(_boxes(spark, sf), ["doc_id"]).select("doc_id", "ord", "position")


def page_confidence(spark, sf):
    return B.page_records(_boxes(spark, sf), ["doc_id"]).select("doc_id", F.md5("text").alias("hash"), "avg_confidence")


def toc_interval_join(spark, sf):
    pages = _docs(spark, sf).select("doc_id", (F.col("doc_id") % 210).cast("int").alias("page_number"))
    return B.lessons_of_pages(pages, B.toc_table(spark)).select("doc_id", "page_number", "lesson_id")


def out_of_toc_pages(spark, sf):
    return toc_interval_join(spark, sf).where(F.col("lesson_id") == B.OUTSIDE).groupBy("page_number").agg(F.count(F.lit(1)).alias("n"))


def section_headings(spark, sf):
    return _lines(spark, sf).where(X.is_heading(F.col("line"))).select("doc_id", "ord", X.clean_title(F.col("line")).alias("title"))


def accent_fold(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(X.match_key(F.col("text"))).alias("hash"))


def _lesson_pages(spark, sf):
    """Documents as pages of books, by source, in lessons of the table of contents."""
    pages = _docs(spark, sf).select("doc_id", "source", "text", (F.col("doc_id") % 210).cast("int").alias("page_number"))
    return B.lessons_of_pages(pages, B.toc_table(spark))


def section_blocks(spark, sf):
    blocks = B.lesson_blocks(_lesson_pages(spark, sf), ["source", "lesson_id"], "doc_id", "lesson_title")
    return blocks.select("source", "lesson_id", "section", F.array_join("pages", ",").alias("pages"), "first", F.md5("text").alias("hash"))


def greedy_pack(spark, sf):
    pieces = _docs(spark, sf).select("doc_id", F.posexplode(B.pack_lines(F.col("text"), CHARS)).alias("piece", "t"))
    return pieces.select("doc_id", "piece", F.length("t").alias("n_chars"), F.md5("t").alias("hash"))


def toc_chunks(spark, sf):
    blocks = B.lesson_blocks(_lesson_pages(spark, sf), ["source", "lesson_id"], "doc_id", "lesson_title")
    out = B.chunks(blocks, "source", "lesson_id", "lesson_title", CHARS)
    return out.select("source", "lesson_id", "chunk_id", "chunk_index", "global_chunk_index", "section", "source_pages", F.md5("markdown_content").alias("hash"))


def legacy_chunks(spark, sf):
    text = F.concat(F.lit("before\n# Bài "), F.col("doc_id").cast("string"), F.lit("\n"), F.replace("text", F.lit("\n"), F.lit("\n## ")))
    out = B.heading_chunks(_docs(spark, sf).select("doc_id", text.alias("text")), "doc_id", "text")
    return out.select("doc_id", "chunk_id", "idx", "grade", F.md5("section").alias("section"), F.md5("lesson").alias("lesson"), F.md5("text").alias("hash"))


def objective_extract(spark, sf):
    text = F.concat(F.lit("Mở\nYÊU CẦU CẦN ĐẠT\n• Nêu được "), F.replace("text", F.lit("\n"), F.lit("\n• Trình bày được ")))
    return _docs(spark, sf).select("doc_id", F.array_join(O.extract(text), "|").alias("objectives"))


def objective_dedupe(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(O.unique(F.split("text", " ")), " ").alias("kept"))


def lesson_merge(spark, sf):
    d = _docs(spark, sf)
    lesson = F.concat(F.lit("l"), F.col("doc_id").cast("string")).alias("lesson_id")
    objectives = lambda cond: F.when(cond, F.array(F.col("source"), F.col("lang"))).otherwise(F.array().cast("array<string>"))
    every = lambda n: F.col("doc_id") % n == 0
    new = d.where(~every(3)).select(lesson, F.lit("new").alias("title"), objectives(every(2)).alias("objectives"), F.lit("ocr:auto").alias("source"))
    title, source = F.when(~every(7), F.lit("old")), F.when(every(4), F.lit("hand")).otherwise(F.lit("ocr:x"))
    old = d.where(~every(5)).select(lesson, title.alias("title"), F.array(F.lit("kept")).alias("objectives"), source.alias("source"), every(11).alias("reviewed"))
    return B.merge_lessons(new, old, force=False).select("lesson_id", "title", F.array_join("objectives", ",").alias("objectives"), "source", "reviewed")


def resume_pending(spark, sf):
    return B.pending_pages(_docs(spark, sf).select("doc_id", "source"), _t(spark, sf, "labels"), ["doc_id"])


def _upserted(spark, sf):
    d = _docs(spark, sf)
    body, entities, nobody = F.col("lang").alias("body"), F.col("n_chars").alias("entities"), F.lit(None).cast("string").alias("replaced_by")
    base = d.where("doc_id % 2 = 0").select("doc_id", "source", body, entities, F.lit(True).alias("active"), nobody)
    delta = d.where("doc_id % 3 = 0 AND source IN ('src1', 'src2', 'src3')").select("doc_id", "source", F.lit("new").alias("body"))
    return B.upsert(base, delta, "doc_id", ["entities"], "source", "run-2")


def chunk_upsert(spark, sf):
    return _upserted(spark, sf)


def purge_inactive(spark, sf):
    return B.purge(_upserted(spark, sf), "source", ["src1", "src2", "src3"])


def url_rewrite(spark, sf):
    urls = spark.createDataFrame([("/The", "https://img.example/1.png"), ("/and", "https://img.example/2.png")], "local_ref string, url string")
    pages = _t(spark, sf, "pages").where(F.col("html").contains("/The") | F.col("html").contains("/and"))
    return B.rewrite_by(pages.select("page_id", "html"), "html", urls).select("page_id", F.md5("html").alias("hash"))


def json_props(spark, sf):
    e = _t(spark, sf, "events")
    v = E.parsed(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
    return e.select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"))


def json_repair(spark, sf):
    e = _t(spark, sf, "events")
    v = E.parsed(F.concat(F.lit("Here: "), F.regexp_replace("props", r"\}$", ",}"), F.lit(" end }")))
    return e.select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"))


def entity_lists(spark, sf):
    middle = F.lit('","ung_dung_thanh_tuu":null,"y_nghia_sinh_hoc":')
    head, tail = F.lit('{"khai_niem_dinh_nghia":["a","'), F.lit(',"tom_tat_cot_loi":null}')
    body = F.concat(head, F.col("lang"), F.lit('"],"co_che_qua_trinh":"'), F.col("source"), middle, F.col("doc_id").cast("string"), tail)
    x = _docs(spark, sf).select("doc_id", E.entity_lists(F.parse_json(body)).alias("x"))
    return x.select("doc_id", *[F.array_join(f"x.{k}", ",").alias(k) for k in E.ENTITIES], f"x.{E.SUMMARY}")


def secret_redact(spark, sf):
    masked = X.redact(F.col("text"), r"[\w.+-]+@[\w-]+\.[a-z]+|AIza[0-9A-Za-z_-]{10,}", ("Licensed",), "[REDACTED]")
    return _docs(spark, sf).select("doc_id", F.md5(masked).alias("hash"))


#: All but letters, blanks and line feeds, as ranges alone: a negated class of ranges and single characters takes twelve times as long.
_ODD = r"[\x00-\x09\x0B-\x1F\x21-\x40\x5B-\x60\x7B-\x{10FFFF}]+"


def text_preview(spark, sf):
    return _docs(spark, sf).select("doc_id", X.preview(F.regexp_replace("text", _ODD, ""), 120).alias("preview"))


def _deduped(docs):
    words = docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "value"))
    return E.dedupe_values(words.select("doc_id", "pos", F.regexp_replace("value", "[^a-zA-Z]", "").alias("value")), ["doc_id"])


def entity_dedupe(spark, sf):
    return _deduped(_docs(spark, sf))


def graph_nodes(spark, sf):
    # a document has each name once, so that its id alone is the order
    return E.nodes(entity_dedupe(spark, sf), "KhaiNiemV2", seq="doc_id", props=("doc_id",))


def graph_edges(spark, sf):
    d, v = _docs(spark, sf), entity_dedupe(spark, sf)
    doc = d.select("source", F.col("doc_id").cast("string").alias("doc"))
    return E.edges(doc, "CO_PHAN_DOAN", "source", "doc").unionByName(E.edges(v.withColumn("doc", F.col("doc_id").cast("string")), "DINH_NGHIA", "doc", "value", unique=True))


def concept_degree(spark, sf):
    return graph_edges(spark, sf).where("type = 'DINH_NGHIA'").groupBy("dst").agg(F.count(F.lit(1)).alias("degree"))


def embed_pending(spark, sf):
    return _docs(spark, sf).where(F.col("text") != "").select("doc_id", "n_chars").join(_t(spark, sf,
        "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


def _texts(spark, sf):
    return _docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), "text")


def _items(spark, sf):
    e = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return e.join(_texts(spark, sf).select("chunk_id"), "chunk_id")


def _vector_queries(spark, sf):
    return _t(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _hybrid_queries(spark, sf):
    b = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return b.join(_t(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")


def vector_topk(spark, sf):
    items = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return R.vector_search(items, _vector_queries(spark, sf), 10).select("query_id", "chunk_id", "score", "rank")


def bm25_topk(spark, sf):
    return R.keyword_search(_texts(spark, sf), _hybrid_queries(spark, sf), 10).select("query_id", "chunk_id", "score", "rank")


def hybrid_retrieve(spark, sf):
    return R.hybrid(_items(spark, sf), _hybrid_queries(spark, sf), texts=_texts(spark, sf)).select("query_id", "chunk_id", "score", "rank")


def graph_expand(spark, sf):
    found = storage.stored(vector_topk(spark, sf), "hits")
    wanted = storage.hinted(found.select(F.col("chunk_id").alias("doc_id")).distinct())
    docs = _docs(spark, sf).join(wanted, "doc_id", "left_semi")
    hits = found.join(docs.select(F.col("doc_id").alias("chunk_id"), "source", "lang"), "chunk_id")
    # concepts of the found chunks alone
    named = _deduped(docs).groupBy(F.col("doc_id").alias("chunk_id"))
    concepts = named.agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("concepts"))
    return hits.join(concepts, "chunk_id", "left").select("query_id", "chunk_id", "source", "score", "concepts")


def rerank_threshold(spark, sf):
    v = vector_topk(spark, sf).withColumn("score", F.round(F.col("score") - F.when(F.col("query_id") % 100 == 0, F.lit(2.0)).otherwise(F.lit(0.3)), 6))
    return R.keep_relevant(v.drop("rank"), 5).select("query_id", "chunk_id", "score", "rank")


def context_assembly(spark, sf):
    hits = storage.hinted(storage.stored(vector_topk(spark, sf).where("rank <= 3"), "hits"))
    v = _docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("lesson"), "text").join(hits, "chunk_id")
    return R.context(v).select("query_id", F.md5("context").alias("hash"))


def verify_defaults(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    body = F.when(k % 4 == 0, F.lit('{"is_faithful":false}')).when(k % 4 == 1, F.lit('{"is_relevant":false,"verdict":"PASS"}')).when(k % 4 == 2, F.lit("{}"))
    return _t(spark, sf, "events").select("event_id", R.verdict(F.try_parse_json(body)).alias("verdict"))


def chat_cooldown(spark, sf):
    return S.accepted_requests(_t(spark, sf, "events").select("user_id", "event_id", "ts"), COOLDOWN).where("accepted").select("user_id", "event_id")


def history_list(spark, sf):
    c = _t(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.min_by(S.title(F.col("text")), "turn").alias("title"), F.max("turn").alias("last_turn"))


def session_get(spark, sf):
    return _t(spark, sf, "conversations").where("conv_id = 7").select("turn", "role", "text")


def session_delete(spark, sf):
    return _t(spark, sf, "conversations").where("conv_id <> 7").groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def push_messages(spark, sf):
    c = _t(spark, sf, "conversations")
    held = c.where("turn < 2 AND conv_id % 10 <> 3").groupBy(F.col("conv_id").alias("session_id")).agg(F.array_sort(F.collect_list(F.struct("turn",
        "role", "text"))).alias("messages"))
    new = c.where("turn >= 2").select(F.col("conv_id").alias("session_id"), "turn", "role", "text")
    return S.push(held, new).select("session_id", F.size("messages").alias("n"), F.md5(F.array_join(F.transform("messages", lambda m: m["text"]), "\n")).alias("hash"))


def _users(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", F.concat(F.regexp_replace("c_name", "#", "."), F.lit("@Example.com")).alias("email"),
        F.lit("user").alias("role"), F.coalesce(F.col("c_acctbal") < 0, F.lit(False)).alias("disabled"))


def user_search(spark, sf):
    return _users(spark, sf).where(F.lower("email").contains("99@example")).select("c_custkey", "email")


def user_page(spark, sf):
    return _users(spark, sf).orderBy("c_custkey").limit(1000).select("c_custkey", "email", "role", "disabled")


def role_update(spark, sf):
    first = [f"Customer.{i:09d}@example.com" for i in range(1, 60)]
    return S.set_role(_users(spark, sf), first, "admin", first[0]).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def source_title(spark, sf):
    pages = F.array_join(F.array(F.col("doc_id") % 210, F.col("doc_id") % 210 + 1), ", ")
    return _docs(spark, sf).select("doc_id", F.concat(F.lit("Nguồn "), F.col("doc_id").cast("string"), F.lit(": "), F.col("source"),
        F.when(F.col("lang") != "en", F.concat(F.lit(" - "), F.col("lang"))).otherwise(F.lit("")), F.lit(" (Trang "), pages, F.lit(")")).alias("title"))


def eval_precision_recall(spark, sf):
    v = _t(spark, sf, "labels").select((F.col("doc_id") / 10).cast("bigint").alias("question_id"), F.col("quality").alias("verdict"), "doc_id")
    return S.precision_at_k(v.withColumn("rank", F.expr("row_number() over (partition by question_id order by doc_id)")))


def eval_summary(spark, sf):
    return eval_precision_recall(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("context_precision"), 4).alias("context_precision"),
        F.round(F.avg("context_recall"), 4).alias("context_recall"))


def eval_resume(spark, sf):
    old = _t(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, F.lit("ERROR")).otherwise(F.lit("DONE")).alias("status"))
    return _docs(spark, sf).select("doc_id").join(old, "doc_id", "left").where(~F.col("status").eqNullSafe("DONE")).select("doc_id",
        F.coalesce("status", F.lit("PENDING")).alias("status"))


NAMES = """html_comment_strip page_marker_split reading_order page_confidence toc_interval_join out_of_toc_pages section_headings accent_fold
section_blocks greedy_pack toc_chunks legacy_chunks objective_extract objective_dedupe lesson_merge resume_pending chunk_upsert purge_inactive
url_rewrite json_props json_repair entity_lists secret_redact text_preview entity_dedupe graph_nodes graph_edges concept_degree
embed_pending vector_topk bm25_topk hybrid_retrieve graph_expand rerank_threshold context_assembly verify_defaults chat_cooldown history_list
session_get session_delete push_messages user_search user_page role_update source_title eval_precision_recall eval_summary eval_resume""".split()
CATALOG = {n: globals()[n] for n in NAMES} | services.QUERIES
