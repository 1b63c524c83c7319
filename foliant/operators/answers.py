"""Prompts, retrieval with reranking, and checked answers, for many questions at once."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant import providers as P
from foliant.operators import retrieval as R
from foliant.operators.extraction import ENTITIES, SUMMARY

#: Fixed value: the answer where nothing was found.
REFUSAL = "Xin lỗi, tôi không tìm thấy thông tin liên quan trong sách giáo khoa Sinh Học 12."
UNKNOWN_ISSUES = "Không xác định cụ thể."
#: Results that are reranked at most, and the least relevance that stays.
CANDIDATES, LEAST_RELEVANCE = 10, 0.05


def extraction_prompt(chunks: DataFrame) -> Column:
    """What a model is asked of a chunk: its place in the book, the JSON wanted, its text. Columns that are null count as empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    listed = lambda c: F.coalesce(F.to_json(c), F.lit("[]"))
    wanted = json.dumps({k: ["..."] for k in ENTITIES} | {SUMMARY: "..."}, ensure_ascii=False)
    head = "Trích xuất kiến thức từ đoạn sách giáo khoa dưới đây. Chỉ dùng nội dung có trong đoạn, sửa nhẹ lỗi OCR, giữ nguyên thẻ hình ảnh.\n"
    parts = [
        F.lit(head + "Sách: "), text("book_id"), F.lit("\nBài: "), text("lesson_title"), F.lit("\nMục: "), text("section"),
            F.lit("\nYêu cầu cần đạt: "), listed("learning_objectives"),
        F.lit("\nTrang: "), listed("pages"),
            F.lit(f"\nTrả về một đối tượng JSON như sau, mục không có thông tin là [] hoặc chuỗi rỗng:\n{wanted}\n\nĐoạn:\n"), text("markdown_content"),
    ]
    return F.concat(*parts)


def extraction_again(prompt: str, response: str, error: Exception) -> str:
    """The prompt after a response that couldn't be read."""
    shown = " ".join(response.split())
    shown = shown if len(shown) <= 1200 else shown[:1200].rstrip() + "..."
    return f"Câu trả lời trước không phải JSON hợp lệ ({P.shown(error)}). Chỉ trả lời bằng JSON, không giải thích.\nCâu trả lời trước:\n{shown}\n\n{prompt}"


def answer_prompt(context: str, query: str, issues: list[str] | None = None) -> str:
    """A question with its sources; after a failed check also what was wrong."""
    rules = "Chỉ trả lời dựa trên tài liệu. Không thêm ví dụ hay kiến thức ngoài. Nếu tài liệu không có câu trả lời, hãy nói rõ."
    if issues is not None:
        rules += "\nCâu trả lời trước có lỗi, hãy tránh:\n" + ("\n".join(f"- {i}" for i in issues) or UNKNOWN_ISSUES)
    return f"{rules}\n\nTài liệu:\n{context}\nCâu hỏi:\n{query}"


def check_prompt(context: str, query: str, answer: str) -> str:
    wanted = '{"is_faithful": true, "is_relevant": true, "issues": [], "verdict": "PASS"}'
    rules = "Kiểm tra câu trả lời: mọi khẳng định phải có trong tài liệu và đúng trọng tâm câu hỏi. Từ chối hợp lệ là PASS."
    return f"{rules}\nTrả về JSON như {wanted}\n\nTài liệu:\n{context}\nCâu hỏi:\n{query}\n\nCâu trả lời:\n{answer}"


def escaped(query: Column) -> Column:
    """A query with every special character of Lucene's syntax behind a backslash."""
    return F.regexp_replace(query, r'([+\-&|!(){}\[\]^"~*?:\\/])', r"\\$1")


def retrieve_context(items: DataFrame, queries: DataFrame, k: int = 3, reranker: Callable[[], P.Reranker] | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: the best ``k`` chunks of every query (query_id, text, vector).

    Vector and keyword results, max(3k, 10) of each, are fused; a query with blank text or without a keyword hit keeps
    its vector results and their scores. With a reranker the first CANDIDATES of a query with text are scored by it, and
    those under LEAST_RELEVANCE go, but for the best; a call that fails leaves the fused order.
    """
    wide = R.hybrid(items, queries, max(CANDIDATES, k), max(3 * k, 10))
    if reranker is None:
        return wide.where(F.col("rank") <= k)
    asked = F.coalesce(F.trim("query"), F.lit("")) != ""
    named = wide.where(F.col("rank") <= CANDIDATES).join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    texts = items.select("chunk_id", F.coalesce("text", F.lit("")).alias("text"))
    scored = P.rerank(named.where(asked).join(texts, "chunk_id"), reranker)
    w = Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), "rank")
    ordered = scored.withColumn("new", F.row_number().over(w))
    fine = F.col("relevance").isNull() | (F.col("relevance") >= LEAST_RELEVANCE) | (F.col("new") == 1)
    best = ordered.where((F.col("new") <= k) & fine).select("query_id", "chunk_id", F.coalesce(F.round("relevance", 6), "score").alias("score"),
        F.col("new").alias("rank"))
    return best.unionByName(named.where(~asked & (F.col("rank") <= k)).select("query_id", "chunk_id", "score", "rank"))


def expanded(hits: DataFrame, in_lesson: DataFrame, lessons: DataFrame, defines: DataFrame) -> DataFrame:
    """``hits`` (query_id, chunk_id, score, rank) with lesson and concepts from the graph's edges and nodes.

    A chunk without a lesson goes; one of two lessons is two rows; concepts are distinct and sorted, perhaps none.
    """
    few = hits.select("chunk_id").distinct()
    concepts = defines.join(few, F.col("src") == F.col("chunk_id")).groupBy("chunk_id").agg(F.array_sort(F.collect_set("dst")).alias("concepts"))
    named = in_lesson.select(F.col("src").alias("key"), F.col("dst").alias("chunk_id")).join(lessons.select("key",
        F.col("lesson_title").alias("lesson")), "key").drop("key")
    out = hits.join(named, "chunk_id").join(concepts, "chunk_id", "left")
    return out.select(*hits.columns, "lesson", F.coalesce("concepts", F.array().cast("array<string>")).alias("concepts"))


def sources(records: DataFrame) -> DataFrame:
    """query_id, sources: what an answer shows of its records, in rank order: lesson, text, concepts, score, section, pages."""
    shown = F.struct("rank", "lesson", "text", "concepts", "score", "section", "pages")
    rows = F.array_sort(F.collect_list(shown))
    return records.groupBy("query_id").agg(F.transform(rows, lambda r: r.dropFields("rank")).alias("sources"))


CHECK = T.StructType(
    [T.StructField("verdict", T.StringType()), T.StructField("is_faithful", T.BooleanType()), T.StructField("is_relevant", T.BooleanType()),
        T.StructField("issues", T.ArrayType(T.StringType())), T.StructField("skipped", T.BooleanType()), T.StructField("error", T.StringType())]
)


def checked(model: P.LanguageModel, context: str | None, query: str, answer: str, enabled: bool = True) -> dict:
    """A check of an answer. Without one, sources or the wish for it, it's passed and skipped; a check that fails passes too."""
    fine = {"verdict": "PASS", "is_faithful": True, "is_relevant": True, "issues": [], "skipped": False, "error": None}
    if not (enabled and context and answer):
        return fine | {"skipped": True}
    try:
        said = json.loads(model.generate(check_prompt(context, query, answer), as_json=True))
        flags = {k: said.get(k, True) for k in ("is_faithful", "is_relevant")}
        verdict = said.get("verdict", "PASS" if all(flags.values()) else "FAIL")
        return fine | {k: bool(v) for k, v in flags.items()} | {"issues": [str(i) for i in said.get("issues") or []], "verdict": str(verdict)}
    except Exception as e:
        return fine | {"error": P.shown(e)}


def answer(questions: DataFrame, make: Callable[[], P.LanguageModel], verify: bool = True, temperature: float = 0.1) -> DataFrame:
    """query_id, answer, verification, regenerated of every question (query_id, query, context).

    Without sources the answer is REFUSAL. An answer that fails its check is made once more, told what was wrong, and
    checked again, whatever comes of it.
    """
    fields = [T.StructField("answer", T.StringType()), T.StructField("verification", CHECK), T.StructField("regenerated", T.BooleanType())]

    def start():
        model = make()

        def one(query, context):
            query = query or ""
            if not context:
                return REFUSAL, checked(model, None, query, REFUSAL, verify), False
            said = model.generate(answer_prompt(context, query), temperature=temperature)
            check = checked(model, context, query, said, verify)
            if check["verdict"] != "FAIL":
                return said, check, False
            said = model.generate(answer_prompt(context, query, check["issues"]), temperature=0.0)
            return said, checked(model, context, query, said, verify), True

        return lambda queries, contexts: [list(c) for c in zip(*map(one, queries, contexts), strict=True)]

    return P.by_batches(questions, ["query_id"], start, fields, ["query", "context"], 1)


def verification(v: Column, skipped: Column | None = None) -> Column:
    """A verifier's answer, a variant, as a struct of CHECK: flags default to true, an explicit verdict is trusted; none at all passes, and so does a skipped one."""
    flag = lambda k: F.coalesce(F.try_variant_get(v, f"$.{k}", "boolean"), F.lit(True))
    issues = F.coalesce(F.try_variant_get(v, "$.issues", "array<string>"), F.array().cast("array<string>"))
    skip = F.coalesce(skipped, F.lit(False)) if skipped is not None else F.lit(False)
    said = F.when(~skip, R.verdict(v)).otherwise(F.lit("PASS"))
    none = F.array().cast("array<string>")
    parts = [said.alias("verdict"), (skip | flag("is_faithful")).alias("is_faithful"), (skip | flag("is_relevant")).alias("is_relevant"),
        F.when(skip, none).otherwise(issues).alias("issues")]
    return F.struct(*parts, skip.alias("skipped"))
