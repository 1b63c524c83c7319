"""Entities of model responses, whatever shape they come in, as clean lists; and the graph of books, lessons, chunks and entities."""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import text as X
from foliant.operators.extraction import ENTITIES, SUMMARY

#: Fixed value: the fields by which an object names itself, in order of priority.
NAMES = ("ten", "name", "title", "khai_niem", "noi_dung", "text")
SCHEMA = T.StructType([*[T.StructField(k, T.ArrayType(T.StringType())) for k in ENTITIES], T.StructField(SUMMARY, T.StringType())])


def plain(value: object) -> str:
    """A value as one string: an object by its name or as JSON, a list joined, null empty."""
    match value:
        case None:
            return ""
        case dict():
            name = next(filter(None, map(value.get, NAMES)), None)
            text = json.dumps(value, ensure_ascii=False, sort_keys=True) if name is None else str(name)
        case list():
            text = "; ".join(filter(None, map(plain, value)))
        case _:
            text = str(value)
    return text.strip()


def unique(texts: Iterable[str]) -> list[str]:
    """The first of each but for case, without empty ones."""
    first: dict[str, str] = {}
    for t in filter(None, texts):
        first.setdefault(t.casefold(), t)
    return list(first.values())


def gathered(raw: object) -> dict[str, list[str] | str]:
    """Entity lists and summary of a response: an object, a list of objects and others, or a value that is all summary."""
    parts = raw if isinstance(raw, list) else [raw]
    listed = lambda v: v if isinstance(v, list) else [v]
    out: dict = {k: unique(plain(v) for p in parts if isinstance(p, dict) for v in listed(p.get(k))) for k in ENTITIES}
    summaries = [plain(p.get(SUMMARY) if isinstance(p, dict) else p) for p in parts]
    return out | {SUMMARY: " ".join(unique(summaries))}


def folded_unique(values: Column) -> Column:
    """unique() of an array of strings, inside the JVM: sorted by key and place, so that only neighbours are compared."""
    cleaned = F.filter(F.transform(values, X.strip_space), lambda v: v != "")
    keyed = F.sort_array(F.transform(cleaned, lambda v, i: F.struct(X.casefold(v).alias("key"), i.alias("at"), v.alias("value"))))
    first = lambda rows: F.filter(rows, lambda x, i: (i == 0) | (F.get(rows, i - 1)["key"] != x["key"]))
    return X.let(keyed, lambda rows: F.transform(F.sort_array(F.transform(first(rows), lambda x: F.struct(x["at"], x["value"]))), lambda x: x["value"]))


def normalised(raw: Column) -> Column:
    """Struct of the six lists and the summary from a response's JSON text; null or broken JSON gives empty ones.

    Responses of the asked-for shape, lists of strings, stay inside the JVM. Others, of any depth, go to Python in Arrow
    batches; for the former that column is null and costs nothing.
    """
    kind = lambda v, k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))

    def asked_for(v):
        lists = reduce(lambda a, b: a & b, [F.coalesce(kind(v, k).isin("ARRAY<STRING>", "ARRAY<VOID>", "VOID"), F.lit(True)) for k in ENTITIES])
        return lists & F.coalesce(kind(v, SUMMARY).isin("STRING", "VOID"), F.lit(True)) & F.schema_of_variant(v).startswith("OBJECT")

    # bound by let(), the text is parsed once a use and not once a key
    simple = F.coalesce(X.let(F.try_parse_json(raw), asked_for), F.lit(False))
    none = F.array().cast("array<string>")
    lists = lambda read: [F.coalesce(folded_unique(F.filter(read[k], lambda x: x.isNotNull())), none).alias(k) for k in ENTITIES]
    native = lambda read: F.struct(*lists(read), F.coalesce(X.strip_space(read[SUMMARY]), F.lit("")).alias(SUMMARY))
    odd = _gathered_batch(F.when(~simple, F.coalesce(F.when(F.try_parse_json(raw).isNotNull(), raw), F.lit("null"))))
    return F.when(simple, X.let(F.from_json(raw, SCHEMA), native)).otherwise(odd)


@F.pandas_udf(SCHEMA)
def _gathered_batch(raw: pd.Series) -> pd.DataFrame:
    rows = [gathered(json.loads(t)) if t is not None else dict.fromkeys([*ENTITIES, SUMMARY]) for t in raw]
    return pd.DataFrame(rows, columns=[*ENTITIES, SUMMARY])


def lesson_key(chunks: DataFrame) -> Column:
    """book_lesson; a null or empty lesson id gives way to the title, and that to unknown."""
    lesson = F.coalesce(F.nullif(F.col("lesson_id"), F.lit("")), F.col("lesson_title"), F.lit("unknown"))
    return F.concat_ws("_", F.coalesce(F.col("book_id"), F.lit("None")), lesson)


LESSON = ("lesson_title", "lesson_id", "grade", "source_level", "learning_objectives", "lesson_page_start", "lesson_page_end")
CHUNK = ("markdown_content", "section_title", "summary", "source_pages", "chunk_index", "parser")


def graph(chunks: DataFrame, order: str = "global_chunk_index") -> tuple[dict[str, DataFrame], DataFrame]:
    """Node tables by label, each with key and properties, and edges (src, type, dst).

    ``chunks``: chunk_id, book_id, the columns of LESSON and CHUNK that they have, and entities, normalised()'s struct.
    There's one node a key; of its properties the last in ``order`` stand, chunk_id telling ties apart. Entities are told
    apart by their exact name, across chunks. A chunk without entities keeps its node.
    """
    c = chunks.withColumn("__lesson", lesson_key(chunks)).withColumn("__at", F.struct(F.coalesce(order, F.lit(-1)), "chunk_id"))
    has = lambda names: [n for n in names if n in chunks.columns]

    def last(key, names):
        kept = c.groupBy(F.col(key).alias("key")).agg(F.max_by(F.struct(*names), "__at").alias("p"))
        return kept.select("key", "p.*")

    nodes = {"Sach": c.select(F.col("book_id").alias("key")).distinct(), "BaiHocV2": last("__lesson", has(LESSON)), "PhanDoanV2": last("chunk_id", has(CHUNK))}
    edge = lambda src, kind, dst: c.select(F.col(src).alias("src"), F.lit(kind).alias("type"), F.col(dst).alias("dst"))
    edges = edge("book_id", "BAO_GOM", "__lesson").unionByName(edge("__lesson", "CO_PHAN_DOAN", "chunk_id"))
    named = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(kind).alias("type"), F.col(f"entities.{k}").alias("names")) for k, (label, kind) in ENTITIES.items()])
    each = c.select("chunk_id", F.explode(named).alias("e")).select("chunk_id", "e.label", "e.type", F.explode("e.names").alias("name"))
    for label, _ in ENTITIES.values():
        nodes[label] = each.where(F.col("label") == label).select(F.col("name").alias("key")).distinct()
    edges = edges.unionByName(each.select(F.col("chunk_id").alias("src"), "type", F.col("name").alias("dst")))
    return nodes, edges.distinct()


def merged_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes of both; where a key is in both, the new properties, as a graph that is only added to has them. Rebuild the graph instead to lose what is stale."""
    return new.unionByName(old.join(new.select("key"), "key", "left_anti"), allowMissingColumns=True)


def merged_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).distinct()
