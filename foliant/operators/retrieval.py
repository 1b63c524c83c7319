"""Vector, keyword and fused retrieval for many queries at once."""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from foliant.operators import nearest
from foliant.storage import hinted, stored

K1, B, RRF = 1.2, 0.75, 60
#: So many queries' vectors travel to the items at once; more go in rounds.
QUERIES_AT_ONCE = 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def cosine(a: Column, b: Column) -> Column:
    a, b = doubles(a), doubles(b)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(scored: DataFrame, k: int, item: str) -> DataFrame:
    """The k best of each query; partial limits run before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), item)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_search(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank) by cosine, exact.

    The stated queries travel, at most QUERIES_AT_ONCE vectors at a time, to all items, in as many rounds as it takes; no
    item meets another. Tasks hold blocks of items against blocks of queries, and of each query the best so far: products
    of matrices leave the pairs whose scores may count, and those are summed one by one. Vectors that are null, of no
    length or of another size than the query's have no score and aren't found. For a search that reads few of the items
    see near_buckets().
    """
    spark = items.sparkSession
    held = items.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    rounds = max(1, -(-queries.count() // QUERIES_AT_ONCE))
    found = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("chunk_id", held.schema["chunk_id"].dataType),
        T.StructField("score", T.DoubleType())])

    def scores(part):
        table = part.toArrow()
        # equal vectors ask once
        vectors = table.column("vector").to_pylist()
        first: dict = {}
        at = [first.setdefault(None if v is None else tuple(v), i) for i, v in enumerate(vectors)]
        one = table.take(pa.array(sorted(first.values()), pa.int64()))
        askers = [[] for _ in vectors]
        for i, a in enumerate(at):
            askers[a].append(i)
        askers = [askers[a] for a in sorted(first.values())]
        sent = spark.sparkContext.broadcast((one.column("vector").combine_chunks(), table.column("query_id").combine_chunks(), askers))

        def search(batches):
            vectors, ids, askers = sent.value
            for rows, score, chunks in nearest.searcher(vectors, k)(batches, kind):
                for a in range(0, len(rows), nearest.PAIRS):
                    n = [len(askers[r]) for r in rows[a : a + nearest.PAIRS]]
                    every = np.repeat(np.arange(a, a + len(n)), n)
                    who = pa.array([i for r in rows[a : a + nearest.PAIRS] for i in askers[r]], pa.int64())
                    columns = [ids.take(who), chunks.take(pa.array(every, pa.int64())), pa.array(score[every])]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "chunk_id", "score"])

        kind = to_arrow_type(found["chunk_id"].dataType)
        return held.where("embedding IS NOT NULL").mapInArrow(search, found)

    parts = [scores(asked if rounds == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r)) for r in range(rounds)]
    return top_k(reduce(DataFrame.unionByName, parts), k, "chunk_id")


#: An index of random planes: so many tables of so many planes each.
TABLES, PLANES = 12, 6


def buckets(v: Column, size: int, tables: int = TABLES, planes: int = PLANES) -> Column:
    """Array of the bucket in each table: on which side of each plane a vector lies. Planes are made by rule from their numbers."""
    rng = random.Random(20_240)
    out = []
    for t in range(tables):
        number = F.lit(t)
        for _ in range(planes):
            plane = F.array(*[F.lit(rng.gauss(0, 1)) for _ in range(size)])
            number = number * 2 + (dot(v, plane) > 0).cast("int")
        out.append(number)
    return F.array(*out)


def near_buckets(items: DataFrame, queries: DataFrame, k: int, size: int, tables: int = TABLES, planes: int = PLANES) -> DataFrame:
    """vector_search() that reads only items which share a bucket with the query: approximate, scores exact.

    Items are indexed all, once a table. At defaults each table holds the buckets that differ in no more than one plane
    from the query's own too.
    """
    held = items.where("embedding IS NOT NULL").select("chunk_id", doubles(F.col("embedding")).alias("v"))
    index = held.select("chunk_id", "v", F.posexplode(buckets(F.col("v"), size, tables, planes)).alias("t", "b"))
    asked = queries.select("query_id", doubles(F.col("vector")).alias("q"))
    own = asked.select("query_id", "q", F.posexplode(buckets(F.col("q"), size, tables, planes)).alias("t", "b"))
    flips = F.array(F.lit(0), *[F.lit(1 << p) for p in range(planes)])
    probes = own.select("query_id", "q", "t", F.explode(F.transform(flips, lambda f: F.col("b").bitwiseXOR(f))).alias("b"))
    pairs = index.join(probes, ["t", "b"]).select("query_id", "chunk_id", F.round(cosine(F.col("v"), F.col("q")), 6).alias("score")).distinct()
    return top_k(pairs, k, "chunk_id")


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case; ASCII takes the short way."""
    cut = lambda low, outside: F.filter(F.split(low, outside), lambda w: w != "")
    low = F.lower(text)
    return F.when(F.octet_length(text) == F.char_length(text), cut(low, "[^a-z0-9]+")).otherwise(cut(low, r"[^\p{L}\p{N}]+"))


def keyword_search(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank) by BM25, any term.

    Items are reduced to the queries' terms, and one row for their length, before anything is shuffled; the counts are
    stored, and document frequencies and totals come from them. Terms are broadcast while they are few, and the counts of
    an item meet in one task, so that of its scores only those among a task's best leave it.
    """
    terms = stored(queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")), "terms")
    wanted = terms.select("term").distinct().withColumn("hit", F.lit(True))
    held = items.select("chunk_id", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("ts"))
    # the null term at the end of each item carries its length through
    each = held.select("chunk_id", F.size("ts").alias("len"), F.explode(F.array_append("ts", F.lit(None).cast("string"))).alias("term"))
    found = each.join(hinted(wanted), "term", "left").where(F.col("hit") | F.col("term").isNull())
    tf = stored(found.groupBy("chunk_id", "len", "term").agg(F.count(F.lit(1)).alias("tf")), "term_counts")
    total = tf.where("term IS NULL").agg(F.sum("tf").cast("double").alias("n"), F.avg("len").alias("mean"))
    df = tf.where("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    df = stored(df.join(F.broadcast(total), F.lit(True)).select("term", idf.alias("idf"), "mean"), "term_weights")
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    near = tf.where("term IS NOT NULL").repartition("chunk_id")
    scored = near.join(hinted(df), "term").join(hinted(terms), "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight), 6).alias("score"))
    return top_k(scored, k, "chunk_id")


def fuse(vector: DataFrame, keyword: DataFrame, silent: bool = False) -> DataFrame:
    """Reciprocal rank fusion; ties by vector rank, then keyword rank. With ``silent`` a query without a keyword result keeps its vector results as they are."""
    none = F.lit(None).cast("int")
    both = vector.select("query_id", "chunk_id", F.col("rank").alias("v"), none.alias("k"), "score")
    both = both.unionByName(keyword.select("query_id", "chunk_id", none.alias("v"), F.col("rank").alias("k"), F.lit(None).cast("double").alias("score")))
    part = lambda c: F.coalesce(F.sum(F.lit(1.0) / (RRF + F.col(c))), F.lit(0.0))
    fused = both.groupBy("query_id", "chunk_id").agg((part("v") + part("k")).alias("raw"), F.min("v").alias("v"), F.min("k").alias("k"), F.max("score").alias("score"))
    of_query = Window.partitionBy("query_id")
    rank = F.row_number().over(of_query.orderBy(F.col("raw").desc(), F.col("v").asc_nulls_last(), F.col("k").asc_nulls_last()))
    out = fused.withColumn("rank", rank).withColumn("heard", F.max(F.col("k").isNotNull()).over(of_query))
    alone = F.lit(silent) & ~F.col("heard")
    return out.select("query_id", "chunk_id", F.when(alone, F.col("score")).otherwise(F.round("raw", 6)).alias("score"), "rank")


def hybrid(items: DataFrame, queries: DataFrame, k: int = 3, fetch: int = 10, texts: DataFrame | None = None) -> DataFrame:
    """The best k of fused vector and keyword results; a query without a keyword hit, a blank one among them, keeps its vector scores.

    ``items`` has chunk_id, embedding and text, or else ``texts`` has chunk_id and text: no text need meet its vector.
    """
    v, t = vector_search(items.where("embedding IS NOT NULL"), queries, fetch), keyword_search(items if texts is None else texts, queries, fetch)
    return fuse(v, t, silent=True).where(F.col("rank") <= k)


def keep_relevant(scored: DataFrame, n: int, least: float = 0.05) -> DataFrame:
    """Reranked results from ``least`` on; where none is, the best."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return ranked.where((F.col("score") >= least) | (F.col("rank") == 1))


def context(rows: DataFrame) -> DataFrame:
    """(query_id, context): the sources in rank order under numbered headings."""
    line = lambda r: F.concat(F.lit("--- Nguồn "), r["rank"].cast("string"), F.lit(" (Bài: "), r["lesson"], F.lit(") ---\n"), r["text"], F.lit("\n\n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "lesson", "text"))), line)
    return rows.groupBy("query_id").agg(F.array_join(parts, "").alias("context"))


def verdict(v: Column) -> Column:
    """Of a verifier's answer: flags default to true, an explicit verdict is trusted, none passes."""
    flag = lambda k: F.coalesce(F.try_variant_get(v, f"$.{k}", "boolean"), F.lit(True))
    return F.when(v.isNull(), F.lit("PASS")).otherwise(F.coalesce(F.try_variant_get(v, "$.verdict", "string"),
        F.when(flag("is_faithful") & flag("is_relevant"), F.lit("PASS")).otherwise(F.lit("FAIL"))))
