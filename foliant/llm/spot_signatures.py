"""SpotSigs document fingerprints.

Common words of running text are anchors. The signature of an anchor is a hash of it and of the CHAIN content words that
follow it, other common words skipped. The sorted distinct signatures are the fingerprint; likeness of two fingerprints
is their Jaccard coefficient. near_duplicates() finds all pairs from a threshold on: fingerprints are partitioned by
set length, met by the signatures of their prefix, pruned by the bounds that lengths set, and compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import let, place_among, stored, text_of

CHAIN = 2
#: Frequent function words of the languages at hand.
ANCHORS = (
    "the a an and or of to in on for by with from at as is are was be been it its this that these those he she they his her their not no has have had will would can which who what when there".split()
    + "der die das den dem des ein eine einer einem einen und oder ist sind war zu in im auf von mit für nicht auch sich als wie bei nach aus dass".split()
    + "le la les un une des du de et ou est sont dans en sur pour par avec que qui ne pas au aux ce cette il elle se sa son ses plus".split()
    + "el la los las un una unos unas y o de del en es son por para con que no se su sus lo como más al".split()
)
#: Signatures as hexadecimal digits.
DIGITS = 12
#: Ranges of ids hold about so many rows each, while there are not more than MAX_RANGES of them.
ROWS_IN_RANGE, MAX_RANGES = 500, 16_384


def signatures(s: Column) -> Column:
    """Distinct 64-bit signatures of a text, never none.

    A text without an anchor that content words follow is taken as if each of its words were an anchor; one with too few
    words for that has one signature, of its words or, without a word, of the text itself.
    """

    words = F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    stop = lambda w: w.isin(*dict.fromkeys(ANCHORS))

    def chain(content, at):
        return [F.get(content, at + j) for j in range(CHAIN)]

    def spots(w):
        anchors = F.filter(F.transform(w, lambda x, i: F.when(stop(x), i)), lambda i: i.isNotNull())
        # of an anchor at word i, the j-th of all, i - j content words lie before it
        return let(F.filter(w, lambda x: ~stop(x)),
            lambda c: F.filter(F.transform(anchors, lambda i, j: F.when(i - j + CHAIN <= F.size(c), F.xxhash64(F.get(w, i), *chain(c, i - j)))), lambda h: h.isNotNull()))

    def plain(w):
        n = F.size(w)
        every = F.transform(F.sequence(F.lit(0), n - CHAIN - 1), lambda i: F.xxhash64(F.lit("plain"), *chain(w, i), F.get(w, i + CHAIN)))
        return F.when(n > CHAIN, every).when(n > 0, F.array(F.xxhash64(F.lit("words"), w))).otherwise(F.array(F.xxhash64(F.lit("text"), s)))


    return F.array_distinct(let(words, lambda w: let(spots(w), lambda found: F.when(F.size(found) > 0, found).otherwise(plain(w)))))


def fingerprint(sigs: Column) -> Column:
    """What short() gave as text: DIGITS hexadecimal digits each, joined by blanks."""
    return F.array_join(F.transform(sigs, lambda h: F.lower(F.lpad(F.hex(h), DIGITS, "0"))), " ")


def parsed(fp: Column) -> Column:
    """The distinct signatures in a fingerprint, as numbers."""
    return F.array_distinct(F.transform(F.split(fp, " "), lambda x: F.conv(x, 16, 10).cast("bigint")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two arrays of distinct signatures."""
    both = F.size(F.array_intersect(a, b))
    return F.round(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)), 6)


def short(sigs: Column) -> Column:
    """What a fingerprint keeps of the signatures: their first bits, sorted and distinct."""
    return F.sort_array(F.array_distinct(F.transform(sigs, lambda h: F.shiftrightunsigned(h, 64 - 4 * DIGITS))))


def with_next(rows: DataFrame, id_column: str, payload: list[str], n: int) -> DataFrame:
    """``rows`` with the struct "next" of ``payload`` of the row that follows by descending id; after the last the first.

    Ids are cut into ranges at values that occur. The greatest rows of each range also go to the range above as its last
    ones, those of the highest to the lowest, so that each range finds all its followers by itself. Rows of equal id are
    ordered by the payload; a null id counts as the least.
    """
    rows = rows.withColumn("__id", F.coalesce(F.col(id_column).cast("bigint"), F.lit(-(2**63))))
    parts = max(1, min(MAX_RANGES, n // ROWS_IN_RANGE, 64 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ids = rows.select("__id").agg(F.percentile_approx("__id", [(k + 1) / parts for k in range(parts)], 10 * max(parts, 1000)), F.max("__id")).head()
    cuts = sorted({int(c) for c in [*(ids[0] or []), ids[1]] if c is not None}) or [0]  # at most MAX_RANGES ids
    rows = rows.withColumn("__r", place_among(F.col("__id"), cuts))
    is_cut = F.get(F.array(*map(F.lit, cuts)).cast("array<bigint>"), F.col("__r")) == F.col("__id")
    to = F.when(is_cut, F.array(F.col("__r"), F.pmod(F.col("__r") + 1, F.lit(len(cuts))))).otherwise(F.array(F.col("__r")))
    dealt = rows.select(id_column, *payload, "__id", F.posexplode(to).alias("__guest", "__range"))
    order = Window.partitionBy("__range").orderBy("__guest", F.col("__id").desc(), *payload)
    return dealt.withColumn("next", F.lead(F.struct(*payload)).over(order)).where("__guest = 0").select(id_column, *payload, "next")


def compare_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every whole text.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document by descending id. Null text counts as empty; repeated rows stay as many rows, a single document follows
    itself; an empty table gives no rows; other columns aren't read. One shuffle, of texts and signatures by id ranges.
    """
    rows = docs.select("doc_id", text_of(docs).alias("s"))
    rows = with_next(rows.select("doc_id", "s", short(signatures(F.col("s"))).alias("a")), "doc_id", ["s", "a"], docs.count())
    n = F.char_length("s")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("s"), F.lit(1), n - half), F.substring(F.col("next.s"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "a", F.col("next.a").alias("c"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "a", "c",
        let(short(signatures(F.col("edited"))), lambda b: F.struct(fingerprint(b).alias("fp"), likeness(F.col("a"), b).alias("near"))).alias("e"))
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("a")).alias("fingerprint"), F.col("e.fp").alias("edited_fingerprint"),
        F.col("e.near").alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, class_id) and pairs (class_a, class_b, likeness) of classes from ``threshold`` on.

    Documents of equal fingerprint are one class, named after its least id; copies aren't expanded into pairs. Class
    fingerprints are dealt by set length: lengths in the same power of 1 / threshold are a partition, and a pair's
    lengths lie in one or two neighbouring ones. Signatures are ordered rarest first; only those of a prefix, in which a
    pair of the threshold must meet, enter the index. Bounds by length and place prune before sets are compared.
    """
    sigs = short(signatures(text_of(docs)))
    held = stored(docs.select("doc_id", sigs.alias("sigs")).withColumn("fp", F.sha2(fingerprint(F.col("sigs")), 256)), "spots")
    classes = stored(held.groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.first("sigs").alias("sigs")), "spot_classes")
    members = held.select("doc_id", "fp").join(classes.select("fp", "class_id"), "fp").select("doc_id", "class_id")
    each = classes.select("class_id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    rank = Window.partitionBy("class_id").orderBy("df", "sig")
    ordered = each.join(each.groupBy("sig").agg(F.count(F.lit(1)).alias("df")), "sig").withColumn("place", F.row_number().over(rank))
    prefix = ordered.where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1) & (F.col("df") > 1))
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9)
    index = prefix.select("class_id", "n", "sig", "place", level.alias("level"))
    a, b = index.alias("a"), index.withColumn("to", F.explode(F.array("level", F.col("level") - 1))).alias("b")
    larger = (F.col("b.n") > F.col("a.n")) | (F.col("b.n") == F.col("a.n")) & (F.col("b.class_id") > F.col("a.class_id"))
    shared_most = F.lit(1) + F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    bound = (F.col("a.n") >= threshold * F.col("b.n") - 1e-9) & ((F.col("a.place") > 1) | (F.col("b.place") > 1) | (shared_most >= threshold * F.col("b.n") - 1e-9))
    found = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.level") == F.col("b.to")) & larger & bound)
    found = found.select(F.col("a.class_id").alias("a_id"), F.col("b.class_id").alias("b_id")).distinct()
    left, right = classes.select(F.col("class_id").alias("a_id"), F.col("sigs").alias("sa")), classes.select(F.col("class_id").alias("b_id"), F.col("sigs").alias("sb"))
    pairs = found.join(left, "a_id").join(right, "b_id").withColumn("likeness", likeness(F.col("sa"), F.col("sb"))).where(F.col("likeness") >= threshold)
    return members, pairs.select(F.least("a_id", "b_id").alias("class_a"), F.greatest("a_id", "b_id").alias("class_b"), "likeness")
