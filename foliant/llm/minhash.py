"""Near-duplicate groups by bottom-k sketches of one hash function.

A document is the set of hashes of its distinct word shingles; documents of equal sets are one class. A class's sketch is
the bottom SKETCH of its hashes. The retained values make inverted lists; of a class's values, the KEYS that come first
stay in the lists: values of shorter lists first, then by hash, so that passages which many texts share don't bring
unlike texts together. Sketches with more than SKETCH - KEYS common values surely meet in a list, since the first of
these by that order is among the KEYS of both. Values that no one else has come first of all; so that a text's own part
can't push all that it shares with another out of the lists, the first EXTRA values of short lists stay besides. Classes
meet in lists, the sketch of their union estimates the likeness and drops what can't reach the threshold, and exact
Jaccard of the full sets verifies.

Lists of large groups are not expanded into pairs. First each list's members meet only its most central one, that whose
values have the longest lists, and verified links are contracted to components. Then only members of different components
meet, those outside the list's largest component with the others. In lists longer than LONG they don't even do that by
sketch: the full sets of their members are ordered rarest shingle first, and two meet only where a shingle lies so early
in both sets, and parity bitmaps of the sets differ in so few bits, that the links' likeness can still be reached. These
bounds on prefix, place and difference lose no link. Hot values, classes and hubs are joined apart; see common.joined().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import BLANK, BLANK_CHARS, ascii_lower, hinted, joined, let, release, shingle_hashes, stored, text_of, words_of

SKETCH, KEYS, EXTRA = 24, 12, 6
#: From so many links of one class on, what meets it is split over tasks.
HUB = 65_536
#: A list longer than this is a long one.
LONG = 40
#: Sketch hashes out of SKETCH of the union that must be common. At a true likeness of 0.8 a pair stays below with a probability of 1e-9.
LEAST_COMMON = 8


def shingle_set(text: Column, k: int) -> Column:
    """Distinct hashes of the ``k``-word shingles of the lower-cased text."""
    return F.array_distinct(let(words_of(ascii_lower(text), f"[{BLANK}]+"), lambda w: shingle_hashes(w, k)))


def set_key(ordered: Column) -> list[Column]:
    """128 bits of a sorted set; equal for equal sets."""
    return [F.xxhash64(ordered).alias("h1"), F.xxhash64(F.lit(7), ordered).alias("h2")]


def jaccard_at_least(a: Column, b: Column, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the least vertex that each vertex of ``edges`` (a, b) reaches.

    Alternates large-star and small-star steps until nothing changes; each state is stored, and the driver sees three
    numbers a round.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def state(e):
        """Rows, a checksum, and the most edges of a vertex."""
        of = both(e).groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(F.greatest("a", "b"), F.least("a", "b")).cast("decimal(38,0)")).alias("h"))
        return tuple(of.agg(F.sum("n"), F.sum("h"), F.max("n")).head())

    def star(e, large, hub):
        """Each vertex links its neighbours (the larger ones, or itself and the smaller ones) to the least of them."""
        near = both(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree")).select("a", F.least("a", "m").alias("m"), "degree")
        least = stored(least, "least") if hub else least
        out = joined(near, least, ["a"], "degree") if hub else near.join(least.drop("degree"), "a")
        if large:
            out = out.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    now = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = state(now)
    while seen[0]:
        hub = seen[2] > HUB
        # the join of hubs looks at its input, which must then be stored and not computed again
        half = stored(star(now, True, hub), "edges") if hub else star(now, True, hub)
        new = stored(star(half, False, hub), "edges")
        release(now, *([half] if hub else []))
        now, before, seen = new, seen, state(new)
        if seen == before:
            break
    roots = now.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("v"), "root").distinct())


def estimate_common(a: Column, b: Column) -> Column:
    """How many of the bottom SKETCH hashes of the union of two sketches both have; all of them where the sets are as small."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(F.array_intersect(union, a), b)) * F.lit(SKETCH) >= F.lit(LEAST_COMMON) * F.size(union)


def sets_of(classes: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(v, set) of ``classes`` (v, d, h1), each made again of the text of its first row, stored; ``texts`` (d, s)."""
    made = stored(texts.join(hinted(classes), "d").select("v", "h1", F.sort_array(shingle_set(F.col("s"), k)).alias("set")), "sets")
    # a row of another text whose d is the same by chance goes; asked before storing, it would become a key of the join and be made of every text
    out = made.where(F.xxhash64("set") == F.col("h1")).select("v", "set")
    out._foliant_path = made._foliant_path
    return out


def verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that the sketch estimate and then the full sets hold to be alike, stored. Sets are made again, of the classes in likely pairs alone."""
    of = lambda df, side, column: df.select(F.col("v").alias(side), F.col(column).alias(f"{column}_{side}"))
    likely = pairs.join(of(classes, "a", "sketch"), "a").join(of(classes, "b", "sketch"), "b")
    likely = stored(likely.where(estimate_common(F.col("sketch_a"), F.col("sketch_b"))).select("a", "b"), "likely")
    if likely.isEmpty():
        return likely
    near = likely.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(classes.select("v", "first.d", "h1"), "v")
    near = stored(near, "near")
    sets = sets_of(near, texts, k)
    exact = likely.join(of(sets, "a", "set"), "a").join(of(sets, "b", "set"), "b")
    out = stored(exact.where(jaccard_at_least(F.col("set_a"), F.col("set_b"), percent)).select("a", "b"), "links")
    release(likely, near, sets)
    return out


def row_key(docs: DataFrame, doc_id: str, text: str) -> Column:
    """A hash of a row's id and text."""
    return F.xxhash64(docs[doc_id], text_of(docs, text))


def sketched(docs: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """(id, d, n, h1, h2, sketch) of every document; d: row_key()."""
    s = shingle_set(text_of(docs, text), k)
    one = let(F.sort_array(s), lambda v: F.struct(F.size(v).cast("bigint").alias("n"), *set_key(v), F.slice(v, 1, SKETCH).alias("sketch")))
    return docs.select(docs[doc_id].alias("id"), row_key(docs, doc_id, text).alias("d"), one.alias("x")).select("id", "d", "x.*")


def rooted(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Lists (v, n, value, ...) of more than one root, with root and the root that most members have (most), stored."""
    of = stored(lists.join(roots, "v", "left").select(*[lists[c] for c in lists.columns], F.coalesce("root", "v").alias("root")), "rooted_lists")
    sizes = of.groupBy("value", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed = sizes.groupBy("value").agg(F.max(F.struct("c", "root")).alias("top"), F.count(F.lit(1)).alias("roots"), F.sum("c").alias("heat")).where("roots > 1")
    mixed = stored(mixed.select("value", F.col("top.root").alias("most"), "heat"), "mixed")
    out = stored(joined(of, mixed, ["value"], "heat"), "mixed_lists")
    release(of, mixed)
    return out


def across(lists: DataFrame, fits: Column, others: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (a, b) of members x, y of a list with different roots that ``fits``; x is none of the list's largest component, y one of ``others`` (all members)."""
    x, y = lists.where(F.col("root") != F.col("most")).alias("x"), (lists if others is None else others).alias("y")
    apart = (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.most")) | (F.col("x.v") < F.col("y.v")))
    pairs = x.join(y, (F.col("x.value") == F.col("y.value")) & apart & fits)
    return pairs.select(F.least("x.v", "y.v").alias("a"), F.greatest("x.v", "y.v").alias("b")).distinct()


BITMAP_WORDS = 16
#: So many members of a long list's largest component, those with the fewest rare shingles, meet the others first.
PIVOTS = 10
#: So often the members outside a long list's largest component meet its pivots alone, and links are contracted, before all that are still apart meet.
ROUNDS = 2


def parity(values: Column) -> list[Column]:
    """64 * BITMAP_WORDS bits, each the parity of how many of ``values`` fall to it. Two sets differ in at least as many elements as bits."""
    one = F.lit(1).cast("bigint")
    bit = lambda h: F.call_function("shiftleft", one, F.pmod(F.shiftright(h, 8), F.lit(64)).cast("int"))
    mixed = F.transform(values, lambda h: F.xxhash64(h))
    word = lambda j: F.aggregate(F.filter(mixed, lambda h: F.pmod(h, F.lit(BITMAP_WORDS)) == j), F.lit(0).cast("bigint"), lambda a, h: a.bitwiseXOR(bit(h)))
    return [F.transform(F.array(*map(F.lit, range(BITMAP_WORDS))), word).alias("bits")]


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(v, n, value, place, bits): of every set the shingles, rarest in ``sets`` first, among which it must meet a set as alike."""
    each = sets.select("v", F.size("set").alias("n"), F.explode("set").alias("value"))
    often = each.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    order = Window.partitionBy("v").orderBy(F.coalesce(F.col("df"), F.lit(1)), "value")
    placed = each.join(often, "value", "left").withColumn("place", F.row_number().over(order))
    kept = placed.where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) & F.col("df").isNotNull())
    return kept.select("v", "n", "value", "place").join(sets.select("v", *parity(F.col("set"))), "v")


def inverted_lists(classes: DataFrame) -> DataFrame:
    """(v, n, value, length, central): the sketch values by which classes may meet, with the length of the value's list."""
    listed = classes.select("v", F.explode("sketch").alias("value"))
    lengths = listed.groupBy("value").agg(F.count(F.lit(1)).alias("length")).where("length > 1")
    of_class = Window.partitionBy("v")
    length = F.coalesce(F.col("length"), F.lit(1))
    ranked = listed.join(lengths, "value", "left").withColumn("rank", F.row_number().over(of_class.orderBy(length, "value")))
    ranked = ranked.withColumn("central", F.sum(length).over(of_class)).withColumn("own", F.sum(F.col("length").isNull().cast("int")).over(of_class))
    first = (F.col("rank") <= KEYS) | ((F.col("rank") - F.col("own") <= EXTRA) & (F.col("length") <= LONG))
    return ranked.where(first & F.col("length").isNotNull()).select("v", "value", "length", "central").join(classes.select("v", "n"), "v")


def contracted(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after ``links`` besides, stored; as they were where there are none."""
    if links.isEmpty():
        return roots
    known = roots.where("v <> root").select(F.col("v").alias("a"), F.col("root").alias("b"))
    return stored(components(known.union(links)), "roots")


def linked(classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(v, root) of every class with a link of ``percent``, stored; ``classes`` has v, n, h1, sketch and first, ``texts`` d and s.

    Steps that have nothing left to do are not begun.
    """
    keyed = stored(inverted_lists(classes), "lists")
    fits = lambda n, m: 100 * F.least(n, m) >= percent * F.greatest(n, m)
    center = stored(keyed.groupBy("value").agg(F.max(F.struct("central", "v", "n")).alias("center"), F.count(F.lit(1)).alias("heat")), "centers")
    stars = joined(keyed, center, ["value"], "heat").where((F.col("v") != F.col("center.v")) & fits(F.col("n"), F.col("center.n")))
    stars = stars.select(F.least("center.v", "v").alias("a"), F.greatest("center.v", "v").alias("b")).distinct()
    done = verified(stars, classes, texts, k, percent)
    roots = stored(components(done), "roots")

    mixed = rooted(keyed, roots)
    release(keyed, center)
    pairs = across(mixed.where(F.col("length") <= LONG), fits(F.col("x.n"), F.col("y.n"))).join(done, ["a", "b"], "left_anti")
    hard = stored(mixed.where(F.col("length") > LONG).select("v").distinct().join(classes.select("v", "first.d", "h1"), "v"), "hard")
    roots = contracted(roots, verified(pairs, classes, texts, k, percent))
    if hard.isEmpty():
        return roots

    sets = sets_of(hard, texts, k)
    need = F.ceil((F.col("x.n") + F.col("y.n")) * percent / (100 + percent))
    early = (F.col("x.place") <= F.col("x.n") - need + 1) & (F.col("y.place") <= F.col("y.n") - need + 1)
    differ = sum(F.bit_count(F.get("x.bits", F.lit(j)).bitwiseXOR(F.get("y.bits", F.lit(j)))) for j in range(BITMAP_WORDS))
    near = F.col("x.n") + F.col("y.n") - differ >= 2 * need
    met = stored(prefixes(sets, percent), "prefixes")
    release(mixed, hard, sets)
    near_fits = fits(F.col("x.n"), F.col("y.n")) & early & near
    by_place = Window.partitionBy("value").orderBy("place", "v")
    for last in [False] * ROUNDS + [True]:
        open_lists = rooted(met, roots)
        if open_lists.isEmpty():
            break
        pivots = open_lists.where("root = most").withColumn("order", F.row_number().over(by_place)).where(F.col("order") <= PIVOTS).drop("order")
        tested = across(open_lists, near_fits) if last else across(open_lists, near_fits, pivots)
        tested = stored(tested.join(done, ["a", "b"], "left_anti"), "tested")
        release(open_lists)
        roots = contracted(roots, verified(tested, classes, texts, k, percent))
        done = done.union(tested)
    return roots


def grouped(docs: DataFrame, k: int, percent: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The documents (id, d, n, h1, h2), and the classes that have words (n, h1, h2, copies, name), both stored.

    name (void, id, d) is the first document that the class reaches: of least id, a null id last, then of least d.
    """
    held = stored(sketched(docs, k, doc_id, text), "sketches")
    first = F.min(F.struct(F.col("id").isNull().alias("void"), "id", "d"))
    classes = held.where("n > 0").groupBy("n", "h1", "h2").agg(first.alias("first"), F.count(F.lit(1)).alias("copies"), F.min("sketch").alias("sketch"))
    # numbered when they are written, once and for all
    classes = stored(classes.withColumn("v", F.monotonically_increasing_id()), "classes")
    texts = docs.select(row_key(docs, doc_id, text).alias("d"), text_of(docs, text).alias("s"))
    again = stored(held.where("n > 0").groupBy("d").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("d"), "repeated")
    if not again.isEmpty():  # rows of equal id and text count once
        once = texts.join(hinted(again), "d", "left_semi").groupBy("d", F.xxhash64(F.lit(7), "s")).agg(F.first("s").alias("s")).select("d", "s")
        texts = texts.join(hinted(again), "d", "left_anti").unionByName(stored(once, "texts_once"))
    roots = linked(classes, texts, k, percent)
    firsts = roots.join(classes.select("v", "first"), "v")
    names = stored(firsts.groupBy("root").agg(F.min("first").alias("name"), F.count(F.lit(1)).alias("heat")), "names")
    of = stored(joined(roots, names, ["root"], "heat").select("v", "name"), "named")
    out = classes.join(of, "v", "left").select("n", "h1", "h2", "copies", F.coalesce("name", "first").alias("name"))
    out = stored(out, "named_classes")
    release(names, of, classes)
    return held.select("id", "d", "n", "h1", "h2"), out


def link_components(docs: DataFrame, k: int = 3, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document: size of its shingle set, the least id that links of ``percent`` reach, and whether that is its own.

    Texts without words (null, empty, blank) have no shingles and no links. Texts with fewer than ``k`` words are one
    shingle. Links hold between texts, so that rows of one id with unlike texts stay apart, each in a component that may
    have the same id. Null ids come last: component_id is null where no other id is reached, and of unlike texts without
    id in a component one is kept. Rows of equal id and text are the same document and have the same verdict. An empty
    table gives no rows; other columns aren't read.
    """
    held, classes = grouped(docs, k, percent, doc_id, text)
    own = F.struct(F.col("id").isNull().alias("void"), "id", "d")
    rows = joined(held.where("n > 0"), classes, ["n", "h1", "h2"], "copies").select("id", "d", "n", "name")
    rows = rows.unionByName(held.where("n = 0").select("id", "d", "n", own.alias("name")))
    kept = F.when(F.col("id").isNull(), F.col("name.id").isNull() & (F.col("d") == F.col("name.d"))).otherwise(F.col("id").eqNullSafe(F.col("name.id")))
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("name.id").alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates - that of least id, a null id last, then of least row_key() - with all columns as they are.

    Texts without words are all kept. Of rows with equal id and text one stays. Columns of any other name, clashing ones
    included, pass through; an empty table gives no rows.
    """
    columns = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*columns)
    id_column, text = columns[docs.columns.index("doc_id")], columns[docs.columns.index("text")]
    held, classes = grouped(rows, k, percent, id_column, text)
    names = stored(classes.select("name.*").distinct().select(F.col("id").alias("name_id"), "d"), "kept")
    repeated = stored(held.where("n > 0").groupBy("id", "d").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("d"), "kept_twice")
    keyed = rows.withColumn("d", row_key(rows, id_column, text))
    blank = F.length(F.translate(text_of(rows, text), BLANK_CHARS, "")) == 0
    kept = keyed.where(~blank).join(hinted(names), "d").where(F.col(id_column).eqNullSafe(F.col("name_id"))).drop("name_id")
    out = keyed.where(blank).select(*columns)
    if repeated.isEmpty():
        out = out.unionByName(kept.select(*columns))
    else:
        once = kept.join(hinted(repeated.distinct()), "d", "left_semi").groupBy("d").agg(F.first(F.struct(*columns)).alias("r")).select("r.*")
        out = out.unionByName(kept.join(hinted(repeated.distinct()), "d", "left_anti").select(*columns)).unionByName(once)
    return out.toDF(*docs.columns)
