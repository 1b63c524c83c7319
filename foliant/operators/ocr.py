"""Recogniser output to lines: two result formats, boxes of three kinds, and lines that images add.

Results and boxes are variants, as engines nest them differently. Scores are rounded half even, as Python does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import books as B

#: Names that results give the parallel lists, and what lines are marked with.
TEXTS, SCORES, BOXES = ("rec_texts", "texts"), ("rec_scores", "scores"), ("rec_boxes", "rec_polys", "dt_polys")
DETECTOR, IMAGE_DETECTOR = "paddleocr", "fitz_image"
RECT = "struct<left:double,top:double,right:double,bottom:double>"
#: Nested lists of the older format are opened so deep.
DEPTH = 4


def kind_of(v: Column) -> Column:
    """STRING, BOOLEAN, BIGINT, ..., VOID, or the first word of ARRAY<...> and OBJECT<...>; null for null."""
    return F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1)


def field(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def is_object(v: Column) -> Column:
    """Whether a variant is an object: only that is read as a struct, whatever fields it has. Asking for its schema would read all of it."""
    return F.try_variant_get(v, "$", "struct<none:variant>").isNotNull()


def first_list(v: Column, names: tuple[str, ...]) -> Column:
    """The elements of the first of the fields that is there and not null: a single value is a list of one. None give an empty list."""
    single = lambda f: F.when(f.isNotNull() & ~F.is_variant_null(f), F.array(f))
    found = [c for n in names for c in (field(v, n, "array<variant>"), single(field(v, n)))]
    return F.coalesce(*found, F.array().cast("array<variant>"))


def safe_score(v: Column) -> Column:
    """A number to four digits, half even; what isn't one is null."""
    return F.bround(v.try_cast("double"), 4)


def rect_of(box: Column) -> Column:
    """(left, top, right, bottom) of a box: an object of x1, y1, x2, y2; a list of four numbers, as they are; or a list of points. Else null."""
    sides = ("x1", "y1", "x2", "y2")
    named = F.try_variant_get(box, "$", f"struct<{','.join(f'{n}:double' for n in sides)}>")
    rect = lambda a, b, c, d: F.struct(a.alias("left"), b.alias("top"), c.alias("right"), d.alias("bottom"))

    def of_points(points):
        side = lambda k: F.transform(points, lambda p: F.get(p, F.lit(k)))
        whole = (F.size(points) > 0) & F.forall(points, lambda p: F.forall(p, lambda x: x.isNotNull()))
        return F.when(whole, rect(F.array_min(side(0)), F.array_min(side(1)), F.array_max(side(0)), F.array_max(side(1))))

    def of_list(flat):
        points = F.filter(F.transform(box.try_cast("array<array<double>>"), lambda p: F.when(F.size(p) >= 2, p)), lambda p: p.isNotNull())
        four = (F.size(flat) == 4) & F.forall(flat, lambda x: x.isNotNull())
        return F.when(four, rect(*[F.get(flat, F.lit(k)) for k in range(4)])).otherwise(X.let(points, of_points))

    def of_any(o):
        known = o["x1"].isNotNull() & o["y1"].isNotNull() & o["x2"].isNotNull() & o["y2"].isNotNull()
        return F.when(o.isNull(), X.let(box.try_cast("array<double>"), of_list)).when(known, rect(*[o[n] for n in sides]))

    return X.let(named, of_any)


def lines_of_lists(pages: DataFrame, keys: list[str], result: str) -> DataFrame:
    """keys, ord, text, score, bbox, rect, detector of each line of results that hold parallel lists of texts, scores and boxes, by themselves or under res.

    Texts are stripped, and empty ones go; what a shorter list lacks is null.
    """
    rows = pages.select(*keys, F.col(result).alias("__w"), field(F.col(result), "res").alias("__r"))
    rows = rows.select(*keys, F.when(is_object(F.col("__r")), F.col("__r")).otherwise(F.col("__w")).alias("__r"))
    lists = [first_list(F.col("__r"), names) for names in (TEXTS, SCORES, BOXES)]
    texts = F.transform(lists[0], lambda t: X.strip_space(t.try_cast("string")))
    rows = rows.select(*keys, texts.alias("__t"), lists[1].alias("__s"), lists[2].alias("__b"))
    # outer, as Spark puts a filter on what an inner one opens below all of it, and so makes it and the results twice
    rows = rows.select(*keys, "__s", "__b", F.posexplode_outer("__t").alias("ord", "text")).where(F.col("text") != "")
    return _lined(rows.select(*keys, "ord", "text", safe_score(F.get("__s", F.col("ord"))).alias("score"), F.get("__b", F.col("ord")).alias("bbox")))


def lines_of_rows(pages: DataFrame, keys: list[str], result: str) -> DataFrame:
    """keys, ord, text, score, bbox, rect, detector of results that are rows (box, (text, score)) in lists nested up to DEPTH deep."""
    is_row = lambda v: (F.size(v.try_cast("array<variant>")) >= 2) & (kind_of(F.try_variant_get(v, "$[1][0]", "variant")) == "STRING")
    found = F.array(F.col(result))
    for _ in range(DEPTH):
        opened = F.transform(found, lambda v: F.when(F.coalesce(is_row(v), F.lit(False)),
            F.array(v)).otherwise(F.coalesce(v.try_cast("array<variant>"), F.array().cast("array<variant>"))))
        found = F.flatten(opened)
    kept = F.filter(found, lambda v: F.coalesce(is_row(v), F.lit(False)))
    text = lambda v: X.strip_space(F.try_variant_get(v, "$[1][0]", "string")).alias("text")
    rows = pages.select(*keys, F.posexplode_outer(F.transform(kept, lambda v: F.struct(text(v), v.alias("row")))).alias("ord", "__r"))
    part = lambda path: F.try_variant_get("__r.row", path, "variant")
    rows = rows.where(F.col("__r.text") != "").select(*keys, "ord", "__r.text", safe_score(part("$[1][1]")).alias("score"), part("$[0]").alias("bbox"))
    return _lined(rows)


def _lined(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rect", rect_of(F.col("bbox"))).withColumn("detector", F.lit(DETECTOR))


def placed(lines: DataFrame) -> DataFrame:
    """Adds top and left of rect, by which lines are read; unknown where there's no box."""
    return lines.withColumn("top", F.col("rect.top")).withColumn("left", F.col("rect.left"))


def recognised(text: Column, detected: Column) -> Column:
    """What a second recogniser reads of a line, else what the detector read: an empty or failed reading counts as none."""
    return F.coalesce(F.nullif(X.strip_space(text), F.lit("")), detected)


def image_lines(images: DataFrame, keys: list[str], dpi: int = 220) -> DataFrame:
    """Lines of images on pages: ``images`` has keys, number (from 1), url, and x0, y0, x1, y1 in points of 1/72 inch."""
    zoom = dpi / 72
    rect = F.struct(*[(F.col(c) * zoom).alias(n) for c, n in zip(("x0", "y0", "x1", "y1"), ("left", "top", "right", "bottom"), strict=True)])
    text = F.concat(F.lit("![Hình ảnh minh hoạ]("), F.col("url"), F.lit(")"))
    return images.select(*keys, (F.col("number") + F.lit(1_000_000)).alias("ord"), text.alias("text"), F.lit(1.0).alias("score"), rect.alias("rect"),
        F.lit(IMAGE_DETECTOR).alias("detector"))


def image_name(page_number: Column, number: Column) -> Column:
    return F.format_string("page_%04d_img_%d.png", page_number, number)


def pages_of(lines: DataFrame, keys: list[str], images: DataFrame | None = None) -> DataFrame:
    """keys, text, avg_confidence of each page. Lines of images take their place by their boxes; confidence is that of the read lines alone."""
    columns = [*keys, "ord", "text", "score", "rect", "detector"]
    every = lines.select(*columns)
    if images is not None:
        every = every.unionByName(images.select(*columns))
    read = F.when(F.col("detector") != IMAGE_DETECTOR, F.col("score"))
    return B.page_records(placed(every.withColumn("score", read)), keys)


def sorted_pages(pages: DataFrame) -> DataFrame:
    """By page number, unknown ones as 0."""
    return pages.orderBy(F.coalesce("page_number", F.lit(0)))
