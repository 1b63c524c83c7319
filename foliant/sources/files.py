"""Files of the formats in use, read and written by tasks; single small files through the cluster's file system."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.storage import hinted, stored

#: Schemas of the JSON files. Boxes are variants, as engines differ.
LINE = "text string, score double, bbox variant, detector string, recognizer string, paddle_text string"
PAGE = f"page_number int, page_index int, text string, avg_confidence double, ocr_engine string, lines array<struct<{', '.join(f.replace(' ', ': ',
    1) for f in LINE.split(', '))}>>"
BOOK = "book_id string, ocr_engine string, ocr_mode string, ocr_lang string, ocr_version string, vietocr_config string, status string, updated_at string, completed_pages int, total_pages int"
LESSON = (
    "book_id string, grade int, lesson_id string, lesson_title string, lesson_page_start int, lesson_page_end int, source_level string, "
    "learning_objectives array<string>, objective_source string, learning_objectives_reviewed boolean"
)
BOM = "﻿"
#: Header comments of a book's markdown, in order, and the columns they show.
HEADER = {"OCR_ENGINE": "ocr_engine", "OCR_MODE": "ocr_mode", "OCR_LANG": "ocr_lang", "OCR_VERSION": "ocr_version", "BOOK_ID": "book_id",
    "CHECKPOINT_UPDATED_AT": "updated_at"}


def _typed(schema: str) -> str:
    return "struct<" + ", ".join(f.replace(" ", ": ", 1) for f in _split(schema)) + ">"


def _split(schema: str) -> list[str]:
    """Fields at the top of a schema: commas inside brackets don't count."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out, at = [*out, schema[at:i].strip()], i + 1
    return [*out, schema[at:].strip()]


def stem(path: Column) -> Column:
    """A file's name without its folder and its last ending."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)/?$", 1), r"\.[^.]*$", "")


def _whole(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path and text of whole files."""
    files = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", f"^{BOM}", "").alias("text"))


#: How a book's JSON is laid out in lines, so that no task need hold a whole book: what the first line ends with, what the last one is.
PAGES, END = '"pages":[', "]}"


def read_pages(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Pages of books' JSON files: the columns of PAGE after those of BOOK. A broken file, and one whose pages are no list, has none.

    Files in write_books()'s lines, a page each, are read by as many tasks as they have blocks; those of another layout
    are read whole. Which is which comes from a first look at all lines.
    """
    book = _typed(f"{BOOK}, pages array<{_typed(PAGE)}>")
    files = spark.read.format("text").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    lines = files.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", f"^{BOM}", "").alias("line"))
    page = F.regexp_replace("line", r"^,(?=\{)", "")
    head, end = F.col("line").startswith("{") & F.col("line").endswith(PAGES), F.col("line") == END
    bare, other = ~head & F.col("line").startswith("{"), ~head & ~end & F.try_parse_json(page).isNull()
    looks = lines.groupBy("path").agg(F.max(F.when(head, F.col("line"))).alias("head"), F.count_if(head).alias("heads"), F.count_if(end).alias("ends"),
        F.count_if(bare).alias("bare"), F.count_if(other).alias("others"), F.count(F.lit(1)).alias("n"))
    first = F.from_json(F.concat("head", F.lit(END)), book)
    in_lines = (F.col("heads") == 1) & (F.col("ends") == 1) & (F.col("others") == 0) & (F.col("bare") == F.least(F.col("n") - 2, F.lit(1))) & first.isNotNull()
    looks = stored(looks.select("path", first.alias("b"), F.coalesce(in_lines, F.lit(False)).alias("in_lines")), "files")
    others = [r.path for r in looks.where("NOT in_lines").select("path").collect()]
    rows = lines.where(~head & ~end).join(hinted(looks.where("in_lines").select("path", "b")), "path").select("b", F.from_json(page, _typed(PAGE)).alias("p"))
    if others:
        whole = _whole(spark, path, glob).where(F.col("path").isin(others)).select(F.from_json("text", book).alias("b"))
        rows = rows.unionByName(whole.select("b", F.explode("b.pages").alias("p")))
    return rows.select("b.*", "p").drop("pages").withColumnRenamed("ocr_engine", "book_engine").select("*", "p.*").drop("p")


def book_json(pages: DataFrame, header: Mapping[str, Column]) -> DataFrame:
    """book_id, part, at, value: each book's JSON as lines in the order of part, at and value: its header, its pages by number, a missing number as 0, and an end.

    ``pages`` has book_id and columns of PAGE; ``header`` further columns of BOOK. A page is one line, whatever its text holds.
    """
    body = F.to_json(F.struct(*[c for c in pages.columns if c != "book_id"]))
    rows = pages.select("book_id", F.lit(1).alias("part"), F.coalesce("page_number", F.lit(0)).alias("at"), body.alias("value"))
    books = pages.groupBy("book_id").agg(F.count(F.lit(1)).cast("int").alias("completed_pages"))
    head = F.to_json(F.struct("book_id", *[c.alias(n) for n, c in header.items()], "completed_pages"))
    head = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(f",{PAGES}"))
    ends = books.select("book_id", F.inline(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(0).alias("at"), v.alias("value")) for p, v in ((0, head), (2, F.lit(END)))])))
    # a page but the first has a comma before it
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("part", "at", "value"))
    comma = F.when((F.col("part") == 1) & (F.col("place") > 2), F.lit(",")).otherwise(F.lit(""))
    return rows.unionByName(ends).withColumn("place", place).select("book_id", "part", "at", F.concat(comma, "value").alias("value"), "place")


def book_markdown(pages: DataFrame, header: Mapping[str, Column]) -> DataFrame:
    """book_id, value: each book's markdown: header comments, then every page by number under its marker, confidence and text."""
    label = lambda name, c: F.concat(F.lit(f"<!-- {name}: "), c.cast("string"), F.lit(" -->"))
    shown = F.when(F.col("avg_confidence").isNotNull(), label("OCR_AVG_CONFIDENCE", F.col("avg_confidence")))
    part = F.concat_ws("\n", label("OCR_PAGE", F.col("page_number")), shown, X.strip_space(F.coalesce("text", F.lit(""))), F.lit(""))
    rows = pages.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("page_number", F.lit(0)).alias("at"), part.alias("p")))).alias("rows"))
    known = {**header, "book_id": F.col("book_id")}
    head = [label(name, known[c]) for name, c in HEADER.items() if c in known]
    return rows.select("book_id", F.concat_ws("\n", *head, F.lit(""), F.array_join(F.transform("rows", lambda r: r["p"]), "\n")).alias("value"))


def write_books(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """book_id, value to one file a book, under book_id=...; the committer makes a run's files appear together or not at all.

    Rows with a column place are book_json()'s: its window has put each book's lines in order in one task, sorted outside
    memory, and they are written one by one.
    """
    lines = rows if "place" in rows.columns else rows.repartition("book_id")
    lines.select("book_id", "value").write.mode(mode).option("lineSep", "\n").partitionBy("book_id").text(path)


def read_markdown(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """book_id, text of whole markdown files, by the folder book_id=... or else by the file's name."""
    files = _whole(spark, path, glob)
    folder = F.regexp_extract("path", r"book_id=([^/]+)/", 1)
    return files.select(F.when(folder != "", folder).otherwise(stem(F.col("path"))).alias("book_id"), "text")


def _by_name(spark: SparkSession, path: str, glob: str, value: str) -> DataFrame:
    named = F.from_json("text", f"map<string, {value}>")
    return _whole(spark, path, glob).select(stem(F.col("path")).alias("file"), F.posexplode(named).alias("ord", "name", "v"))


def read_lessons(spark: SparkSession, path: str, glob: str = "*_lessons.json") -> DataFrame:
    """Lessons of metadata files, an object by lesson each; a missing or broken file has none."""
    try:
        return _by_name(spark, path, glob, _typed(LESSON)).select("v.*")
    except PySparkException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LESSON)


def read_toc(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """book_id, lesson_id, pdf_start, pdf_end, title, ord of tables of contents, an object by lesson each, named after their book. Rows without whole numbers and a title go."""
    rows = _by_name(spark, path, glob, "struct<pdf_start: string, pdf_end: string, title: string>")
    number = lambda c: F.expr(f"try_cast(v.{c} AS int)")
    out = rows.select(F.col("file").alias("book_id"), F.col("name").alias("lesson_id"), number("pdf_start").alias("pdf_start"),
        number("pdf_end").alias("pdf_end"), "v.title", F.col("ord").cast("int").alias("ord"))
    return out.where("pdf_start IS NOT NULL AND pdf_end IS NOT NULL AND title IS NOT NULL")


def toc_of(spark: SparkSession, lessons: Mapping[str, Mapping[str, object]], book_id: str) -> DataFrame:
    """read_toc()'s rows from a mapping in memory."""

    def whole(v):
        try:
            return int(v)
        except (TypeError, ValueError):
            return None

    rows = [(book_id, k, whole(v.get("pdf_start")), whole(v.get("pdf_end")), v.get("title"), i) for i, (k, v) in enumerate(lessons.items())]
    kept = [r for r in rows if None not in r]
    return spark.createDataFrame(kept, "book_id string, lesson_id string, pdf_start int, pdf_end int, title string, ord int")


def toc_for(toc: DataFrame, books: DataFrame, default: str) -> DataFrame:
    """The tables of contents of ``books`` (book_id); a book without its own has the ``default`` book's. Both are small."""
    own = books.select("book_id").distinct().join(toc.select("book_id").distinct().withColumn("__own", F.lit(True)), "book_id", "left")
    source = own.select("book_id", F.when(F.col("__own"), F.col("book_id")).otherwise(F.lit(default)).alias("__from"))
    return source.join(toc.withColumnRenamed("book_id", "__from"), "__from").drop("__from")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header, quoted lines of several lines, and perhaps a byte order mark before the first name."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True)
    rows = (reader.schema(schema) if schema else reader).csv(path)
    first = rows.columns[0]
    return rows.withColumnRenamed(first, first.lstrip(BOM).strip('"'))


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV file with a header behind a byte order mark. For reports of a size that one task writes."""
    first, *rest = rows.columns
    named = rows.select(F.col(first).alias(BOM + first), *rest)
    named.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", False).csv(path)


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """path, book_id and content of binary files, for an Ocr provider."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", stem(F.col("path")).alias("book_id"), "content")


def image_refs(spark: SparkSession, path: str, book_id: str, glob: str = "*.png", prefix: str = "/static/extracted_images") -> DataFrame:
    """path and local_ref, as texts refer to it, of a book's image files; their contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select("path", F.concat(F.lit(f"{prefix}/{book_id}/"), name).alias("local_ref"))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file is there, such as one that asks a run to stop."""
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str, tries: int = 5, sleep: Callable[[float], None] = time.sleep) -> None:
    """A small file, whole or not at all: written beside its place and renamed; a failed attempt is repeated ``tries`` times in all."""
    fs, p = _fs(spark, path)
    tmp = p.suffix(".tmp")
    for left in range(tries - 1, -1, -1):
        try:
            out = fs.create(tmp, True)
            out.write(bytearray(text.encode()))
            out.close()
            if fs.exists(p):
                fs.delete(p, False)
            if not fs.rename(tmp, p):
                raise OSError(f"can't rename to {path}")
            return
        except Exception:
            if not left:
                raise
            sleep(0.2)
