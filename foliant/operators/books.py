"""Pages, tables of contents, sections and chunks of books."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.storage import hinted, release, stored

#: Page markers, the lesson of pages outside the table of contents, the lesson before the first heading.
MARKER = r"(?i)<!--\s*OCR_PAGE:\s*(\d+)\s*-->"
OUTSIDE, OUTSIDE_TITLE = "Ngoai_TOC", "Phần ngoài mục lục"
FIRST_SECTION, NO_SECTION = "Phần Mở Đầu", "Nội dung"
#: Characters of a chunk, and pages at a lesson's start that are searched for objectives.
CHUNK_CHARS, SCAN_PAGES = 3500, 2
#: Line ends of Unicode text besides the plain one. RUN: numbers of an order that one task sums.
ODD_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
RUN = 65_536


def toc_table(spark: SparkSession, lessons: int = 44, first: int = 7, last: int = 197) -> DataFrame:
    """A table of contents of contiguous lessons: (lesson_id, pdf_start, pdf_end, title, ord). Small by construction."""
    n = last - first + 1
    start = lambda i: F.expr(f"{first} + div(({i}) * {n}, {lessons})").cast("int")
    return spark.range(lessons).select(
        F.format_string("lesson_%02d", F.col("id") + 1).alias("lesson_id"),
        start("id").alias("pdf_start"),
        (start("id + 1") - 1).cast("int").alias("pdf_end"),
        F.format_string("Lesson %d", F.col("id") + 1).alias("title"),
        F.col("id").cast("int").alias("ord"),
    )


def has_markers(text: Column) -> Column:
    """Whether a book's text has page markers, and so goes by its table of contents and not by headings. Null has none."""
    return F.coalesce(text.rlike(MARKER), F.lit(False))


def split_pages(books: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, page_number, text) of each page marker's part; text before the first marker and comments go."""
    parts = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(MARKER), F.lit(1)).alias("n"), F.slice(F.split(F.col(text), MARKER), 2, 2**31 - 1).alias("t"))
    rows = books.select(key, F.posexplode(parts).alias("ord", "p"))
    return rows.select(key, "ord", F.col("p.n").cast("int").alias("page_number"), X.strip_space(X.strip_comments(F.col("p.t"))).alias("text"))


def reading_order(lines: DataFrame, page: list[str]) -> DataFrame:
    """Adds position: by top, then left (unknown boxes at 0, 0), then the order found."""
    w = Window.partitionBy(*page).orderBy(F.coalesce("top", F.lit(0.0)), F.coalesce("left", F.lit(0.0)), "ord")
    return lines.withColumn("position", F.row_number().over(w))


def page_records(lines: DataFrame, page: list[str]) -> DataFrame:
    """One row a page: its lines' text in reading order, and mean confidence, to 4 digits, half up as DuckDB has it."""
    full = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("position", "text"))))
    text = F.array_join(F.transform(full, lambda x: x["text"]), "\n").alias("text")
    return reading_order(lines, page).groupBy(*page).agg(text, F.round(F.avg("score"), 4).alias("avg_confidence"))


def crop(rect: Column, width: Column, height: Column, pad: int = 4) -> Column:
    """A line's rectangle with ``pad`` around it, inside its image; null where nothing is left."""
    whole = lambda side: rect[side].cast("int")
    left, top = F.greatest(whole("left") - pad, F.lit(0)), F.greatest(whole("top") - pad, F.lit(0))
    right, bottom = F.least(whole("right") + pad, width), F.least(whole("bottom") + pad, height)
    return F.when((right > left) & (bottom > top), F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom")))


def pending_pages(pages: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """The pages that ``done`` lacks by ``keys``, the engine's name among them; all with ``force``."""
    return pages if force else pages.join(done.select(*keys), keys, "left_anti")


def lessons_of_pages(pages: DataFrame, toc: DataFrame, keep_outside: bool = True, book: str | None = None) -> DataFrame:
    """Adds lesson_id and lesson_title of the first lesson, by start and then order, whose pages include page_number.

    With ``book``, tables of contents are told apart by that column of both; else one serves all books. Pages in no lesson
    are OUTSIDE or, without ``keep_outside``, go. Lessons of a book are gathered in one row, which is as long as its table
    of contents; they are broadcast while there are few books.
    """
    names = [book] if book else []
    lessons = F.array_sort(F.collect_list(F.struct("pdf_start", "ord", "pdf_end", "lesson_id", "title")))
    bounds = toc.groupBy(*names).agg(lessons.alias("__toc"))
    wide = pages.join(hinted(bounds), names, "left") if book else pages.join(F.broadcast(bounds), how="left", on=F.lit(True))
    found = F.filter(F.col("__toc"), lambda t: F.col("page_number").between(t["pdf_start"], t["pdf_end"]))
    hit = F.get(found, F.lit(0))
    title = F.coalesce(hit["title"], F.lit(OUTSIDE_TITLE))
    out = wide.select(*[pages[c] if not book else F.col(c) for c in pages.columns], F.coalesce(hit["lesson_id"], F.lit(OUTSIDE)).alias("lesson_id"),
        title.alias("lesson_title"))
    return out if keep_outside else out.where(F.col("lesson_id") != OUTSIDE)


def pack_lines(text: Column, limit: int) -> Column:
    """Pieces of at most ``limit`` characters made of whole lines; a longer line stays whole.

    A piece is the longest run of characters below ``limit`` that ends where a line does, else a line: each is matched where
    the last one ended, so that nothing is copied as pieces grow. A line end before each keeps matches from being empty.
    """
    piece = rf"(?s)\G\n(.{{0,{max(limit - 1, 0)}}}|[^\n]*)(?=\n|\z)"
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(F.regexp_extract_all(F.concat(F.lit("\n"), text), F.lit(piece), F.lit(1)))


def before(units: DataFrame, keys: list[str], order: list[str], count: str, name: str) -> DataFrame:
    """``keys``, ``order`` and the sum of ``count`` over the units of equal ``keys`` that come before by ``order``.

    The first of ``order`` is a whole number: sums are made within runs of RUN of its numbers, then over the runs, so that
    no task has to see all units of a key.
    """
    runs = units.select(*keys, *order, count).withColumn("__run", F.floor(F.col(order[0]) / RUN))
    within = F.sum(count).over(Window.partitionBy(*keys, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    totals = runs.groupBy(*keys, "__run").agg(F.sum(count).alias("__n"))
    base = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__run").alias("__r"), F.coalesce(base, F.lit(0)).alias("__base"))
    same = F.col("__run") == F.col("__r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = runs.withColumn("__within", F.coalesce(within, F.lit(0))).join(totals, same)
    return out.select(*keys, *order, (F.col("__base") + F.col("__within")).alias(name))


def rejoined(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns that ``small``, one row for each ``keys``, has besides. Null keys meet each other."""
    named = small.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in small.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(hinted(named), same).drop(*[f"__{k}" for k in keys])


def page_parts(text: Column) -> Column:
    """A page's parts as (k, section, lines): part 0 lies before the first heading, every other one begins with a heading.

    Lines are stripped and blank ones go, so that it's no matter where a pair of line ends is cut; a blank one follows the
    page. Parts without any line are left out.
    """
    odd = reduce(or_, [F.contains(text, F.lit(c)) for c in ODD_ENDS])  # searched as bytes
    cut = F.split(F.when(odd, F.regexp_replace(text, f"[{ODD_ENDS}]", "\n")).otherwise(F.coalesce(text, F.lit(""))), "\n")
    lines = F.filter(F.transform(cut, X.strip_space), lambda x: x != "")

    def parts(marked):
        n, heads = F.size(marked), F.filter(F.transform(marked, lambda x, i: F.when(x["heading"], i)), lambda i: i.isNotNull())

        def part(heads, k):
            start, end = F.coalesce(F.get(heads, k - 1), F.lit(0)), F.coalesce(F.get(heads, k), n)
            own = F.transform(F.slice(marked, start + 1, end - start), lambda x: x["line"])
            own = F.when(k == F.size(heads), F.concat(own, F.array(F.lit("")))).otherwise(own)
            return F.struct(k.alias("k"), F.when(k > 0, X.clean_title(F.get(own, F.lit(0)))).alias("section"), own.alias("lines"))

        return X.let(heads, lambda h: F.transform(F.sequence(F.lit(0), F.size(h)), lambda k: part(h, k)))

    found = X.let(F.transform(lines, lambda x: F.struct(x.alias("line"), X.is_heading(x).alias("heading"))), parts)
    return F.filter(found, lambda p: F.size(p["lines"]) > 0)


def lesson_blocks(pages: DataFrame, keys: list[str], order: str, title: str) -> DataFrame:
    """``keys``, title, block, section, text, pages, first of each block of each lesson, across its pages, stored.

    A heading begins a block and is its first line; what lies before the first has the lesson's title. ``pages`` has
    order (a whole number, one page each), page_number and text; pages of a block are those that give it a line that isn't
    blank, and first is the order of its first page. Blocks of white space alone go. The texts are shuffled once, as
    parts of pages, which are removed once the blocks are stored; a block is one row, however many pages it crosses.
    """
    parted = stored(pages.select(*keys, order, title, "page_number", page_parts(F.col("text")).alias("parts")), "page_parts")
    counted = parted.select(*keys, order, F.array_max(F.transform("parts", lambda p: p["k"])).alias("__headings"))
    firsts = stored(before(counted, keys, [order], "__headings", "__first"), "headings_before")
    rows = rejoined(parted, firsts, [*keys, order]).select(*keys, order, title, "page_number", "__first", F.explode("parts").alias("p"))
    shown = F.exists("p.lines", lambda x: x != "").alias("shown")
    piece = F.struct(order, "p.section", F.array_join("p.lines", "\n").alias("text"))
    rows = rows.select(*keys, title, (F.col("__first") + F.col("p.k")).alias("block"), piece.alias("piece"), shown, F.when(shown, F.col("page_number")).alias("page"))
    blocks = rows.groupBy(*keys, "block").agg(F.array_sort(F.collect_list("piece")).alias("pieces"), F.first(title).alias(title),
        F.array_sort(F.collect_set("page")).alias("pages"), F.max("shown").alias("shown"))
    head, text = F.get("pieces", F.lit(0)), X.strip_space(F.array_join(F.transform("pieces", lambda p: p["text"]), "\n"))
    # by a flag: a filter on the text would make it a second time
    blocks = blocks.where("shown").select(*keys, title, "block", F.coalesce(head["section"], F.col(title)).alias("section"), text.alias("text"), "pages", head[order].alias("first"))
    out = stored(blocks, "blocks")
    release(parted, firsts)
    return out


def chunks(blocks: DataFrame, book: str, lesson: str, title: str, limit: int = CHUNK_CHARS) -> DataFrame:
    """Blocks in pieces, numbered in each lesson and through the book's lessons by their first page; each piece has the pages of its whole block.

    ``blocks`` is lesson_blocks()'s. Numbers are made of the pieces' counts alone, and meet the texts at the end.
    """
    keys = [book, lesson]
    bodies = F.filter(F.transform(pack_lines(F.col("text"), limit), X.strip_space), lambda x: x != "")
    packed = stored(blocks.select(*keys, title, "block", "section", "pages", "first", bodies.alias("bodies")), "packed")
    sized = packed.select(*keys, "block", "first", F.size("bodies").alias("__n"))
    numbered = before(sized, keys, ["block"], "__n", "__before")
    lessons = sized.groupBy(*keys).agg(F.sum("__n").alias("__n"), F.min("first").alias("__first"))
    earlier = F.sum("__n").over(Window.partitionBy(book).orderBy("__first", lesson).rowsBetween(Window.unboundedPreceding, -1))
    lessons = lessons.select(*keys, F.coalesce(earlier, F.lit(0)).alias("__lessons"))
    numbered = stored(rejoined(numbered, stored(lessons, "lessons_before"), keys), "chunk_numbers")
    rows = rejoined(packed, numbered, [*keys, "block"])
    pieces = rows.select(*keys, title, "section", "pages", "__before", "__lessons", F.posexplode("bodies").alias("piece", "body"))
    pieces = pieces.withColumn("chunk_index", F.col("__before") + F.col("piece") + 1)
    return pieces.select(
        *keys,
        X.chunk_uid(F.col(book), F.col(lesson), F.col("chunk_index")).alias("chunk_id"),
        "chunk_index",
        (F.col("__lessons") + F.col("chunk_index")).alias("global_chunk_index"),
        "section",
        X.pages_label(F.col("pages")).alias("source_pages"),
        chunk_content(F.col(title), F.col("section"), F.col("pages"), F.col("body")).alias("markdown_content"),
    )


def chunk_content(title: Column, section: Column, pages: Column, body: Column) -> Column:
    """A chunk's text under its lesson, its section where that's another, and its pages."""
    label = F.concat(F.lit("<!-- source_pages: "), X.pages_label(pages), F.lit(" -->"))
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), F.when((section != title) & (section != ""), F.concat(F.lit("## "), section)), label, body)


def heading_chunks(books: DataFrame, key: str, text: str) -> DataFrame:
    """key, chunk_id, idx (from 1), grade, lesson, section, text: a book without page markers in parts at markdown headings.

    What stands before the first heading goes. The section is the heading's text, NO_SECTION without any on its line; the
    lesson is the last section that names one. Null text gives no rows.
    """
    parts = F.slice(F.split(F.concat(F.lit("\n"), F.col(text)), r"\n(?=#{1,3}\s+)"), 2, 2**31 - 1)
    rows = books.select(key, F.posexplode(parts).alias("__at", "part")).withColumn("part", X.strip_space(F.col("part")))
    found = F.regexp_extract("part", r"^#{1,3}\s+([^\n]*)", 1)
    rows = rows.withColumn("section", F.when(F.col("part").rlike(r"^#{1,3}\s+"), X.strip_space(found)).otherwise(F.lit(NO_SECTION)))
    names = X.folded(F.col("section")).rlike("bai|chuong|phan")
    last = F.last(F.when(names, F.col("section")), ignorenulls=True).over(Window.partitionBy(key).orderBy("__at"))
    book, index = F.col(key).cast("string"), (F.col("__at") + 1).alias("idx")
    return rows.select(
        key, X.chunk_uid(book, F.lit("legacy"), F.col("__at") + 1).alias("chunk_id"), index, X.grade_of(book).alias("grade"),
        F.coalesce(last, F.lit(FIRST_SECTION)).alias("lesson"), "section", F.col("part").alias("text"),
    )


def upsert(base: DataFrame, delta: DataFrame, key: str, sticky: list[str], book: str, run_id: str) -> DataFrame:
    """The table after a run that replaces the books of ``delta``: their rows are the new ones, with ``sticky`` columns kept by key; old rows of these books stay inactive; other books are untouched."""
    books = hinted(delta.select(F.col(book).alias("__book")).distinct())
    flagged = base.join(books, base[book] == books["__book"], "left")
    n = {c: delta[c].alias(f"n_{c}") for c in delta.columns}
    j = flagged.join(delta.select(*n.values(), F.lit(True).alias("__new")), F.col(key) == F.col(f"n_{key}"), "full_outer")
    fresh, hit = F.coalesce("__new", F.lit(False)), F.col("__book").isNotNull()
    own = [c for c in base.columns if c not in ("active", "replaced_by")]
    out = [F.when(fresh, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) if c in n and c not in sticky else F.col(c) for c in own]
    replaced = F.when(~fresh & hit, F.lit(run_id)).otherwise(F.when(~fresh, F.col("replaced_by")))
    return j.select(*out, (fresh | (F.col("active") & ~hit)).alias("active"), replaced.alias("replaced_by"))


def replace_books(base: DataFrame, delta: DataFrame, key: str, sticky: list[str], book: str) -> DataFrame:
    """The net effect of upsert() and purge(): the rows of ``delta`` with what ``base`` keeps of them in ``sticky``, and the rows of all other books.

    Written with dynamic partition overwrite by ``book``, only the first part need be written.
    """
    kept = base.select(F.col(key).alias("__key"), *sticky)
    new = delta.join(kept, F.col(key) == F.col("__key"), "left")
    new = new.select(*[c if c in new.columns else F.lit(None).cast(base.schema[c].dataType).alias(c) for c in base.columns if c not in ("active",
        "replaced_by")], F.lit(True).alias("active"), F.lit(None).cast("string").alias("replaced_by"))
    others = base.join(hinted(delta.select(F.col(book).alias("__book")).distinct()), F.col(book) == F.col("__book"), "left_anti")
    return new.unionByName(others.select(*new.columns))


def purge(table: DataFrame, book: str, books: list[str]) -> DataFrame:
    """Without the inactive rows of ``books``."""
    return table.where(~(F.col(book).isin(books) & ~F.col("active")))


def merge_lessons(generated: DataFrame, existing: DataFrame, force: bool = True) -> DataFrame:
    """Existing fields win, except objectives that were read by machine and not reviewed; lessons of one side stay."""
    g, e = generated.alias("g"), existing.alias("e")
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    machine = F.lit(force) | ~has("e.objectives") | F.coalesce(F.col("e.source").startswith("ocr"), F.lit(False))
    new = F.col("e.lesson_id").isNull()
    replace = new | (has("g.objectives") & ~F.coalesce("e.reviewed", F.lit(False)) & machine)
    pick = lambda c: F.when(replace, F.col(f"g.{c}")).otherwise(F.col(f"e.{c}")).alias(c)
    return g.join(e, F.col("g.lesson_id") == F.col("e.lesson_id"), "full_outer").select(
        F.coalesce("e.lesson_id", "g.lesson_id").alias("lesson_id"),
        F.when(new, F.col("g.title")).otherwise(F.col("e.title")).alias("title"),
        pick("objectives"),
        pick("source"),
        F.when(replace, F.lit(False)).otherwise(F.col("e.reviewed")).alias("reviewed"),
    )


def objective_texts(pages: DataFrame, toc: DataFrame, scan: int = SCAN_PAGES, order: str = "ord") -> DataFrame:
    """lesson_id, title, pdf_start, pdf_end, text: the first ``scan`` pages of every lesson, one at least, by number.

    Of pages of one number the last in ``order`` counts; missing ones are skipped, and a lesson without any has an empty
    text. ``toc`` is small; a page is kept only if a lesson begins near it.
    """
    last = pages.groupBy("page_number").agg(F.max_by("text", order).alias("text"))
    window = toc.withColumn("__n", F.explode(F.sequence("pdf_start", F.greatest("pdf_start", F.least("pdf_end", F.col("pdf_start") + max(1, scan) - 1)))))
    window = window.where(F.col("__n") <= F.col("pdf_end"))
    found = last.join(hinted(window.select("lesson_id", "__n")), F.col("page_number") == F.col("__n"))
    texts = found.groupBy("lesson_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("p"))
    texts = texts.select("lesson_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    out = toc.join(texts, "lesson_id", "left")
    return out.select("lesson_id", "title", "pdf_start", "pdf_end", F.coalesce("text", F.lit("")).alias("text"))


def rewrite(text: Column, urls: dict[str, str]) -> Column:
    """Every local reference in ``text`` replaced by its URL, in the order of ``urls``; for more than a few use rewrite_by()."""
    for old, new in urls.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def rewrite_by(rows: DataFrame, text: str, urls: DataFrame) -> DataFrame:
    """``rows`` with the references of ``urls`` (local_ref, url), gathered in one broadcast row, replaced in ``text``: longer ones first, so that none hits a part of another."""
    pairs = F.array_sort(F.collect_list(F.struct((-F.length("local_ref")).alias("n"), "local_ref", "url")))
    wide = rows.join(F.broadcast(urls.agg(pairs.alias("__urls"))), F.lit(True))
    hits = F.filter("__urls", lambda u: F.contains(F.col(text), u["local_ref"]))
    replaced = F.aggregate(hits, F.col(text), lambda t, u: F.replace(t, u["local_ref"], u["url"]))
    return wide.select(*[replaced.alias(c) if c == text else F.col(c) for c in rows.columns])
