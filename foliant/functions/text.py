"""Column functions on titles, lines and messages. All stay inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks, up to U+1EFF, and what is left of each without them; by rule from the Unicode tables.
_MARKED = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]}
_PLAIN = {c: d[0] for c, d in _MARKED.items() if len(d) > 1 and d[0].isascii() and all(unicodedata.category(x) == "Mn" for x in d[1:])} | {"Đ": "D", "đ": "d"}
#: What may not begin a heading (captions, without accents), and Roman numerals of sections.
CAPTIONS, ROMAN = "hinh|bang|bieu do|so do", "i|ii|iii|iv|v|vi|vii|viii|ix|x|xi|xii"
#: Cut to a range first, as any other character would be tried with each member of the class
SPACE = r"[\x00- \x7f-\u3000&&[\s\u0085  -     　]]"
#: The members of SPACE one by one, as trimming wants them.
SPACES = "\t\n\x0b\f\r \x85\xa0" + "".join(map(chr, [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: A heading's greatest length.
HEADING_CHARS = 140


def strip_accents(s: Column) -> Column:
    """Letters without their marks, đ as d. Null stays null."""
    return F.regexp_replace(F.translate(s, "".join(_PLAIN), "".join(_PLAIN.values())), r"\p{Mn}+", "")


def match_key(s: Column) -> Column:
    """Accents, case and punctuation removed; words joined by single spaces."""
    return F.trim(F.regexp_replace(folded(s), "[^a-z0-9]+", " "))


def unmarked(s: Column) -> Column:
    """Without leading and closing marks of markdown, colons, hyphens."""
    return F.btrim(s, F.lit(" #:-\t"))


def collapsed(s: Column) -> Column:
    """Every run of white space as a single space."""
    return F.regexp_replace(s, SPACE + "+", " ")


def clean_title(s: Column) -> Column:
    """Without leading and closing marks of markdown, colons, hyphens; white space collapsed."""
    return F.trim(collapsed(unmarked(s)))


def letters(s: Column, upper: bool = False) -> Column:
    return F.length(F.regexp_replace(s, r"[^\p{Lu}]+" if upper else r"[^\p{L}]+", ""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once for each row however often the body, lambdas included, names it."""
    return F.transform(F.array(value), body)[0]


def folded(s: Column) -> Column:
    """Without accents and in lower case; ASCII takes the short way."""
    return F.when(F.octet_length(s) == F.char_length(s), F.lower(s)).otherwise(F.lower(strip_accents(s)))


def is_heading(line: Column) -> Column:
    """A section heading: numbered, or mostly upper case; never a question or a caption. Null is none.

    A long line is told by its first characters: without a run of white space there, the title is no shorter than these but for a
    space at either end.
    """

    def titled(t, low, shouted):
        numbered = low.rlike(r"^(bai|chuong)\s*\d+\b") | low.rlike(rf"^({ROMAN})\.\s+") | (low.rlike(r"^\d+[.)]\s+") & (F.length(t) <= 90))
        return ~low.rlike(rf"^({CAPTIONS})\s") & (numbered | shouted)

    def judged(t):
        # 65 in 100 of five letters are four; running text ends here
        upper = lambda: letters(t, True)
        shouted = (upper() >= 4) & (letters(t) >= 5) & (upper() >= 0.65 * letters(t)) & F.size(F.split(t, " ")).between(2, 16)
        # what a numbered heading may begin with, unless it has to be folded first
        return let(shouted, lambda loud: F.when(loud | t.rlike(r"^([bcivxBCIVX0-9]|[^\x00-\x7f])"), let(folded(t), lambda low: titled(t, low, loud))))

    sized = lambda t: F.length(t).between(3, HEADING_CHARS) & ~t.endswith("?")
    found = lambda own: let(F.trim(collapsed(own)), lambda t: F.when(sized(t), judged(t)))
    most = HEADING_CHARS + 3
    long = lambda own: (F.length(own) >= most) & ~F.left(own, F.lit(most)).rlike(SPACE + "{2}")
    return F.coalesce(let(unmarked(line), lambda own: F.when(~long(own), found(own))), F.lit(False))


def grade_of(book_id: Column) -> Column:
    """The first number in a book's id, else null."""
    return F.nullif(F.regexp_extract(book_id, r"(\d+)", 1), F.lit("")).try_cast("int")


def chunk_uid(book_id: Column, lesson_id: Column, index: Column) -> Column:
    """book:lesson:0001; what can't stand in an id is an underscore, a null or empty lesson is unknown."""
    safe = F.btrim(F.regexp_replace(F.coalesce(F.nullif(lesson_id, F.lit("")), F.lit("unknown")), r"[^A-Za-z0-9_-]+", "_"), F.lit("_"))
    number = index.cast("string")
    return F.concat(book_id, F.lit(":"), safe, F.lit(":"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number))


def pages_label(pages: Column) -> Column:
    """First and last of sorted pages, whatever lies between; one alone; empty for none."""
    first, last = F.get(pages, F.lit(0)).cast("string"), F.element_at(pages, -1).cast("string")
    return F.when(F.size(pages) == 0, F.lit("")).when(F.size(pages) == 1, first).otherwise(F.concat(first, F.lit("-"), last))


#: Characters whose case folding isn't their lower case, by rule from the Unicode tables; and the capital sigma, whose lower case depends on what follows.
_FOLDS = {c: c.casefold() for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x1F000)]) if c.casefold() != c.lower() or c == "Σ"}


def _ranges(chars: Iterable[str]) -> str:
    """A class of a pattern, neighbours as ranges: every single member of a class costs a comparison for each character read."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        runs = [*runs[:-1], [runs[-1][0], c]] if runs and runs[-1][1] == c - 1 else [*runs, [c, c]]
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


_FOLDED = _ranges(_FOLDS)


def casefold(s: Column) -> Column:
    """Unicode case folding, as ß to ss. ASCII takes the short way; most other texts have none of the characters that lower() treats otherwise."""
    table = F.create_map(*[F.lit(x) for pair in _FOLDS.items() for x in pair])
    each = F.transform(F.regexp_extract_all(s, F.lit(r"(?s)."), F.lit(0)), lambda c: F.coalesce(F.try_element_at(table, c), F.lower(c)))
    return F.when((F.octet_length(s) > F.char_length(s)) & s.rlike(_FOLDED), F.array_join(each, "")).otherwise(F.lower(s))


def preview(s: Column, limit: int) -> Column:
    """White space collapsed; longer than ``limit``, cut there and marked with three dots. Null stays null."""
    t = F.trim(F.regexp_replace(s, SPACE + "+", " "))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(limit))), F.lit("...")))


#: Fixed value: what keys of the model service look like, and what stands for them in messages.
API_KEY, REDACTED_KEY = r"AIza[0-9A-Za-z_\-]{20,}", "[REDACTED_API_KEY]"


def redact(s: Column, pattern: str = API_KEY, known: tuple[str, ...] = (), mask: str = REDACTED_KEY) -> Column:
    """``s`` with what matches ``pattern`` and the ``known`` secrets masked. Null stays null."""
    out = F.regexp_replace(s, pattern, mask)
    for k in known:
        out = F.replace(out, F.lit(k), F.lit(mask))
    return out


def strip_comments(s: Column) -> Column:
    return F.regexp_replace(s, r"(?s)<!--.*?-->", "")


def strip_space(s: Column) -> Column:
    """Without white space at its ends; what lies between isn't searched for any, as a pattern would."""
    return F.btrim(s, F.lit(SPACES))
