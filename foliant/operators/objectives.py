"""Learning objectives: one fold over the lines behind a lesson's opening words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions import text as X

#: The words that open the list, those that end it, and how an objective begins (without accents).
OPENING = "yeu cau can dat"
CLOSING = "muc tieu|mo dau|khoi dong|luyen tap|van dung"
VERBS = "dua vao|neu duoc|phan tich duoc|trinh bay duoc|mo ta duoc|giai thich duoc|xac dinh duoc|thuc hien duoc|van dung duoc|nhan biet duoc|ke duoc|lay duoc|lap duoc|de xuat duoc"
BULLET = r"^[\-–—•·*+▪■●◦o]\s*"
LEAST = 12


def _finished(parts: Column) -> Column:
    trimmed = F.btrim(F.regexp_replace(parts, X.SPACE + "+", " "), F.lit(" ;,.\t"))
    return X.let(trimmed, lambda s: F.when(F.length(s) >= LEAST, F.when(s.rlike(r"[.?!]$"), s).otherwise(F.concat(s, F.lit(".")))))


def extract(text: Column) -> Column:
    """Array of objectives, first spelling of each kept. Bullets open items, other lines continue them or open one by its verb.

    Every line is looked at once; the list ends at the first line that closes it, and items are slices of what lies between.
    """
    lines = F.filter(F.transform(F.split(text, r"\R"), X.clean_title), lambda x: x != "")
    start = lambda a: F.array_position(F.transform(a, lambda x: X.match_key(x).contains(OPENING)), True).cast("int")

    def look(line):
        bullet = line.rlike(BULLET)
        clean = F.btrim(F.when(bullet, F.regexp_replace(line, BULLET, "")).otherwise(line), F.lit(" ;,.\t"))
        closes = X.let(X.match_key(line), lambda key: key.rlike(rf"^({CLOSING})") | key.rlike(r"^(i|ii|iii|iv|v|vi|vii|viii|ix|x)\s"))
        opens = bullet | ((F.length(clean) > LEAST) & X.match_key(clean).rlike(f"^({VERBS})"))
        return F.struct(clean.alias("clean"), bullet.alias("bullet"), opens.alias("opens"), closes.alias("closes"), (line.endswith("?") | X.is_heading(line)).alias("may_close"))

    place = lambda rows, of: F.array_position(F.transform(rows, of), True).cast("int")  # noqa: E731  from 1, 0 for none
    # no list has been opened by a line that closes one, nor behind it
    first = lambda rows: X.let(place(rows, lambda r: r["closes"]), lambda c: X.let(place(rows, lambda r: (r["clean"] != "") & r["opens"]),
        lambda o: F.when((c > 0) & (c <= o), F.lit(0)).otherwise(o)))

    def opened(rows, o):
        tail = F.slice(rows, o, F.size(rows) + 1)
        end = place(tail, lambda r: r["closes"] | r["may_close"] & ~r["first"])
        return X.let(end, lambda e: F.filter(F.when(e > 0, F.slice(tail, 1, e - 1)).otherwise(tail), lambda r: r["clean"] != ""))

    def items(kept):
        heads = F.filter(F.transform(kept, lambda r, i: F.when(r["bullet"] | (i == 0), i)), lambda i: i.isNotNull())
        own = lambda h, k: F.slice(kept, F.get(h, k) + 1, F.coalesce(F.get(h, k + 1), F.size(kept)) - F.get(h, k))
        joined = lambda h, k: _finished(F.array_join(F.transform(own(h, k), lambda r: r["clean"]), " "))
        return X.let(heads, lambda h: F.array_compact(F.transform(h, lambda x, k: joined(h, k))))

    none = F.array().cast("array<string>")
    numbered = lambda rows, o: F.transform(rows, lambda r, i: r.withField("first", i == o - 1))
    listed = lambda rows: X.let(first(rows), lambda o: F.when(o > 0, X.let(opened(numbered(rows, o), o), items)).otherwise(none))
    behind = lambda all_, s: X.let(F.transform(F.slice(all_, s + 1, F.size(all_) + 1), look), listed)
    return X.let(lines, lambda a: X.let(start(a), lambda s: F.when(s > 0, unique(behind(a, s))).otherwise(none)))


def unique(values: Column) -> Column:
    """First of each match key, in order. Sorted by key and place, so that only neighbours are compared."""
    keyed = F.sort_array(F.transform(values, lambda v, i: F.struct(X.match_key(v).alias("key"), i.alias("at"), v.alias("value"))))
    first = lambda rows: F.filter(rows, lambda x, i: x["key"].isNotNull() & ((i == 0) | ~F.get(rows, i - 1)["key"].eqNullSafe(x["key"])))
    in_order = lambda rows: F.transform(F.sort_array(F.transform(rows, lambda x: F.struct(x["at"], x["value"]))), lambda x: x["value"])
    # bound to a lambda variable, the sorted rows are made once and not once an element
    return F.get(F.transform(F.array(keyed), lambda rows: in_order(first(rows))), F.lit(0))
