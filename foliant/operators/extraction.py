"""Model responses to entities, and entities to a graph."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as X

#: The entity lists of a response with node label and edge type, and the words that mark errors, in order of priority.
ENTITIES = {
    "khai_niem_dinh_nghia": ("KhaiNiemV2", "DINH_NGHIA"), "cau_truc_chuc_nang": ("CauTrucChucNang", "MO_TA_CAU_TRUC_CHUC_NANG"),
        "co_che_qua_trinh": ("CoChe", "GIAI_THICH_CO_CHE"),
    "thi_nghiem_chung_minh": ("ThiNghiem", "CHUNG_MINH_BANG_THI_NGHIEM"), "ung_dung_thanh_tuu": ("UngDung", "CO_UNG_DUNG_THUC_TIEN"),
        "y_nghia_sinh_hoc": ("YNghia", "MANG_Y_NGHIA_SINH_HOC"),
}
SUMMARY = "tom_tat_cot_loi"
#: The words in a message that mark an error, by kind in order of priority, and the types whose messages can be about JSON.
QUOTA = ("429", "quota", "rate limit", "rate_limit", "ratelimit", "rate exceeded", "rateexceeded", "resource exhausted", "resource_exhausted", "resourceexhausted",
         "too many requests", "too_many_requests", "per minute", "per day", "free tier", "try again later")
KEY = ("api key not valid", "api_key_invalid", "invalid api key", "invalid_api_key", "api key expired", "api key revoked", "authentication",
    "unauthenticated", "unauthorized",
       "permission denied", "permission_denied", "forbidden", "403", "401")
TRANSIENT = ("timeout", "deadline exceeded", "deadline_exceeded", "temporarily unavailable", "unavailable", "service unavailable",
    "internal server error", "connection reset",
             "connection aborted", "connection refused", "remote disconnected", "dns", "ssl", "socket", "503", "504", "500", "502")
JSON = ("json", "parse", "parser", "decode", "không hợp lệ", "response rỗng", "không có text hợp lệ", "không phải object")
JSON_TYPES = ("JSONDecodeError", "ValueError", "TypeError")
ERRORS = {"quota": QUOTA, "key": KEY, "transient": TRANSIENT, "json": JSON}


def unfenced(s: Column) -> Column:
    """What a fence of three backticks encloses, if it encloses all; else the text, without outer white space."""
    t = X.strip_space(s)
    inner = F.regexp_extract(t, r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1)
    return F.when(t.rlike(r"(?is)^```(?:json)?\s*.*```$"), inner).otherwise(t)


def balanced(s: Column) -> Column:
    """From the first { to its closing brace, strings and escapes heeded; null where there's none."""
    start = F.locate("{", s)
    state = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(a, c):
        over = a["end"] > 0
        quote = (c == '"') & ~a["escaped"]
        quoted = F.when(quote, ~a["quoted"]).otherwise(a["quoted"])
        depth = a["depth"] + F.when(a["quoted"], F.lit(0)).when(c == "{", F.lit(1)).when(c == "}", F.lit(-1)).otherwise(F.lit(0))
        at = a["at"] + 1
        end = F.when(over, a["end"]).when((depth == 0) & ~a["quoted"] & (c == "}"), at).otherwise(F.lit(0))
        return F.struct(depth.alias("depth"), quoted.alias("quoted"), (a["quoted"] & (c == "\\") & ~a["escaped"]).alias("escaped"), at.alias("at"), end.alias("end"))

    tail = F.substring(s, start, F.length(s))
    end = F.aggregate(F.split(tail, ""), state, step, lambda a: a["end"])
    return F.when((start > 0) & (end > 0), F.substring(tail, F.lit(1), end))


def repaired(s: Column) -> Column:
    """Without commas before a closing bracket, and without byte order marks."""
    return X.strip_space(F.replace(F.regexp_replace(s, r",\s*([}\]])", "$1"), F.lit("\ufeff"), F.lit("")))


def parsed(s: Column) -> Column:
    """The response as a variant, or null: as it is, its balanced object, or that repaired."""

    def object_of(t):
        return X.let(balanced(t), lambda o: F.coalesce(F.try_parse_json(o), F.try_parse_json(repaired(o))))

    return X.let(unfenced(s), lambda t: F.coalesce(F.try_parse_json(t), object_of(t)))


def entity_lists(v: Column) -> Column:
    """Struct of string lists and summary: null to empty, a scalar to a list of one, lists as they are."""

    def one(key):
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))
        text = F.try_variant_get(v, f"$.{key}", "string")
        as_list = F.transform(F.try_variant_get(v, f"$.{key}", "array<variant>"), lambda x: x.try_cast("string"))
        return F.when(kind.isNull() | (kind == "VOID"), F.array().cast("array<string>")).when(kind.startswith("ARRAY"),
            as_list).when(F.trim(text) == "", F.array().cast("array<string>")).otherwise(F.array(text)).alias(key)

    return F.struct(*[one(k) for k in ENTITIES], F.coalesce(F.try_variant_get(v, f"$.{SUMMARY}", "string"), F.lit("")).alias(SUMMARY))


def response_problem(s: Column) -> Column:
    """Why a response can't be used: "empty", "not JSON", "not an object"; else null."""
    kind = F.schema_of_variant(parsed(s))
    return F.when(s.isNull() | (X.strip_space(s) == ""), F.lit("empty")).when(kind.isNull(), F.lit("not JSON")).when(~kind.startswith("OBJECT"), F.lit("not an object"))


def error_kind(message: Column, error_type: Column | None = None) -> Column:
    """quota, key, transient, json or fatal by the words of an error's message, the first that fits.

    Errors are about JSON only if of a type in JSON_TYPES, where the type is given. A null message is fatal.
    """
    low = F.lower(message)
    has = lambda words: F.coalesce(low.rlike("|".join(re.escape(w) for w in words)), F.lit(False))
    out = F.lit("fatal")
    for kind, words in reversed(ERRORS.items()):
        hit = has(words) if kind != "json" or error_type is None else has(words) & error_type.isin(*JSON_TYPES)
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


def error_summary(error_type: Column, message: Column, code: Column, status_code: Column, status: Column, reason: Column, known: tuple[str, ...] = ()) -> Column:
    """The parts of an error that are there, as name=value joined by bars; the message with its secrets masked, at most 800 characters of it."""
    named = lambda name, c, when: F.when(when & c.isNotNull() & (c != ""), F.concat(F.lit(f"{name}="), c))
    full = F.concat_ws(" ", F.concat(error_type, F.lit(": "), message), *[F.coalesce(c, F.lit("")) for c in (code, status_code, status, reason)])
    always = F.lit(True)
    other = ~status_code.eqNullSafe(code)
    parts = [named("type", error_type, always), named("code", code, always), named("status_code", status_code, other),
        named("status", status, always), named("reason", reason, always)]
    return F.concat_ws(" | ", *parts, F.concat(F.lit("message="), X.preview(X.redact(full, known=known), 800)))


def dedupe_values(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, value): of values that are equal but for case folding, the first."""
    named = rows.select(*keys, "pos", F.trim("value").alias("value")).where("value <> ''")
    # aggregated before the shuffle, so that a repeated value of a text is sent once
    return named.groupBy(*keys, X.casefold(F.col("value")).alias("__low")).agg(F.min(F.struct("pos", "value")).alias("v")).select(*keys, "v.pos", "v.value")


def nodes(values: DataFrame, label: str, name: str = "value", seq: str = "seq", props: tuple[str, ...] = ()) -> DataFrame:
    """One node for each exact name; of its properties the last in order."""
    last = [F.max_by(F.col(p), F.col(seq)).alias(p) for p in props]
    return values.groupBy(F.col(name).alias("key")).agg(F.count(F.lit(1)).alias("mentions"), *last).withColumn("label", F.lit(label))


def edges(values: DataFrame, kind: str, src: str, dst: str, unique: bool = False) -> DataFrame:
    """Distinct (src, type, dst). With ``unique`` each (src, dst) is known to come once, as dedupe_values() leaves them, and nothing is shuffled."""
    out = values.select(F.col(src).alias("src"), F.lit(kind).alias("type"), F.col(dst).alias("dst"))
    return out if unique else out.distinct()
