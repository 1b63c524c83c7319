"""Quality by weak supervision.

Every rule looks at counts of a document and votes good (1) or bad (-1) or abstains (0). Expectation-maximisation over
the counts of vote patterns - at most 3 to the number of rules, whatever the corpus - estimates how often each rule votes
what in good and in bad documents. The posterior probability of good replaces a filter that all rules must pass. All of
it is DataFrame expressions; the driver sees only pattern counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import BLANK, BLANK_CHARS, let, stored, text_of, words_of

#: Fixed value: the symbols that the contract counts.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, KEEP_FROM = 50, 50, 0.5
ROUNDS = 40
#: The share of good documents, given and not estimated: a rule that warns alone looks the same whether it errs or is right.
BALANCE = 0.8
#: What is expected counts as if so great a share of the documents had shown it: of a rule that never votes good more, since nothing but its warnings tells of it.
PRIOR_SHARE, DEFECT_SHARE = 0.02, 0.5
#: By class (1: good): what is expected before documents are seen of the probabilities of the votes 1, -1 and 0. A rule
#: warns rarely of good documents; that most rules are content says little, since a bad document mostly breaks one.
START = {1: (0.8, 0.01, 0.19), 0: (0.6, 0.3, 0.1)}
#: (name, bad if, good if) over the columns of features(); neither: abstains. One rule a feature, as rules that read one
#: count twice let one fact speak twice. Most look for one defect and never vote good: a text without it may have another.
RULES = [
    ("length", "n_words < 20", "n_words >= 50"),
    ("letters", "2 * n_letters < n_visible", "5 * n_letters >= 4 * n_visible"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words", "FALSE"),
    ("symbols", "10 * n_symbols > n_words", "FALSE"),
    ("lines", "2 * n_dup_lines > n_lines", "FALSE"),
    ("repeats", "5 * n_repeat_words > 2 * n_words", "FALSE"),
]


def repeat_words(words: Column) -> Column:
    """How many words lie in windows of three words that occur twice or more. ``words``: a lambda variable.

    Windows are sorted by (hash, position) packed into one 64-bit number; neighbours of equal hash are compared word by
    word, so that no two different windows count as equal.
    """
    n = F.size(words)
    m = F.greatest(n - 2, F.lit(0))
    gram = lambda i: F.struct(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def covered(hashes: Column) -> Column:
        return let(F.length(F.bin(m.cast("bigint"))),
            lambda bits: let(F.sort_array(F.transform(hashes, lambda h, i: F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("bigint")))),
                lambda keys: spans(keys, bits)))

    def spans(keys: Column, bits: Column) -> Column:
        place = lambda k: (k - F.call_function("shiftleft", F.call_function("shiftright", k, bits), bits)).cast("int")
        head = lambda k: F.call_function("shiftright", k, bits)
        same = lambda a, b: F.coalesce((head(a) == head(b)) & (gram(place(a)) == gram(place(b))), F.lit(False))
        twice = F.filter(keys, lambda k, i: same(k, F.get(keys, i - 1)) | same(k, F.get(keys, i + 1)))
        return let(
            F.sort_array(F.transform(twice, place)),
            lambda at: F.when(F.size(at) == 0, F.lit(0).cast("bigint")).otherwise(
                F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(p - F.get(at, i - 1), F.lit(3)))), F.lit(0).cast("bigint"), lambda a, x: a + x)
            ),
        )

    hashes = F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    few = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)))
    return F.when(n < 4, F.lit(0).cast("bigint")).otherwise(few)


def features(docs: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """``keep`` and the counts of each whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word), n_letters, n_visible. Null text has none of anything."""
    s = text_of(docs, text)
    of_words = let(words_of(s, f"[{BLANK}]+"), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    of_lines = let(F.filter(F.split(s, "\n"), lambda x: F.length(F.translate(x, BLANK_CHARS, "")) > 0),
        lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    visible = F.translate(s, BLANK_CHARS, "")
    out = docs.select(
        *keep,
        of_words.alias("__w"),
        of_lines.alias("__l"),
        F.length(visible).cast("bigint").alias("word_chars"),
        (F.length(s) - F.length(F.translate(s, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.length(F.regexp_replace(s, r"[^\p{L}]+", "")).cast("bigint").alias("n_letters"),
    )
    mine = ["__w", "__l", "word_chars", "n_symbols", "n_letters"]
    return out.select(
        *[F.col(c) for c in out.columns if c not in mine],
        "__w.n_words", "word_chars", "n_symbols", "__l.n_dup_lines", "__w.n_repeat_words", "__l.n_lines", "n_letters", F.col("word_chars").alias("n_visible"),
    )


def votes() -> list[Column]:
    return [F.when(F.expr(bad), F.lit(-1)).when(F.expr(good), F.lit(1)).otherwise(F.lit(0)).alias(f"vote_{name}") for name, bad, good in RULES]


def fit(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[dict[int, float]]]:
    """Expectation-maximisation over (votes, count): the log-odds of BALANCE and each rule's log-odds by vote.

    It begins at START, which also weighs as pseudo-counts. A vote is never held more likely in the class that it speaks
    against, so that the classes can't change names. Without documents, the beginning is the result.
    """
    total = sum(n for _, n in patterns)
    base = math.log(BALANCE / (1 - BALANCE))
    right = [dict(START) for _ in RULES]
    two_sided = {k for k in range(len(RULES)) if any(p[k] == 1 for p, _ in patterns)}
    odds = lambda: [{v: math.log(r[1][k] / r[0][k]) for v, k in ((1, 0), (-1, 1), (0, 2))} for r in right]
    for _ in range(ROUNDS if total else 0):
        w = odds()
        good = [1 / (1 + math.exp(-max(-50.0, min(50.0, base + sum(o[v] for o, v in zip(w, p, strict=True)))))) for p, _ in patterns]
        mass = sum(g * n for g, (_, n) in zip(good, patterns, strict=True))
        for k in range(len(RULES)):
            weight = (PRIOR_SHARE if k in two_sided else DEFECT_SHARE) * total + 1
            for c in (1, 0):
                seen = {1: 0.0, -1: 0.0, 0: 0.0}
                for g, (p, n) in zip(good, patterns, strict=True):
                    seen[p[k]] += n * (g if c else 1 - g)
                own = mass if c else total - mass
                right[k][c] = tuple((seen[v] + weight * s) / (own + weight) for v, s in zip((1, -1, 0), START[c], strict=True))
            # of one vote, never more likely in the class it speaks against; abstaining says nothing
            (g1, b1, a1), (g0, b0, a0) = right[k][1], right[k][0]
            even = (a1 + a0) / 2
            right[k][1] = (max(g1, g0), min(b1, b0), even)
            right[k][0] = (min(g1, g0), max(b1, b0), even)
    return base, odds()


def posterior(prior: float, odds: list[dict[int, float]]) -> Column:
    """Probability of good from the vote columns."""
    total = F.lit(prior)
    for (name, _, _), o in zip(RULES, odds, strict=True):
        v = F.col(f"vote_{name}")
        total = total + F.when(v == 1, F.lit(o[1])).when(v == -1, F.lit(o[-1])).otherwise(F.lit(o[0]))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def judged(features_stored: DataFrame) -> DataFrame:
    """Adds votes, quality (posterior), base_failed and kept to stored features."""
    voted = features_stored.select("*", *votes())
    names = [f"vote_{name}" for name, _, _ in RULES]
    patterns = [(tuple(r[:-1]), r[-1]) for r in voted.groupBy(*names).count().collect()]  # at most 3 ** len(RULES)
    prior, odds = fit(sorted(patterns))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = voted.withColumn("quality", F.round(posterior(prior, odds), 6)).withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the whole text, base_failed, quality and kept of every document.

    Null texts count as empty and fail the base. Repeated rows stay as many rows; an empty table gives none; other
    columns aren't read. One pass over the texts; only counts are stored.
    """
    return judged(stored(features(docs, [docs["doc_id"]]), "quality")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The kept documents with all their columns as they are."""
    columns = [f"c{i}" for i in range(len(docs.columns))]
    held = docs.toDF(*columns)
    text = columns[docs.columns.index("text")]
    out = judged(stored(features(held, [held[c] for c in columns], text), "quality_docs"))
    return out.where("kept").select(*columns).toDF(*docs.columns)
