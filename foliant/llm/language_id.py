"""Language identification by interpolated Kneser-Ney character models.

One model per language over the letters of words: each word is read with a start and an end mark, and contexts don't
cross words. All models share one table: the sorted 64-bit hashes of the n-grams of an order, and beside them for each
language the fully interpolated log2 probability of the last character given the others, or for a context its back-off
weight. An n-gram unseen in every language falls to the next lower order. The language with the least cross-entropy per
character wins; a text is rejected when its cross-entropy lies beyond what calibration texts of that language showed.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import hinted, map_texts, only_held, stored

WORD = regex.compile(r"\p{L}+")
ORDER = 5
#: The training sample: at most so many documents of each language, of at most so many characters each.
DOCS_PER_LANGUAGE, CHARS_PER_DOC = 400, 100_000
#: One in so many sampled documents is kept for calibration.
CALIBRATION = 4
#: Rejection from so many times this quantile of the calibrated deviations on, and from so many bits a character at least. Short texts may deviate by SHORT / sqrt(characters) more.
QUANTILE, SLACK, LEAST_BITS, SHORT = 0.98, 1.5, 1.25, 4.0
#: Candidates of the sample are cut to so many times its size by their hash before they meet in one task a language.
MARGIN = 2
#: Characters that count as evidence at most in the score.
SCORE_CHARS = 40
CACHE_WORDS = 120_000
START, END = 1, 2
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from that of its first characters and its last one."""
    h = (h ^ (c + np.uint64(0x100))) * MULTIPLIER
    return h ^ (h >> np.uint64(29))


def encoded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words with their marks in one array, and where each word begins."""
    text = "".join([f"\x01{w}\x02" for w in words])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return codes, np.flatnonzero(codes == START)


def grams(codes: np.ndarray, starts: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each n up to ``order`` the hashes of the n characters that end at each place (0 where the word has fewer), and how many characters of the word lie before each place."""
    n = len(codes)
    at = np.arange(n)
    first = np.zeros(n, np.int64)
    first[starts] = starts
    depth = at - np.maximum.accumulate(first)
    out, h = [], np.zeros(n, np.uint64)
    for k in range(1, order + 1):
        h = mix(np.concatenate([np.zeros(min(1, n), np.uint64), h[:-1]]) if k > 1 else h, codes)
        out.append(np.where(depth >= k - 1, h, np.uint64(0)))
    return out, depth


@dataclass
class Models:
    languages: list[str]
    keys: list[np.ndarray]  # by order: sorted hashes of n-grams
    logp: list[np.ndarray]  # by order: n-grams x languages
    context_keys: list[np.ndarray]  # by order: sorted hashes of contexts
    backoff: list[np.ndarray]  # by order: contexts x languages, log2
    unseen: float
    mean: np.ndarray | None = None  # by language, of calibration
    bound: np.ndarray | None = None  # by language

    def word_bits(self, words: list[str]) -> np.ndarray:
        """Words x languages: bits of each word's characters and end mark."""
        codes, starts = encoded(words)
        hashes, depth = grams(codes, starts, len(self.keys))
        n, out = len(codes), np.zeros((len(codes), len(self.languages)), np.float64)
        todo = depth > 0  # a start mark is given, not predicted
        for k in range(len(self.keys), 0, -1):
            rows = np.flatnonzero(todo & (depth >= k - 1))
            h = hashes[k - 1][rows]
            at = np.minimum(np.searchsorted(self.keys[k - 1], h), len(self.keys[k - 1]) - 1)
            hit = self.keys[k - 1][at] == h
            out[rows[hit]] += self.logp[k - 1][at[hit]]
            todo[rows[hit]] = False
            miss = rows[~hit]
            if k > 1 and len(miss):
                c = hashes[k - 2][miss - 1]
                at = np.minimum(np.searchsorted(self.context_keys[k - 1], c), len(self.context_keys[k - 1]) - 1)
                known = self.context_keys[k - 1][at] == c
                out[miss[known]] += self.backoff[k - 1][at[known]]
        out[todo] += self.unseen
        assert n == 0 or len(starts)
        return -np.add.reduceat(out, starts, axis=0) if len(starts) else np.zeros((0, len(self.languages)))


def _counts(words: list[str], order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By n: distinct n-gram hashes, their context's hash, and counts (for lower orders the number of distinct characters before them)."""
    codes, starts = encoded(words)
    hashes, depth = grams(codes, starts, order)
    out = []
    for k in range(1, order + 1):
        ok = np.flatnonzero((depth >= max(k - 1, 1)))
        h, c = hashes[k - 1][ok], (hashes[k - 2][ok - 1] if k > 1 else np.zeros(len(ok), np.uint64))
        if k < order:
            # continuation count: distinct (k+1)-grams that end in this k-gram; at a word's start there is no longer one, so plain occurrences count once
            longer = hashes[k][ok]
            pair = np.unique(np.stack([h, c, longer], 1), axis=0)
            h, c = pair[:, 0], pair[:, 1]
        keys, first, n = np.unique(h, return_index=True, return_counts=True)
        out.append((keys, c[first], n.astype(float)))
    return out


def train(samples: dict[str, list[str]], order: int = ORDER) -> Models:
    """Models of the words of each language's texts, and thresholds from the texts kept for calibration."""
    languages = sorted(samples)
    per, tests = [], []
    for language in languages:
        texts = samples[language]
        held = texts[::CALIBRATION] if len(texts) >= 2 * CALIBRATION else texts
        fit = [t for i, t in enumerate(texts) if i % CALIBRATION] if len(texts) >= 2 * CALIBRATION else texts
        per.append(_counts([w for t in fit for w in WORD.findall(t.lower())] or ["\x02"], order))
        tests.append(held)
    n_chars = max(2, len(np.unique(np.concatenate([p[0][0] for p in per]))))
    floor = 1 / (n_chars + 1) / 8  # what a character never seen in any language gets
    keys = [np.unique(np.concatenate([p[k][0] for p in per])) for k in range(order)]
    context_of, logp, context_keys, backoff = [], [], [np.zeros(1, np.uint64)], [np.zeros((1, len(languages)))]
    for k in range(order):
        ctx = np.zeros(len(keys[k]), np.uint64)
        for p in per:
            ctx[np.searchsorted(keys[k], p[k][0])] = p[k][1]
        context_of.append(ctx)
        logp.append(np.zeros((len(keys[k]), len(languages)), np.float32))
        if k:
            context_keys.append(np.unique(ctx))
            backoff.append(np.zeros((len(context_keys[k]), len(languages)), np.float32))
    lower_of = _lower(per, keys, order, samples)
    for at, counts in enumerate(per):
        prob_below = np.full(len(keys[0]), floor)
        for k in range(order):
            own, ctx, n = counts[k]
            once, twice = (n == 1).sum(), (n == 2).sum()
            d = float(np.clip(once / max(1.0, once + 2 * twice), 0.1, 0.9))
            full = np.zeros(len(keys[k]))
            full[np.searchsorted(keys[k], own)] = n
            if k == 0:
                total, kinds = max(n.sum(), 1.0), len(own)
                weight = d * kinds / total if len(own) else 1.0
                prob = np.maximum(full - d, 0) / total + weight / (n_chars + 1)
            else:
                group = np.searchsorted(context_keys[k], context_of[k])
                total = np.bincount(group, full, len(context_keys[k]))
                kinds = np.bincount(group, full > 0, len(context_keys[k]))
                weight = np.where(total > 0, d * kinds / np.maximum(total, 1e-9), 1.0)
                below = prob_below[lower_of[k]]
                prob = np.where(total[group] > 0, np.maximum(full - d, 0) / np.maximum(total[group], 1e-9), 0) + weight[group] * below
                backoff[k][:, at] = np.log2(weight)
            prob_below = np.maximum(prob, 1e-12)
            logp[k][:, at] = np.log2(prob_below)
    models = Models(languages, keys, logp, context_keys, backoff, math.log2(floor))
    mean, bound = np.zeros(len(languages)), np.zeros(len(languages))
    for at, held in enumerate(tests):
        seen = [(b[at] / n, n) for b, n in (bits_of(models, WORD.findall(t.lower())) for t in held) if n]
        if seen:
            entropy, n = np.asarray(seen).T
            mean[at] = np.average(entropy, weights=n)
            bound[at] = max(LEAST_BITS, SLACK * np.quantile(entropy - mean[at] - SHORT / np.sqrt(n), QUANTILE))
        else:
            mean[at], bound[at] = 0, np.inf
    models.mean, models.bound = mean, bound
    return models


def _lower(per, keys, order, samples) -> list[np.ndarray]:
    """By n: the place of each n-gram's suffix of n-1 characters among the keys of the next lower order."""
    suffix = [dict() for _ in range(order)]
    for language in samples:
        words = list({w for t in samples[language] for w in WORD.findall(t.lower())})
        codes, starts = encoded(words)
        hashes, depth = grams(codes, starts, order)
        for k in range(1, order):
            ok = depth >= k
            pairs = np.unique(np.stack([hashes[k][ok], hashes[k - 1][ok]], 1), axis=0)
            suffix[k].setdefault("pairs", []).append(pairs)
    out = [np.zeros(len(keys[0]), np.int64)]
    for k in range(1, order):
        pairs = np.concatenate(suffix[k]["pairs"])
        ordered = pairs[np.argsort(pairs[:, 0], kind="stable")]
        at = np.searchsorted(ordered[:, 0], keys[k])
        below = ordered[np.minimum(at, len(ordered) - 1), 1]
        out.append(np.minimum(np.searchsorted(keys[k - 1], below), len(keys[k - 1]) - 1))
    return out


def bits_of(models: Models, words: list[str]) -> tuple[np.ndarray, int]:
    """Bits by language of all words, and how many characters and end marks they have."""
    return models.word_bits(words).sum(0) if words else np.zeros(len(models.languages)), sum(map(len, words)) + len(words)


class Predictor:
    """Predicts texts in lists; the bits of words that occur again come from a bounded cache."""

    def __init__(self, models: Models):
        self.models = models
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.bits = np.zeros((1024, len(self.models.languages) + 1))

    def __call__(self, texts: list[str | None]) -> list[list]:
        split = [WORD.findall(t.lower()) if t else [] for t in texts]
        new = list({w for words in split for w in words if w not in self.at})
        fresh = {}
        if new:
            step, bits = 50_000, []
            for i in range(0, len(new), step):
                part = new[i : i + step]
                bits.append(np.concatenate([self.models.word_bits(part), np.asarray([[len(w) + 1] for w in part], float)], 1))
            bits = np.concatenate(bits)
            if len(self.at) + len(new) > CACHE_WORDS:
                self.clear()
                fresh_words = list({w for words in split for w in words})
                known = set(new)
                missing = [w for w in fresh_words if w not in known]
                if missing:
                    more = np.concatenate([self.models.word_bits(missing), np.asarray([[len(w) + 1] for w in missing], float)], 1)
                    new, bits = new + missing, np.concatenate([bits, more])
            n = len(self.at)
            while len(self.bits) < n + len(new):
                self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)])
            self.bits[n : n + len(new)] = bits
            fresh = dict(zip(new, range(n, n + len(new)), strict=True))
            self.at.update(fresh)
        m, out = self.models, [[], [], [], []]
        for words in split:
            if not words:
                for column, v in zip(out, ("und", 0.0, None, False), strict=True):
                    column.append(v)
                continue
            total = self.bits[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].sum(0)
            n = total[-1]
            entropy = total[:-1] / n
            best = int(np.argmin(entropy))
            odds = np.exp2(np.clip((entropy[best] - entropy) * min(n, SCORE_CHARS), -60, 0))
            away = entropy[best] - m.mean[best] - SHORT / math.sqrt(n)
            for column, v in zip(out, (m.languages[best], float(1 / odds.sum()), float(entropy[best]), bool(away > m.bound[best])), strict=True):
                column.append(v)
        if len(self.at) > CACHE_WORDS:
            self.clear()
        return out


def learn(docs: DataFrame, order: int = ORDER, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Models | None:
    """Models from a bounded sample of the documents whose crc32(doc_id) mod 3 isn't 1, null ids among them: of each
    language the DOCS_PER_LANGUAGE whole texts of least hash of id and text, of at most CHARS_PER_DOC characters each.
    None without such documents.

    Of each language about MARGIN times the sample, by a bound on the hash that its number of documents gives, meet in
    one task; the driver gets the sample alone.
    """
    usable = F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & ~held_out(F.col(doc_id)) & (F.char_length(text) <= CHARS_PER_DOC)
    place = F.xxhash64(doc_id, text)
    pool = docs.where(usable).select(F.col(lang).alias("lang"), F.col(text).alias("text"), place.alias("place"))
    # shares of the hashes' range; a language whose documents are fewer than the margin gives all of them
    share = F.least(F.lit(1.0), F.lit(MARGIN * DOCS_PER_LANGUAGE) / F.count(F.lit(1)))
    limits = pool.groupBy("lang").agg((share * 2.0**64 - 2.0**63).alias("limit"))
    near = pool.join(hinted(stored(limits, "language_limits")), "lang").where(F.col("place").cast("double") <= F.col("limit"))
    order_of = Window.partitionBy("lang").orderBy("place", "text")
    rows = near.withColumn("rank", F.row_number().over(order_of)).where(F.col("rank") <= DOCS_PER_LANGUAGE).select("lang", "place", "text")
    samples: dict[str, list[str]] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["place"], r["text"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    return train(samples, order) if samples else None


def held_out(doc_id):
    """crc32 of the id as text has remainder 1 by 3; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()),
    T.StructField("rejected", T.BooleanType())]


def predict(docs: DataFrame, models: Models | None, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, lang_pred, score (0 to 1, the share of the best language in the evidence of at most SCORE_CHARS
    characters), cross_entropy (bits a character) and rejected, for every whole text.

    Null texts and texts without a letter are "und", score 0, not rejected; so is every text where there was nothing to
    learn from. Equal rows stay as many rows. Each task holds the shared models and a bounded cache of words.
    """
    shared, token = docs.sparkSession.sparkContext.broadcast(models), uuid.uuid4().hex

    def start():
        if shared.value is None:
            return lambda texts: [["und"] * len(texts), [0.0] * len(texts), [None] * len(texts), [False] * len(texts)]
        return only_held(("predictor", token), lambda: Predictor(shared.value))

    return map_texts(docs, keep, start, FIELDS, text)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected of every document; see predict()."""
    return predict(docs, learn(docs), ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that aren't rejected and have a language, all their columns as they are.

    Null texts and texts without a letter go. Columns of any other name, clashing ones included, pass through; equal rows
    stay as many rows; an empty table gives none.
    """
    columns = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*columns)
    doc_id, text, lang = (columns[docs.columns.index(c)] for c in ("doc_id", "text", "lang"))
    out = predict(rows, learn(rows, ORDER, doc_id, text, lang), columns, text)
    return out.where((F.col("lang_pred") != "und") & ~F.col("rejected")).select(*columns).toDF(*docs.columns)
