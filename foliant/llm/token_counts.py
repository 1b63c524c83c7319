"""Token counts with a whole-token shortcut.

Which strings of the vocabulary the tokenizer gives back as exactly one token is proved once, on the driver, by encoding
each of them alone. A pre-token among them counts 1 by one dictionary look-up; only the others are merged, each distinct
one once per worker while it stays in a bounded cache.
"""

from __future__ import annotations

from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from foliant.llm.common import Recent, map_texts, only_held

#: Fixed value: the pattern of byte-level BPE pre-tokens, as the tokenizer's own pre-tokenizer has it.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Above this code point the tokenizer's own pre-tokenizer splits the text: the two libraries may know different Unicode versions. Below it, tests compare them for every code point.
SAME_BELOW = 0x250
OTHER = regex.compile(f"[^\\x00-\\x1b\\x20-{chr(SAME_BELOW - 1)}]")


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(2)
def prove_whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and encode alone as one token. Special tokens aren't among them."""
    t = tokenizer(path)
    special = {a.content for a in t.get_added_tokens_decoder().values()}
    texts = [s for s in (t.decode([i], skip_special_tokens=False) for i in range(t.get_vocab_size())) if s and "�" not in s and s not in special]
    encoded = t.encode_batch(texts, add_special_tokens=False)
    return frozenset(s for s, e in zip(texts, encoded, strict=True) if len(e.ids) == 1 and len(t.pre_tokenizer.pre_tokenize_str(s)) == 1)


#: Where this is found, the single spaces of a text don't all begin a pre-token.
UNEVEN = regex.compile(r"\s\s|^\s|\s$")


class Counter:
    """Counts the tokens of texts as the library would."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.t = tokenizer(path)
        added = list(self.t.get_added_tokens_decoder().values())
        self.special = [a.content for a in added]
        #: Plain special strings are found by themselves, of two at one place the longer; those that take white space or word ends with them are left to the library.
        self.simple = not any(a.lstrip or a.rstrip or a.single_word or a.normalized for a in added)
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.whole = dict.fromkeys(whole, 1)
        self.of_chunk = Recent(self.spaced)

    def merged(self, pre_token: str) -> int:
        """1 by the shortcut, else the merged tokens."""
        return self.whole.get(pre_token) or len(self.t.encode(pre_token, add_special_tokens=False).ids)

    def spaced(self, chunk: str) -> int:
        return sum(map(self.merged, PRE_TOKEN.findall(" " + chunk)))

    def plain(self, text: str) -> int:
        """Every single space between two other characters begins a pre-token, so what stands between spaces is counted by itself, and once while it's in the cache."""
        if not text:
            return 0
        if OTHER.search(text):
            return sum(self.merged(text[a:b]) for _, (a, b) in self.t.pre_tokenizer.pre_tokenize_str(text))
        if UNEVEN.search(text):
            return sum(map(self.merged, PRE_TOKEN.findall(text)))
        first, *rest = text.split(" ")
        return sum(map(self.merged, PRE_TOKEN.findall(first))) + sum(map(self.of_chunk.__getitem__, rest))

    def count(self, text: str | None) -> int:
        """Special strings inside a text are one token each, as is the library's default."""
        if not text:
            return 0
        if any(s in text for s in self.special):
            if not self.simple:
                return len(self.t.encode(text, add_special_tokens=False).ids)
            parts = self.split.split(text)
            return len(parts) - 1 + sum(map(self.plain, parts))
        return self.plain(text)


def count_tokens(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", limit: int = 1024) -> DataFrame:
    """``keep``, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of every whole text.

    Null text counts as empty: 0 bytes, 0 tokens. Equal rows stay as many rows; an empty table gives none; no other
    column is read. No shuffle; the proved strings (at most the vocabulary) travel with the tasks.
    """
    whole = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(path))

    def start():
        count = only_held(("counter", path), lambda: Counter(path, whole.value)).count
        return lambda texts: [[len(t.encode()) if t else 0 for t in texts], [count(t) for t in texts]]

    out = map_texts(docs, list(keep), start, [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())], text)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
