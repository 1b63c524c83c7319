"""Models from outside: what they must offer, keys in turn, retries, and calls from tasks; with stand-ins that need no network.

A provider is made in the task that uses it, by a function that is sent there, so that no connection or key is shipped
with data. Whoever pays by call writes the result before using it further, as a lost task is run again.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from foliant.functions import text as X
from foliant.operators import extraction as E
from foliant.operators.entities import gathered, plain


class LanguageModel(Protocol):
    def generate(self, prompt: str, as_json: bool = False, temperature: float = 0.0) -> str: ...


class Embedder(Protocol):
    def embed(self, texts: list[str], task: str) -> list[list[float]]: ...


class Reranker(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class Ocr(Protocol):
    def pages(self, content: bytes) -> Iterator[tuple[int, str]]:
        """Page numbers from 1, and the engine's result as JSON."""
        ...


#: Tasks of an embedder: texts that are looked for, and questions.
FOR_DOCUMENTS, FOR_QUERIES = "retrieval_document", "retrieval_query"


class NoValidKey(RuntimeError):
    """Every key was refused."""


class StopRequested(RuntimeError):
    """A run was asked to stop."""


def kind_of_error(error: Exception) -> str:
    """quota, key, transient, json or fatal: error_kind() for an exception here."""
    low = re.sub(X.API_KEY, X.REDACTED_KEY,
        " ".join(map(str, [f"{type(error).__name__}: {error}", *(getattr(error, a, "") or "" for a in ("code", "status_code", "status", "reason"))]))).lower()
    for kind, words in E.ERRORS.items():
        if any(w in low for w in words) and (kind != "json" or isinstance(error, (ValueError, TypeError))):
            return kind
    return "fatal"


@dataclass
class KeyRing:
    """Keys in turn, in groups: a round gives each usable key of a group once. Exhausted keys rest until all are, refused ones for good."""

    keys: list[str]
    group: int = 3
    pause: float = 180.0
    long_pause: float = 3600.0
    sleep: Callable[[float], None] = time.sleep
    exhausted: set[int] = field(default_factory=set)
    refused: set[int] = field(default_factory=set)
    start: int = 0
    last: int = -1

    def usable(self) -> list[int]:
        return [k for k in range(self.start, min(self.start + self.group, len(self.keys))) if k not in self.exhausted and k not in self.refused]

    def take(self) -> int:
        """The next key's number. Rests after each round of a group, and long when all keys are exhausted."""
        while True:
            if self.start >= len(self.keys):
                if len(self.refused) >= len(self.keys):
                    raise NoValidKey("no key is valid")
                self.sleep(self.long_pause)
                self.exhausted.clear()
                self.start, self.last = 0, -1
            usable = self.usable()
            if not usable:
                self.start, self.last = self.start + self.group, -1
                continue
            later = [k for k in usable if k > self.last]
            if not later:
                self.sleep(self.pause)
            self.last = (later or usable)[0]
            return self.last

    def report(self, key: int, kind: str) -> None:
        if kind == "quota":
            self.exhausted.add(key)
        elif kind == "key":
            self.refused.add(key)


@dataclass
class Retries:
    """How often a call is repeated: for errors that pass, and for responses that can't be read."""

    transient: int = 3
    transient_pause: float = 30.0
    unreadable: int = 2
    unreadable_pause: float = 5.0
    sleep: Callable[[float], None] = time.sleep

    def call(self, model: LanguageModel, prompt: str, **options) -> str:
        for left in range(self.transient, -1, -1):
            try:
                return model.generate(prompt, **options)
            except Exception as e:
                if kind_of_error(e) != "transient" or not left:
                    raise
                self.sleep(self.transient_pause)
        raise AssertionError

    def read(self, model: LanguageModel, prompt: str, read: Callable[[str], object], again: Callable[[str, str, Exception], str]) -> object:
        """What ``read`` makes of the response; after a ValueError the prompt that ``again`` makes of prompt, response and error is tried."""
        asked, text = prompt, ""
        for left in range(self.unreadable, -1, -1):
            try:
                text = self.call(model, asked, as_json=True)
                return read(text)
            except (ValueError, TypeError) as e:
                if not left:
                    raise ValueError(f"unreadable JSON after {self.unreadable + 1} answers: {shown(e)}") from e
                asked = again(prompt, text, e)
                self.sleep(self.unreadable_pause)
        raise AssertionError


def shown(error: Exception | None, limit: int = 300) -> str:
    """An error in one line, keys masked."""
    text = " ".join(re.sub(X.API_KEY, X.REDACTED_KEY, f"{type(error).__name__}: {error}").split())
    return text if len(text) <= limit else text[:limit] + "..."


def read_object(text: str | None) -> dict:
    """The object in a response: as it is, or the first balanced one, or that without trailing commas. ValueError where there's none."""
    body = (text or "").strip()
    if not body:
        raise ValueError("empty JSON response")
    fenced = re.fullmatch(r"```(?:json)?\s*(.*?)\s*```", body, re.S | re.I)
    body = fenced[1] if fenced else body
    try:
        value = json.loads(body)
    except ValueError:
        # the decoder itself finds where the first object ends; only then its commas are looked at
        tail = body[body.index("{") :] if "{" in body else ""
        try:
            value = json.JSONDecoder().raw_decode(tail)[0]
        except ValueError:
            value = json.JSONDecoder().raw_decode(re.sub(r",\s*([}\]])", r"\1", tail).replace("\ufeff", ""))[0]
    if not isinstance(value, dict):
        raise ValueError("JSON response isn't an object")
    return value


def by_batches(rows: DataFrame, keep: list[str], start: Callable[[], Callable], fields: list[T.StructField], inputs: list[str], size: int) -> DataFrame:
    """``keep`` and ``fields`` of every row: a function that ``start`` makes in each task gets lists of the ``inputs`` of ``size`` rows and gives one list a field."""
    src = rows.select(*keep, *[rows[c].alias(f"__in{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([src.schema[c] for c in keep] + fields)
    kinds, names = [to_arrow_type(f.dataType) for f in fields], [f.name for f in schema]

    def run(batches):
        call = start()
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                b = whole.slice(at, size)
                out = call(*[b.column(len(keep) + i).to_pylist() for i in range(len(inputs))])
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], *[pa.array(v, k) for v, k in zip(out, kinds, strict=True)]], names=names)

    return src.mapInArrow(run, schema)


RESULT = [T.StructField("status", T.StringType()), T.StructField("entities", T.StringType()), T.StructField("error", T.StringType()),
    T.StructField("error_type", T.StringType())]


def enrich(prompts: DataFrame, make: Callable[[str], LanguageModel], keys: list[str], again: Callable[[str, str, Exception], str],
    retries: Retries | None = None, skip_unreadable: bool = True, ring: dict | None = None) -> DataFrame:
    """chunk_id, status (done, json_error_skipped, error), entities (JSON), error, error_type of every row of ``prompts`` (chunk_id, prompt).

    ``make`` gives the model for a key. Each task has its own ring of keys. A key whose quota is spent or that is refused
    gives way to the next, an error that passes too; an unreadable response after its retries skips the chunk. The first
    other error, or a ring without a valid key, ends the task's work: its remaining chunks are errors too, and wait in
    the queue.
    """
    retries, options = retries or Retries(), ring or {}

    def start():
        held = KeyRing(list(keys), **options)
        ended: list[tuple[str, str]] = []

        def one(prompt):
            while not ended:
                try:
                    key = held.take()
                except NoValidKey as e:
                    ended.append((shown(e), type(e).__name__))
                    break
                try:
                    value = retries.read(make(held.keys[key]), prompt, read_object, again)
                    return "done", json.dumps(normal(value), ensure_ascii=False), None, None
                except Exception as e:
                    kind = kind_of_error(e)
                    held.report(key, kind)
                    if kind == "json" and skip_unreadable:
                        return "json_error_skipped", None, shown(e, 800), type(e).__name__
                    if kind in ("json", "fatal"):
                        ended.append((shown(e, 800), type(e).__name__))
            return "error", None, *ended[0]

        return lambda texts: [list(c) for c in zip(*map(one, texts), strict=True)]

    return by_batches(prompts, ["chunk_id"], start, RESULT, ["prompt"], 1)


def normal(value: dict) -> dict:
    """A response with its lists as lists and its summary as text; other fields as they are."""
    listed = lambda v: v if isinstance(v, list) else [] if v is None or v == "" or isinstance(v,
        str) and not v.strip() else [v if isinstance(v, str) else str(v)]
    summary = value.get(E.SUMMARY)
    return value | {k: listed(value.get(k)) for k in E.ENTITIES} | {E.SUMMARY: "" if summary is None else str(summary)}


VECTOR = [T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())]


def embed(rows: DataFrame, make: Callable[[], Embedder], task: str, keep: str = "chunk_id", text: str = "text", size: int = 3) -> DataFrame:
    """``keep``, embedding, error of every row, ``size`` texts a call. Of a call that fails all vectors are null, and the work goes on."""

    def start():
        model = make()

        def call(texts):
            try:
                vectors = model.embed([t or "" for t in texts], task)
                return [[*vectors], [None] * len(texts)]
            except Exception as e:
                return [[None] * len(texts), [shown(e)] * len(texts)]

        return call

    return by_batches(rows, [keep], start, VECTOR, [text], size)


def rerank(candidates: DataFrame, make: Callable[[], Reranker]) -> DataFrame:
    """``candidates`` (query_id, query, chunk_id, text, rank, ...) of few rows a query with column relevance; null for all of a query whose call failed."""
    fields_ = [f for f in candidates.schema if f.name != "relevance"]
    schema = T.StructType([*fields_, T.StructField("relevance", T.DoubleType())])

    def one(rows):
        rows = rows.sort_values("rank")
        try:
            scores = make().score(rows["query"].iloc[0], list(rows["text"]))
        except Exception:
            scores = None
        return rows.assign(relevance=scores)[[f.name for f in schema]]

    return candidates.groupBy("query_id").applyInPandas(one, schema)


def recognise(files: DataFrame, make: Callable[[], Ocr]) -> DataFrame:
    """path, page_number, result (JSON) of every page of ``files`` (path, content), such as the binaryFile source reads."""
    schema = "path string, page_number int, result string"

    def run(batches):
        engine = make()
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for number, result in engine.pages(content):
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([number], pa.int32()), pa.array([result])], names=["path", "page_number", "result"])

    return files.select("path", "content").mapInArrow(run, schema)


# Stand-ins: deterministic, without a network.


class HashEmbedder:
    """Words hashed to places of a vector of length one."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str], task: str) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.size
            for w in re.findall(r"\w+", t.lower()):
                v[int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "little") % self.size] += 1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out


class OverlapReranker:
    """The share of a query's words that a text has."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        asked = set(re.findall(r"\w+", query.lower()))
        return [len(asked & set(re.findall(r"\w+", t.lower()))) / max(1, len(asked)) for t in texts]


class EchoModel:
    """Answers with the last lines of a prompt; asked for JSON, with the words in capitals as concepts and as a verdict that all is well."""

    def generate(self, prompt: str, as_json: bool = False, temperature: float = 0.0) -> str:
        if not as_json:
            return plain(prompt.strip().splitlines()[-1])
        words = [w for w in re.findall(r"\w+", prompt) if w.isupper() and len(w) > 2]
        return json.dumps(gathered({next(iter(E.ENTITIES)): words}) | {"is_faithful": True, "is_relevant": True}, ensure_ascii=False)


class TextOcr:
    """Takes a file's text for its pages, cut at form feeds; every line is a line of a page."""

    def pages(self, content: bytes) -> Iterator[tuple[int, str]]:
        for n, page in enumerate(content.decode("utf-8", "replace").split("\f"), 1):
            lines = page.split("\n")
            boxes = [[0, 10 * i, 100, 10 * i + 9] for i in range(len(lines))]
            yield n, json.dumps({"rec_texts": lines, "rec_scores": [1.0] * len(lines), "rec_boxes": boxes}, ensure_ascii=False)
