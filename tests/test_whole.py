"""Queries over whole texts, against brute force."""

import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliant.operators import objectives as O
from foliant.plans.catalog import CATALOG


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def kept(texts):
    """doc_id -> {pos: value}: the first of each value but for case."""
    out = {}
    for i, s in texts.items():
        seen, out[i] = set(), {}
        for pos, w in enumerate(s.split(" ")):
            v = "".join(c for c in w if c.isascii() and c.isalpha())
            if v and v.lower() not in seen:
                seen.add(v.lower())
                out[i][pos] = v
    return out


def test_values_of_whole_texts(spark, sf_dir, kept):
    got = {(r.doc_id, r.pos): r.value for r in CATALOG["entity_dedupe"](spark, sf_dir).collect()}
    assert got == {(i, pos): v for i, x in kept.items() for pos, v in x.items()}
    assert max(pos for _, pos in got) >= 1000


def test_graph_of_whole_texts(spark, sf_dir, kept):
    mentions = Counter(v for x in kept.values() for v in x.values())
    last = {v: i for i in sorted(kept) for v in kept[i].values()}
    assert {(r.key, r.mentions, r.doc_id) for r in CATALOG["graph_nodes"](spark, sf_dir).collect()} == {(v, n, last[v]) for v, n in mentions.items()}
    edges = CATALOG["graph_edges"](spark, sf_dir).where("type = 'DINH_NGHIA'").collect()
    assert sorted((r.src, r.dst) for r in edges) == sorted((str(i), v) for i, x in kept.items() for v in x.values())
    assert {r.dst: r.degree for r in CATALOG["concept_degree"](spark, sf_dir).collect()} == mentions


def test_expansion_has_all_concepts(spark, sf_dir, kept):
    rows = CATALOG["graph_expand"](spark, sf_dir).collect()
    assert rows and all((r.concepts or "") == ",".join(sorted(set(kept[r.chunk_id].values()))) for r in rows)


def match_key(s):
    s = "".join(c for c in unicodedata.normalize("NFD", s.replace("Đ", "D").replace("đ", "d")) if unicodedata.category(c) != "Mn")
    return re.sub("[^a-z0-9]+", " ", s.lower()).strip(" ")


def test_objectives_of_whole_texts(spark, sf_dir, texts):
    got = {r.doc_id: r.kept for r in CATALOG["objective_dedupe"](spark, sf_dir).collect()}
    for i, s in texts.items():
        first = {}
        for w in s.split(" "):
            first.setdefault(match_key(w), w)
        assert got[i] == " ".join(first.values()), i
    assert any(match_key(w) not in map(match_key, s.split(" ")[:60]) for s in texts.values() for w in s.split(" ")[60:])


def test_unique_of_nulls_and_a_long_list(spark):
    lists = [None, [], [None, "B", "b", "A", None], [f"w{i % 20000}" for i in range(60_000)]]
    rows = spark.createDataFrame(list(enumerate(lists)), "i int, v array<string>").select("i", O.unique(F.col("v")).alias("u")).collect()
    assert {r.i: r.u for r in rows} == {0: None, 1: [], 2: ["B", "A"], 3: [f"w{i}" for i in range(20000)]}
