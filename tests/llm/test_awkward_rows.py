"""Null and repeated ids, clashing columns and hot keys, for the operators that shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant import storage
from foliant.llm import common, language_id, license_scan, minhash, packing, quality_rules, sentence_pieces, spot_signatures, token_counts, url_filter, warc

WORDS = [f"word{i}" for i in range(60)]
A, B, C = " ".join(WORDS), " ".join([*WORDS, "more"]), " ".join(reversed(WORDS))


@pytest.fixture(scope="module")
def rows():
    return [(None, A), (None, B), (None, C), (7, A), (7, C), (7, C), (7, C + " end"), (9, B), (1, None), (1, ""), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Rows of null and repeated ids, and columns named like what operators add."""
    extra = "score double, rejected boolean, lang_pred string, quality double, kept boolean, n long, d long, root long, v long, c0 string, text_hash long"
    filled = [(i, t, "en", 0.5, True, "x", 0.1, False, 1, 2, 3, 4, "c", 5) for i, t in rows]
    return spark.createDataFrame(filled, f"doc_id long, text string, lang string, {extra}")


def test_near_duplicates_of_null_and_repeated_ids(docs, rows):
    got = sorted(map(tuple, minhash.link_components(docs, 3, 85).collect()), key=str)
    alike = lambda t: {A: 0, B: 0, C: 1, C + " end": 1}.get(t)
    least = {0: 7, 1: 7}
    for i, n, component, kept in got:
        assert kept == (n == 0 or i == component)
        assert n == 0 or component == 7
    assert len(got) == len(rows) and {alike(t) for _, t in rows if t} == set(least)


def test_unlike_texts_of_one_id_stay_apart(spark):
    docs = spark.createDataFrame([(7, A), (7, C), (8, B), (9, C + " end"), (None, "x y z"), (None, "x y z"), (None, "p q r")], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash.link_components(docs, 3, 85).collect()}
    assert got == {(7, 58): (7, True), (8, 59): (7, False), (9, 59): (7, False), (None, 1): (None, True)}
    kept = sorted(((r.doc_id, r.text) for r in minhash.keep_one(docs, 3, 85).collect()), key=str)
    assert kept == sorted([(7, A), (7, C), (None, "x y z"), (None, "p q r")], key=str)


def test_pipeline_stages_pass_clashing_columns(docs):
    for f in (language_id.keep_identified, quality_rules.keep_good, minhash.keep_one):
        out = f(docs)
        assert out.columns == docs.columns
        assert {(r.doc_id, r.text) for r in out.collect()} <= {(r.doc_id, r.text) for r in docs.collect()}
        assert f(docs.limit(0)).count() == 0
    kept = [(r.doc_id, r.text) for r in minhash.keep_one(docs, 3, 85).collect() if r.text]
    assert sorted(kept) == sorted([(7, A), (7, C)])


def test_every_operator_keeps_all_rows(docs, rows):
    import public_tokenizers as P

    n = len(rows)
    assert spot_signatures.compare_edits(docs).count() == n
    assert language_id.identify(docs).count() == n
    assert quality_rules.judge(docs).count() == n
    assert token_counts.count_tokens(docs, P.path("byte_bpe_50k.json")).count() == n
    assert license_scan.scan(docs).count() == n
    assert sentence_pieces.encode_documents(docs, P.path("piece_bpe_32k.model")).count() == n
    assert packing.pack_documents(docs, P.path("word_bpe_49k.json")).count() == n


def test_language_models_learn_from_rows_without_id(spark):
    texts = {"a": "kala mala nala sala", "b": "porto corto sorto"}
    docs = spark.createDataFrame([(None, f"{t} {i}", k) for k, t in texts.items() for i in range(12)], "doc_id long, text string, lang string")
    models = language_id.learn(docs)
    assert models.languages == ["a", "b"]
    assert {(r.text[:4], r.lang_pred) for r in language_id.predict(docs, models, ["text"]).collect()} == {("kala", "a"), ("port", "b")}


def test_language_sample_is_bounded_and_whole(spark, monkeypatch):
    monkeypatch.setattr(language_id, "DOCS_PER_LANGUAGE", 20)
    seen = []
    monkeypatch.setattr(language_id, "train", lambda samples, order: seen.append(samples))
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.when(F.col("id") < 5990, F.lit("x")).otherwise(F.lit("y")).alias("lang"))
    language_id.learn(docs.union(docs.where("doc_id = 0")))
    assert len(seen[0]["x"]) == 20 and len(seen[0]["y"]) == docs.where("doc_id >= 5990").where(~language_id.held_out(F.col("doc_id"))).count()


def test_foreign_languages_and_scripts_are_rejected(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    foreign = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "Все люди рождаются свободными и равными в своём достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
        "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。",
        "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης.",
    ]
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(foreign)], "i int, text string")
    models = language_id.learn(docs)
    assert all(r.rejected for r in language_id.predict(asked, models, ["i"]).collect())
    assert language_id.predict(docs, models, ["doc_id"]).where("rejected").count() == 0


@pytest.mark.parametrize("limit", [10**6, 0])
def test_hot_keys_join_as_others(spark, monkeypatch, limit):
    monkeypatch.setattr(storage, "HOT", 50)
    monkeypatch.setattr(storage, "BROADCAST_ROWS", limit)
    big = spark.range(5000).select(F.when(F.col("id") < 3000, F.lit(0)).otherwise(F.col("id") % 97).alias("k"), "id")
    small = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s")).where("k <> 5")
    got = sorted(map(tuple, common.joined(big, small, ["k"], "n").collect()))
    want = sorted((r.k, r.id, r.s) for r in big.join(small, "k").collect())
    assert got == want and len(got) > 4000


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HUB", 20)
    monkeypatch.setattr(storage, "HOT", 20)
    edges = [(500, x) for x in range(501, 600)] + [(i, i + 1) for i in range(40)] + [(599, 40)]
    got = {r.v: r.root for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(41), *range(500, 600)]}


def test_contained_texts_are_linked(spark):
    """Pairs of which one text has words besides, at a likeness just over the threshold."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(400):
        words = [f"w{x}" for x in rng.integers(10**6, size=150)]
        own = [f"w{x}" for x in rng.integers(10**6, size=int((150 - 4) / 0.805 - 146))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words + own))]
    got = {r.doc_id: r.component_id for r in minhash.link_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert all(got[2 * i + 1] == 2 * i for i in range(400))


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_url_list_of_any_size(spark, broadcast_rows):
    urls = ["http://a.net/en/7"] * 40 + [f"http://b.net/{i}" for i in range(60)] + [None, "", "http://x.org/a", "http://a.net/en/7?q"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([("a.net/en/7",), ("b.net/3",), (None,)], "url string")
    got = {r.page_id: r for r in url_filter.judge(pages, listed, broadcast_rows=broadcast_rows).collect()}
    assert len(got) == len(urls)
    assert {i for i, r in got.items() if r.listed} == {*range(40), 43, 103}
    assert all((r.verdict == "block") == r.listed for r in got.values())


def test_revisits_of_an_odd_date_and_a_hot_url(spark):
    """One capture long before all others doesn't put the rest in one span."""
    row = lambda i, ts, kind: (i, "http://h.com/x", ts, kind, 200, '"e"', None, {})
    rows = [row(0, -(10**12), "response")] + [row(i, 1000 + i // 2, "response" if i % 5 == 0 else "revisit") for i in range(1, 600)]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, status int, etag string, last_modified string, headers map<string,string>")
    want = {r[0]: max((x[2], x[0]) for x in rows if x[3] == "response" and x[2] < r[2])[1] for r in rows if r[3] == "revisit"}
    assert {r.record_id: r.response_id for r in warc.resolve_revisits(df.union(df)).collect()} == want


def test_near_miss_notices(spark):
    t = {}
    for label, text in license_scan.TEMPLATES:
        t.setdefault(label, []).append(text)
    texts = [*(x for label in ("gpl-2.0", "gpl-3.0", "lgpl-3.0", "lgpl-2.1", "agpl-3.0") for x in t[label]), "licensed under cc by nc sa 4 0", "licensed under cc by nd 4 0", "licensed under cc by 4 0", t["lgpl-3.0"][1].replace("lesser", "library")]
    want = ["gpl-2.0", "gpl-3.0", "gpl-3.0", "lgpl-3.0", "lgpl-3.0", "lgpl-2.1", "agpl-3.0", "cc-by-nc-sa-4.0", "cc-by-nd-4.0", "cc-by-4.0", ""]
    got = {r.doc_id: set(r.labels.split(",")) - {"gpl", "cc-by"} for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [",".join(sorted(got[i] - {""})) for i in range(len(texts))] == want


def test_intermediate_tables_are_removed(spark, tmp_path):
    import os

    before = list(storage._made)
    with common.scratch_scope(spark):
        out = common.stored(spark.range(3), "x")
        path = out._foliant_path
        assert out.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path) and storage._made == before


def test_a_cluster_must_name_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        common.scratch_path(Session(), "x")
