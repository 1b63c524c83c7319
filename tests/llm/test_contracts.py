"""Every contract query against brute force on a small table, awkward rows included."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from foliant.llm import language_id, license_scan, minhash, packing, quality_rules, queries, sentence_pieces, spot_signatures, token_counts, url_filter, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    """The small table with rows of every awkward kind."""
    base = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    n = len(base)
    long = " ".join(f"w{i % 977} the x{i % 13}" for i in range(30_000))
    near = base[5][1].split()
    extra = [
        None, "", " \t\n ", "one", "one two", "A b a B a b A B", "x\n\nx\n x\n", "<|endoftext|>and <|endoftext|>", "wwwwww" * 9000, long, "日本語 の テキスト です。", "ÀÉ àé ß ẞ İ ſ ½ ²", "a  b   c \x1c d\x85e\xa0f ",
        "Cc By all rights reserved. General  Public-License, released under the MIT License", "🙂🙂 🙂 \U0001f1e9\U0001f1ea", " ".join(near), " ".join([*near[:-1], "changed"]), base[5][1], base[7][1] + " tail", "d'accord l'été don't I'LL",
    ]
    rows = base + [(n + i, t, None if i % 3 else "en", None, None) for i, t in enumerate(extra)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache(), [(r[0], r[1] or "") for r in rows]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def test_packing(docs, empty):
    df, rows = docs
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = {}
    for i, s in rows:
        ids = [*t.encode(s, add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[i, k] = (at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes()))
    got = packing.pack_documents(df, path).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(v[1] for v in want.values())
    assert len(by) <= total / 2048 * 1.02 + 2
    assert packing.pack_documents(empty, path).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(8, 300))
    hist = np.zeros(size + 1, np.int64)
    hist[1:] = rng.integers(0, [1, 3, 50, 5000][seed % 4] + 1, size)
    seen, rooms = defaultdict(list), defaultdict(int)
    for v, lo, hi, seq, offset in packing.plan_segments(hist, size):
        seen[v] += range(lo, hi)
        for k in range(seq, seq + hi - lo):
            assert rooms[k] == offset
            rooms[k] += v
    assert all(sorted(seen[v]) == list(range(hist[v])) for v in range(1, size + 1))
    assert not rooms or max(rooms.values()) <= size


def test_tokens_below_the_bound_split_as_in_the_library():
    p1, p6 = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    t1, t6 = Tokenizer.from_file(p1), Tokenizer.from_file(p6)
    count = token_counts.Counter(p6, token_counts.prove_whole_tokens(p6)).count
    for c in map(chr, range(0x250)):
        for s in (c, f"a{c}b", f" {c}{c} 1", f"x {c} {c}y", f"x  {c}  y", f"{c}{c}'S{c}"):
            assert count(s) == len(t6.encode(s, add_special_tokens=False).ids), ascii(s)
            assert packing.encode_ids(p1, s) == np.asarray(t1.encode(s, add_special_tokens=False).ids, "<u4").tobytes(), ascii(s)


def test_token_counts(docs, empty):
    df, rows = docs
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = {i: (len(s.encode()), len(t.encode(s, add_special_tokens=False).ids)) for i, s in rows}
    got = token_counts.count_tokens(df, path).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want and len(got) == len(rows)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.count_tokens(empty, path).count() == 0


def test_sentence_pieces(docs, empty):
    df, rows = docs
    path = public_tokenizers.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(i, s) for i, s in rows if len(s) < 50_000 or " " in s]
    want = {i: m.encode(s) for i, s in rows}
    out = sentence_pieces.encode_documents(df, path, with_ids=True)
    got = {r.doc_id: r for r in out.collect()}
    for i, s in rows:
        assert got[i].ids == want[i], (i, s[:80])
        assert got[i].lossless == (m.decode(want[i]) == s)
    back = {r.doc_id: r.text for r in sentence_pieces.decode_documents(out, path).collect()}
    assert all(back[i] == m.decode(want[i]) for i, _ in rows)
    assert sentence_pieces.encode_documents(empty, path).count() == 0


def counts(s):
    words = WORD.findall(s)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in s.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", s)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, empty, spark, sf_dir):
    df, rows = docs
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert len(got) == len(rows)
    for i, s in rows:
        c, r = counts(s), got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c, (i, s[:80])
        assert r.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge(empty).count() == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    good = [got[r.doc_id].kept for r in labels if r.quality == 1 and not got[r.doc_id].base_failed]
    bad = [got[r.doc_id].kept for r in labels if r.quality == 0]
    assert all(good) and not any(bad)


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(0)
    n, k = 40_000, len(quality_rules.RULES)
    truth = rng.random(n) < 0.7
    accuracy = np.linspace(0.6, 0.95, k)
    votes = np.where(rng.random((n, k)) < accuracy, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    prior, odds = quality_rules.fit(sorted(Counter(map(tuple, votes.tolist())).items()))
    score = prior + sum(np.where(votes[:, j] == 1, o[1], o[-1]) for j, o in enumerate(odds))
    assert ((score > 0) == truth).mean() > 0.93
    assert [o[1] - o[-1] for o in odds] == sorted(o[1] - o[-1] for o in odds)


def test_spot_fingerprints(docs, empty):
    df, rows = docs
    got = {r.doc_id: r for r in spot_signatures.compare_edits(df).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    by_text = defaultdict(set)
    for k, (i, s) in enumerate(order):
        following = order[(k + 1) % len(order)]
        half = len(s) // 2
        edited = s[: len(s) - half] + following[1][:half]
        r = got[i]
        assert r.n_chars == len(s) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = ({*x.split(" ")} for x in (r.fingerprint, r.edited_fingerprint, got[following[0]].fingerprint))
        assert abs(r.near_edited - len(a & b) / len(a | b)) < 1e-6 and abs(r.near_next - len(a & c) / len(a | c)) < 1e-6
        by_text[s].add(r.fingerprint)
        by_text[edited].add(r.edited_fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert spot_signatures.compare_edits(empty).count() == 0
    one = df.where("doc_id = 3")
    assert spot_signatures.compare_edits(one).collect()[0].near_next == 1.0


def test_spot_near_duplicates(docs):
    df, rows = docs
    members, pairs = spot_signatures.near_duplicates(df, 0.7)
    of = {r.doc_id: r.class_id for r in members.collect()}
    fps = {r.doc_id: {*r.fingerprint.split(" ")} for r in spot_signatures.compare_edits(df).collect()}
    reps = sorted(set(of.values()))
    assert all(fps[i] == fps[c] for i, c in of.items())
    want = {(a, b) for k, a in enumerate(reps) for b in reps[k + 1 :] if len(fps[a] & fps[b]) >= 0.7 * len(fps[a] | fps[b])}
    assert {(r.class_a, r.class_b) for r in pairs.collect()} == want


def brute_components(rows, k, percent):
    sets = {}
    for i, s in rows:
        w = WORD.findall(lower(s))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if 100 * min(len(sets[a]), len(sets[b])) >= percent * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_minhash(docs, empty):
    df, rows = docs
    for k, percent in ((3, 85), (5, 80)):
        got = minhash.link_components(df, k, percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, k, percent) and len(got) == len(rows)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.link_components(empty).count() == 0


def test_minhash_large_groups(spark):
    """A family of edits around one text, chains of edits, and a passage that unlike texts share."""
    rng = np.random.default_rng(3)
    word = lambda: "w" + str(rng.integers(10**6))
    base, rows = [word() for _ in range(120)], []
    for _ in range(150):
        t = list(base)
        for at in rng.integers(0, 120, rng.integers(1, 6)):
            t[at] = word()
        rows.append(" ".join(t))
    chain = [word() for _ in range(150)]
    for at in range(0, 140, 4):
        chain[at] = word()
        rows.append(" ".join(chain))
    passage = [word() for _ in range(30)]
    rows += [" ".join([*passage, *(word() for _ in range(60))]) for _ in range(120)]
    rows = list(enumerate(rows))
    got = minhash.link_components(spark.createDataFrame([(i, s) for i, s in rows], "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 3, 85)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(205, 200), (203, 205), (203, 204)]
    got = {r.v: r.root for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {i: 200 for i in (200, 203, 204, 205)}


def test_license_scan(docs, empty):
    df, rows = docs
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert len(got) == len(rows)
    for i, s in rows:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(s))
        places, labels = [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            at = [j for j in range(len(words)) if words[j : j + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places, default=None), max(places, default=None)), (i, s[:80])
        assert r.base_labels == ",".join(sorted(labels))
        own = set(r.labels.split(",")) - {""}
        assert labels <= own and 0 <= r.score <= 1 and r.labels == ",".join(sorted(own))
        text = " ".join(words)
        for label, template in license_scan.TEMPLATES:
            if template in text:
                assert label in own
    assert license_scan.scan(empty).count() == 0


def test_license_diagonals(spark):
    template = dict((label, t) for label, t in license_scan.TEMPLATES if len(t.split()) > 20)["mit"].split()
    with_gap = template[:9] + ["really"] + template[9:]
    texts = [" ".join(["x"] * 7 + with_gap + ["y"] * 5), " ".join(template[::-1]), " ".join(template[:4]), " ".join(template + template)]
    rows = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows[0].labels == "mit" and (rows[0].spans[0].first, rows[0].spans[0].last) == (7, 7 + len(template))
    assert rows[1].labels == rows[2].labels == "" and len(rows[3].spans) == 2


def test_language_id(spark, docs, empty, sf_dir):
    df, rows = docs
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(got) == len(rows)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in rows)
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)
    assert not any(got[i].rejected for i in truth)
    for i, s in rows:
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in s)) and 0 <= got[i].score <= 1
    assert not any(got[len(truth) + k].rejected for k in (15, 17, 18))
    assert language_id.identify(empty).count() == 0


def test_kneser_ney_sums_to_one():
    """What a context predicts, any character seen or the end, has probabilities that sum to 1 at most, and nearly."""
    texts = {"a": ["abab abba baab", "abab"] * 3, "b": ["bcbc cbbc"] * 3}
    m = language_id.train(texts, 3)
    bits = lambda w: m.word_bits([w])[0]

    def end(w):
        """Bits of the end mark after ``w``, from the model's own tables by recursion over longer words."""
        codes, starts = language_id.encoded([w])
        hashes, _ = language_id.grams(codes, starts, 3)
        k = min(3, len(codes)) - 1
        out = 0.0
        while k >= 0:
            h = hashes[k][-1]
            at = min(int(np.searchsorted(m.keys[k], h)), len(m.keys[k]) - 1)
            if m.keys[k][at] == h:
                return -(out + m.logp[k][at])
            c = hashes[k - 1][-2] if k else None
            if k:
                at = min(int(np.searchsorted(m.context_keys[k], c)), len(m.context_keys[k]) - 1)
                out = out + (m.backoff[k][at] if m.context_keys[k][at] == c else 0)
            k -= 1
        return -(out + m.unseen)

    for w in ("", "a", "ab", "ba", "bc", "zz"):
        begun = bits(w) - end(w)
        total = 2.0 ** -end(w) + sum(2.0 ** -(bits(w + c) - end(w + c) - begun) for c in "abc")
        assert np.all(total > 0.85) and np.all(total <= 1 + 1e-6), (w, total)


def test_url_filter(spark, sf_dir):
    urls = ["http://a.net/en/7", "HTTP://A.Net/en/7/?x", "https://www.a.net/en/7.html#f", "http://a.net/en/8", "http://x.example.org/es/1", "http://notexample.org/es/1", "http://example.org/en/12", "http://org", "x://com/fr/", "http://b.com/de/a://c", "nothing", None, "", "://", "http://fr.com/fr"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([("a.net/en/7",), ("a.net/en/7",), (None,), ("org",)], "url string")
    got = {r.page_id: r for r in url_filter.judge(pages, listed).collect()}
    assert [got[i].verdict for i in range(4)] == ["block", "block", "block", "allow"]
    assert [got[i].rule for i in range(4, 15)] == ["example.org/es/", "org/", "example.org/en/1", None, "com/fr/", "com/de/", None, None, None, None, None]
    assert got[7].verdict == "block" and got[11].host == "" and got[11].path == "" and got[9].path == "/de/a://c"
    assert url_filter.judge(pages.limit(0), listed).count() == 0
    assert url_filter.judge(pages, listed.limit(0)).where("listed").count() == 0


def test_bloom_has_no_false_negative_and_few_false_positives(spark):
    from pyspark.sql import functions as F

    listed = spark.range(5000).select(F.concat(F.lit("h/"), "id").alias("url"))
    table, blocks = url_filter.bloom(listed, 5000)
    asked = spark.range(20_000).select("id", F.concat(F.lit("h/"), "id").alias("url"))
    need = url_filter._mask(F.col("url"))
    passed = asked.join(table, url_filter._block(F.col("url"), blocks) == F.col("block")).where(F.col("mask").bitwiseAND(need) == need)
    assert passed.where("id < 5000").count() == 5000 and passed.where("id >= 5000").count() < 600


def test_revisits(spark):
    rows = [
        (1, "http://a.com/x", 10, "response", 200, '"1"', "d1", {"etag": '"1"', "server": "s"}), (2, "https://www.a.com/x/?utm_source=q#f", 20, "revisit", 304, 'W/"1"', None, {"expires": "0", "server": "t"}), (3, "http://a.com/x", 15, "response", 404, '"9"', None, {}),
        (4, "http://a.com/x", 30, "response", 200, '"2"', "d2", None), (5, "http://a.com/x", 30, "revisit", 304, '"1"', None, None), (6, "http://a.com/x", 31, "revisit", 304, '"1"', None, {}), (7, "http://a.com/x", 32, "revisit", 304, None, "d2", {"date": "z"}),
        (8, "http://a.com/x", 33, "revisit", 304, None, None, {}), (9, "http://b.com/", 40, "revisit", 304, '"1"', None, {}), (10, None, 40, "revisit", 304, None, None, None), (11, "http://a.com/x", None, "revisit", 304, None, None, None),
    ]
    schema = "record_id long, url string, ts long, kind string, status int, etag string, last_modified string, headers map<string,string>"
    df = spark.createDataFrame(rows, schema)
    got = {r.record_id: (r.response_id, r.outcome, r.headers) for r in warc.resolve_revisits(df).collect()}
    assert got == {
        2: (1, "resolved", {"etag": '"1"', "server": "s", "expires": "0"}), 5: (1, "resolved", {"etag": '"1"', "server": "s"}), 6: (4, "changed", None), 7: (4, "resolved", {"date": "z"}), 8: (4, "unverified", None), 9: (None, "missing", None), 10: (None, "missing", None), 11: (None, "missing", None),
    }
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_revisits_against_search(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"http://h.com/{min(int(rng.integers(8)), 3)}", int(rng.integers(300)), "response" if rng.random() < 0.3 else "revisit", 200, '"e"', None, {}) for i in range(900)]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, status int, etag string, last_modified string, headers map<string,string>")
    want = {}
    for r in rows:
        if r[3] == "revisit":
            want[r[0]] = max(((x[2], x[0]) for x in rows if x[3] == "response" and x[1] == r[1] and x[2] < r[2]), default=(None, None))[1]
    assert {r.record_id: r.response_id for r in warc.resolve_revisits(df).collect()} == want


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    want = con.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in got.select(*names).collect())
