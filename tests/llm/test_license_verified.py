"""Spans of the license scan are aligned and told apart."""

from foliant.llm import license_scan


def test_versions_are_told_apart(spark):
    long = {label: t for label, t in license_scan.TEMPLATES if label.startswith("gpl") and "redistribute" in t}
    short = next(t for label, t in license_scan.TEMPLATES if label == "gpl-3.0" and "redistribute" not in t)
    w = long["gpl-2.0"].split()
    edited = " ".join([*w[:4], "really", *w[4:12], *w[13:]])
    texts = [long["gpl-2.0"], long["gpl-3.0"], short, short.replace("3", "2"), long["gpl-2.0"].replace("version 2", "version 4"), edited, "licensed under cc by sa 4 0", "licensed under cc by nc 4 0", "licensed under the apache license version 2"]
    rows = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[i].labels for i in range(9)] == ["gpl,gpl-2.0", "gpl,gpl-3.0", "gpl,gpl-3.0", "gpl", "gpl", "gpl,gpl-2.0", "cc-by,cc-by-sa-4.0", "cc-by,cc-by-nc-4.0", "apache-2.0"]


def test_chain_goes_forward_in_both(spark):
    hits = [(10, 0), (11, 1), (12, 5), (12, 2), (13, 1), (14, 3), (15, 2)]
    df = spark.createDataFrame([(hits, 6)], "hits array<struct<word:int,place:int>>, n int")
    assert [tuple(x) for x in df.select(license_scan.chain(df["hits"], df["n"]).alias("c")).first().c] == [(10, 0), (11, 1), (12, 2), (14, 3)]
