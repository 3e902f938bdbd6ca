import hashlib
import re

from attesta.llm.exact_dedup import exact_dedup
from attesta.llm.queries import op1_exact_dedup


def brute(rows):
    norm = {i: re.sub("[\x20\x09-\x0d]", "", t or "") for i, t in rows}
    groups = {}
    for i, t in rows:
        groups.setdefault(norm[i], []).append((-len(t or ""), i))
    return {i: (min(groups[norm[i]])[1], len(groups[norm[i]]), min(groups[norm[i]])[1] == i, hashlib.sha256(norm[i].encode()).hexdigest()) for i, _ in rows}


def test_edges(spark):
    rows = [(1, "a b"), (2, "ab"), (3, "a\tb\n"), (4, None), (5, ""), (6, " "), (7, "x" * 200 + "1"), (8, "x" * 200 + "2"), (9, "x" * 200 + "1"), (10, "ab "), (11, "é\xa0b"), (12, "éb"), (13, "z" * 100_000)]
    df = spark.createDataFrame([(i, t, "s", "n", 7) for i, t in rows], "doc_id long, text string, sha string, norm string, keep_id int").repartition(3)
    want = brute(rows)
    for full in (True, False):
        got = {r.doc_id: r for r in exact_dedup(df, digest_all=full).collect()}
        assert {k: (r.keep_id, r.group_size, r.kept) for k, r in got.items()} == {k: v[:3] for k, v in want.items()}
        assert all(r.text_sha256 == want[k][3] or (not full and r.text_sha256 is None and r.group_size == 1) for k, r in got.items())


def test_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (2, "b")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup(df).collect())
    assert got == [(0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True), (2, 2, 1, True)]
    assert exact_dedup(df.limit(0)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in op1_exact_dedup(spark, d).collect()} == brute(rows)
