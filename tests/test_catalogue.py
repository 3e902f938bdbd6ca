"""Edges of the ingestion, curation, report and file operators that the queries do not reach."""

import datetime
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions import scalars as S
from attesta.operators import costing, coverage, curation, graph, ingest, matching, merge, top
from attesta.sources import files
from attesta.streaming import jobs


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


@pytest.mark.parametrize(("raw", "want"), [("US/123/A1", "US-123-A1"), ("US-D123456-S1", "US-D123456-S1"), ("USRE12345E1", "US-RE12345-E1"), ("US123A", None), ("us 123 a", "US-123-A"), ("", None), (None, None), ("EP--1//B1", "EP-1-B1"), ("1-2-3", None)])
def test_publication_numbers(spark, raw, want):
    assert one(spark, S.publication_dashed(F.col("x")), raw) == want


@pytest.mark.parametrize(("raw", "want"), [("Over-the-counter", "active"), ("Rx.", "active"), ("Discn*", "discontinued"), ("", "unknown"), (None, "unknown")])
def test_marketing_status(spark, raw, want):
    assert one(spark, S.marketing_status(F.col("x")), raw) == want


def test_canonical_json_sorts_every_level_and_keeps_nulls(spark):
    df = spark.createDataFrame([(1, {"b": 2, "a": 1}, None, [{"z": 1, "k": None}])], "n int, m map<string, int>, gone struct<q: int, p: int>, l array<struct<z: int, k: string>>")
    text = df.select(S.canonical_json(df, *df.columns).alias("j")).first().j
    assert text == '{"gone":null,"l":[{"k":null,"z":1}],"m":{"a":1,"b":2},"n":1}' and json.loads(text)


def test_accounting_that_does_not_add_up_is_an_error(spark):
    rows = spark.createDataFrame([("accepted",), ("lost",)], "outcome string")
    assert coverage.reconcile(rows, "outcome").first().balanced is False
    with pytest.raises(PySparkException, match="do not add up"):
        coverage.reconcile(rows, "outcome", strict=True).collect()


def test_candidates_of_unknown_links_and_types_are_errors(spark):
    schema = "drug_id string, compound_id string, publication_number string, source_compound_id string, field_id string, match_type string, country string, family_id string, title string, publication_date string, field_name string, seq int"
    row = ("d", "c", "us 1 a1", "s", None, "exact_structure", None, None, "t", None, "claims", 1)
    links = spark.createDataFrame([("d", "c")], "drug_id string, compound_id string")
    good = ingest.merge_candidates(spark.createDataFrame([row, (*row[:5], "same_connectivity", *row[6:8], None, "2024-01-01", "title", 2)], schema), links, "seq")
    c, d = good["patent_candidate"].collect(), good["patent_document"].collect()
    assert [(r.match_type, r.confidence, r.field_name) for r in c] == [("exact_structure", 0.85, "title")]  # the type is frozen
    assert [(r.publication_number, r.title, r.publication_date) for r in d] == [("US1A1", "t", "2024-01-01")]
    again = ingest.merge_candidates(spark.createDataFrame([(*row[:8], "new", None, "claims", 1)], schema), links, "seq", good)
    assert [(r.title, r.publication_date) for r in again["patent_document"].collect()] == [("new", "2024-01-01")] and again["patent_family"].count() == 1
    for bad in ((*row[:5], "other", *row[6:]), ("x", *row[1:])):
        with pytest.raises(PySparkException):
            [t.collect() for t in ingest.merge_candidates(spark.createDataFrame([bad], schema), links, "seq").values()]


def test_large_chemicals_of_other_types_are_errors(spark):
    schema = "chembl_id string, molecule_type string, parent_id string, pref_name string, smiles string, inchi_key string, synonyms array<string>"
    out = ingest.large_chemicals(spark.createDataFrame([("C1", "Protein", None, None, None, " ", ["B", " b ", "c1", None])], schema), {"Protein": "protein"}).first()
    assert (out.preferred_name, out.aliases, out.chembl_parent, out.inchi_key, out.material_form) == ("C1", ["B"], "C1", None, "active_moiety")
    with pytest.raises(PySparkException, match="no wanted modality: C2"):
        ingest.large_chemicals(spark.createDataFrame([("C2", "Cell", None, None, None, None, None)], schema), {"Protein": "protein"}).collect()


def test_owners_are_counted_once_for_all_keys(spark):
    ids = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (2, "a", "x"), (3, "a", "z")], "r int, ns string, v string")
    owners = spark.createDataFrame([("p", "a", "x"), ("p", "a", "y"), ("q", "a", "y"), (None, "a", "z")], "owner string, ns string, v string")
    assert [(r.r, r.about_owners) for r in matching.identity_conflicts(ids, "r", ["ns", "v"], owners, "owner").collect()] == [(1, 2)]


def test_asof_in_ranges_equals_asof_in_one_sequence(spark):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    left = spark.createDataFrame([(k, at(h)) for k in "ab" for h in range(0, 200, 7)], "k string, t timestamp")
    right = spark.createDataFrame([("a", at(h), float(h)) for h in (3, 50, 51, 140)] + [("a", at(60), None), ("c", at(1), 1.0)], "k string, t timestamp, v double")
    plain = sorted(map(tuple, top.asof(left, right, ["k"], "t", "t", "v", ["t"]).collect()))
    for width in (3600.0, 86400.0, 1e9):
        assert sorted(map(tuple, top.asof(left, right, ["k"], "t", "t", "v", ["t"], width=width).collect())) == plain
    assert len(plain) == 28


def test_groups_and_splits_do_not_depend_on_order(spark):
    rows = [("1", "f1", None), ("2", "f1", "m1"), ("3", None, "m1"), ("4", None, None), ("5", "m1", None)]
    a = curation.assign_splits(spark.createDataFrame(rows, "id string, f string, m string"), "id", ["f", "m"], "s")
    b = curation.assign_splits(spark.createDataFrame(rows[::-1], "id string, f string, m string"), "id", ["f", "m"], "s")
    got = {r.id: (r.leakage_group, r.split) for r in a.collect()}
    assert got == {r.id: (r.leakage_group, r.split) for r in b.collect()}
    assert got["1"] == got["2"] == got["3"] and len({got[k][0] for k in "145"}) == 3  # f and m are different namespaces


def test_yields_count_only_together(spark):
    steps = spark.createDataFrame([("r", "x", 50.0, "P", False, 5.0), ("r", "y", 50.0, None, None, None), ("q", "z", None, "P", True, None)], "route string, reaction string, yield_percent double, publication string, is_synthetic boolean, scale_g double")
    parts = spark.createDataFrame([("x", "A"), ("y", "A"), ("y", "B")], "reaction string, compound string")
    hazards = spark.createDataFrame([("A", 0.5, "accepted"), ("B", 0.2, "accepted"), ("B", 0.9, "rejected")], "compound string, severity double, status string")
    got = {r.route: r for r in costing.step_summary(steps, parts, hazards).collect()}
    assert (got["r"].cumulative_yield, got["r"].evidence_share, round(got["r"].severity, 6)) == (0.25, 0.5, 0.4)
    assert (got["q"].cumulative_yield, got["q"].evidence_share, got["q"].severity) == (0.0, 0.0, 0.0)


def test_traversal_meets_an_edge_from_both_ends(spark):
    e = spark.createDataFrame([("a", "b", "t"), ("b", "a", "u"), ("c", "c", "loop"), ("b", "c", "t")], "source_id string, target_id string, edge_type string")
    n = spark.createDataFrame([("a", "A")], "node_id string, label string")
    start = spark.createDataFrame([("a",)], "node_id string")
    got = sorted((r.edge_type, r.source_id, r.traversed_from, r.level, r.source_label or "") for r in graph.traverse(e, n, start, 2).collect())
    assert got == [("t", "a", "a", 1, "A"), ("t", "a", "b", 2, "A"), ("t", "b", "b", 2, ""), ("u", "b", "a", 1, ""), ("u", "b", "b", 2, "")]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n;t\n1;"two\nlines"\n2;plain\n')
    (tmp_path / "b.csv").write_text("n;t\n1;x\n")
    assert [tuple(r) for r in files.delimited(spark, f"{tmp_path}/a.csv").collect()] == [("1", "two\nlines"), ("2", "plain")]
    assert [tuple(r) for r in files.delimited(spark, f"{tmp_path}/b.csv").collect()] == [("1", "x")]
    files.write_json(spark.createDataFrame([(1, None)], "b int, a string"), f"{tmp_path}/out")
    report = files.output_report(spark, f"{tmp_path}/out").first()
    assert report.size_bytes == len('{"a":null,"b":1}\n') and len(report.sha256) == 64 and report.n_files >= 1
    with pytest.raises(ValueError, match="invalid JSON line"):
        files.write_json(spark.createDataFrame([("x",)], "a string"), f"{tmp_path}/bad")
        (tmp_path / "bad" / "part-9.txt").write_text("{oops\n")
        files.json_lines(spark, f"{tmp_path}/bad", T.StructType([T.StructField("a", T.StringType())])).collect()


def test_recognised_texts_are_never_accepted(spark, tmp_path):
    for name, body in (("a", {"publication": "P1", "status": "ok", "text": " ", "pages": ["x", "y"]}), ("b", {"publication": "P1", "status": "error", "text": "t"}), ("c", {"publication": "P2", "status": "ok", "text": "t"})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "result.json").write_text(json.dumps(body))
    (tmp_path / "a" / "page.json").write_text("{}")
    out = files.ocr_results(spark, str(tmp_path), spark.createDataFrame([("P1",)], "publication string"))
    assert sorted((r.publication, r.review_status, r.text, r.n_pages) for r in out.collect()) == [("P1", "failed", "t", 0), ("P1", "needs_review", "x\n\ny", 2), ("P2", "rejected", "t", 0)]


def test_checked_tables_are_not_published(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="not published"):
        merge.publish(df, f"{tmp_path}/t", df)
    assert not (tmp_path / "t").exists()


def test_training_examples_are_canonical(spark):
    df = spark.createDataFrame([(2, (1, None))], "b int, a struct<z: int, y: string>")
    assert curation.training_examples(df).first().payload_json == '{"a":{"y":null,"z":1},"b":2}'


def test_a_job_that_is_announced_again_is_skipped(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([("j", at), ("j", at), ("k", at)], "job string, ts timestamp").write.parquet(f"{tmp_path}/in")
    jobs.consume(spark, f"{tmp_path}/in", lambda s: jobs.once(s, ["job"], "ts", "1 hour"), f"{tmp_path}/out", f"{tmp_path}/cp")
    jobs.consume(spark, f"{tmp_path}/in", lambda s: jobs.once(s, ["job"], "ts", "1 hour"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted(r.job for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["j", "k"]


def test_registries_with_errors_are_not_registered(spark):
    schema = "source_id string, name string, authority string, role string, collection_mode string, redistribution string, license_code string, runtime_dependency boolean, automated_acquisition_allowed boolean"
    sound = ("a", "n", "x", "r", "m", "open", "l", False, None)
    stored = spark.createDataFrame([("a", "before", "x", "r", "m", "open", "l", False, None), ("b", "kept", "x", "r", "m", "open", "l", False, None)], schema)
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    assert {r.source_id: r.name for r in curation.register_sources(stored, frame(sound)).collect()} == {"a": "n", "b": "kept"}
    issues = lambda *rows: {(r.code, r.severity) for r in curation.registry_issues(frame(*rows)).collect()}
    assert issues(sound) == set() and issues(sound, sound) == {("duplicate_source", "error")}
    assert issues((*sound[:7], None, None)) == {("runtime_dependency", "error")} and issues((*sound[:6], "", False, False)) == {("required_license_code", "error")}
    assert issues(("wipo_patentscope_public", *sound[1:])) == {("wipo_terms", "error")} and issues(("wipo_patentscope_public", *sound[1:8], False)) == set()
    assert issues((*sound[:5], "restricted", "l", False, True)) == {("restricted_acquisition", "warning")}
    with pytest.raises(ValueError, match="registry: a runtime_dependency"):
        curation.register_sources(stored, frame((*sound[:7], True, None)))
