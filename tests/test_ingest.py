"""Ingestion on files made as the released ones are."""

import json
import sqlite3
import zipfile

import pytest

from attesta.operators import graph, ingest, matching
from attesta.operators.coverage import reconcile
from attesta.sources import files


def make_zip(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return str(path)


PRODUCTS = ["application_number", "product_number", "form_route", "strength", "trade_name", "ingredient", "type"]


def test_tab_delimited_products_with_status_tables(spark, tmp_path):
    p = make_zip(
        tmp_path / "a.zip",
        {
            "x/Products.txt": "﻿ApplNo\tProductNo\tForm\tStrength\tDrugName\tActiveIngredient\n019872\t001\tTABLET;ORAL\t500MG\tTYLENOL\tACETAMINOPHEN\n",
            "MarketingStatus.txt": "ApplNo\tProductNo\tMarketingStatusID\n19872\t1\t1\n",
            "MarketingStatus_Lookup.txt": "MarketingStatusID\tMarketingStatusDescription\n1\tPrescription\n3\tDiscontinued\n",
        },
    )
    rows = files.zip_table(spark, p, "products.txt", ["ApplNo", "ProductNo", "Form", "Strength", "DrugName", "ActiveIngredient"]).toDF("seq", "application_number", "product_number", "form_route", "strength", "trade_name", "ingredient")
    s = files.zip_table(spark, p, "MarketingStatus.txt", ["ApplNo", "ProductNo", "MarketingStatusID"]).toDF("seq", "application_number", "product_number", "status_id")
    k = files.zip_table(spark, p, "_Lookup.txt", ["MarketingStatusID", "MarketingStatusDescription"]).toDF("seq", "status_id", "description")
    out = ingest.regulatory_products(rows, s, k)
    r = out.collect()[0]
    assert (r.outcome, r.marketing_status, r.regulatory_product_id, r.dosage_form, r.route) == ("accepted", "active", "fda:products:019872:001", "TABLET", "ORAL")
    parts = ingest.product_entities(out)
    assert parts["drug_entity"].count() == 1 and parts["drug_alias"].count() == 3
    assert files.zip_table(spark, p, "absent.txt", ["a"], optional=True).count() == 0
    with pytest.raises(Exception, match="no member ends with"):
        files.zip_table(spark, p, "absent.txt", ["a"]).count()


def test_tilde_delimited_products_are_accounted_for(spark, tmp_path):
    head = "Appl_No~Product_No~DF;Route~Strength~Trade_Name~Ingredient~Type\n"
    p = make_zip(tmp_path / "b.zip", {"products.txt": head + "1~1~TABLET;ORAL~5MG~A~X; Y~RX\n2~1~CAPSULE~5MG~B~Z~DISCN\n~~~~~~\n"})
    rows = files.zip_table(spark, p, "products.txt", ["Appl_No", "Product_No", "DF;Route", "Strength", "Trade_Name", "Ingredient", "Type"], sep="~").toDF("seq", *PRODUCTS)
    out = ingest.regulatory_products(rows, None, None)
    per = out.dropDuplicates(["outcome", "reason", "regulatory_product_id"])
    r = reconcile(per, "outcome").collect()[0]
    assert (r.input_rows, r.accepted_rows, r.rejected_rows, r.balanced) == (3, 2, 1, True)
    assert {(x.reason, x.marketing_status) for x in out.collect()} == {(None, "active"), (None, "discontinued"), ("missing_application_number_and_product_number_and_active_ingredient", "unknown")}
    assert {x.ingredient for x in out.filter("outcome = 'accepted'").collect()} == {"X", "Y", "Z"}


def test_chemical_dictionary_from_sqlite(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "c.db")
    db.executescript(
        "CREATE TABLE molecule_dictionary (molregno INT, chembl_id TEXT, pref_name TEXT, max_phase INT, molecule_type TEXT); INSERT INTO molecule_dictionary VALUES (1, 'CHEMBL112', 'ACETAMINOPHEN', 4, 'Small molecule'), (2, 'CHEMBL9', 'SALT', 4, 'Small molecule'), (3, 'C3', 'OLD', 2, 'Small molecule'), (4, 'C4', 'OLIGO', 4, 'Oligonucleotide');"
        "CREATE TABLE compound_structures (molregno INT, canonical_smiles TEXT, standard_inchi_key TEXT); INSERT INTO compound_structures VALUES (1, 'CC', 'RZVAJINKPMORJF-UHFFFAOYSA-N');"
        "CREATE TABLE molecule_hierarchy (molregno INT, parent_molregno INT); INSERT INTO molecule_hierarchy VALUES (1, 1), (2, 1);"
        "CREATE TABLE molecule_synonyms (molregno INT, synonyms TEXT, syn_type TEXT); INSERT INTO molecule_synonyms VALUES (1, 'Paracetamol', 'INN');"
    )
    db.close()
    read = lambda t, *c: files.sqlite_table(spark, f"{tmp_path}/c.db", t, list(c)).drop("seq")
    out = ingest.chemical_dictionary(read("molecule_dictionary", "molregno", "chembl_id", "pref_name", "max_phase", "molecule_type"), read("compound_structures", "molregno", "canonical_smiles", "standard_inchi_key"), read("molecule_hierarchy", "molregno", "parent_molregno"), read("molecule_synonyms", "molregno", "synonyms", "syn_type"), ("Small molecule", "Oligonucleotide"))
    rows = {r.compound_id: r for r in out.collect()}
    assert set(rows) == {"compound:CHEMBL:CHEMBL112", "compound:CHEMBL:CHEMBL9", "compound:CHEMBL:C4"}
    assert rows["compound:CHEMBL:CHEMBL9"].drug_id == "drug:CHEMBL:CHEMBL112" and rows["compound:CHEMBL:CHEMBL9"].material_form == "salt_or_form"
    assert rows["compound:CHEMBL:CHEMBL112"].connectivity_key == "RZVAJINKPMORJF" and rows["compound:CHEMBL:CHEMBL112"].synonyms[0].synonyms == "Paracetamol"
    assert {r.modality for r in rows.values()} == {"small_molecule", "oligonucleotide"}
    with pytest.raises(Exception, match="tables are missing"):
        files.sqlite_table(spark, f"{tmp_path}/c.db", "nothing", ["a"]).count()


def test_three_forms_of_one_identifier_are_one_entity(spark):
    rec = spark.createDataFrame([(1, ["U:1", "K:a"]), (2, ["U:1", "K:b"]), (3, ["K:b"]), (4, ["Z:9"]), (5, ["O:1", "O:2"]), (6, [])], "seq long, keys array<string>")
    old = spark.createDataFrame([("drug:old", ["Z:9"]), ("drug:x", ["O:1"]), ("drug:y", ["O:2"])], "drug_id string, keys array<string>")
    out = {r.seq: r for r in ingest.resolve_identities(rec, old).collect()}
    assert out[1].drug_id == out[2].drug_id == out[3].drug_id != out[6].drug_id
    assert out[4].drug_id == "drug:old" and out[5].n_existing == 2 and out[1].n_existing == 0 and len(out) == 6


def test_converters(spark, tmp_path):
    rows = spark.createDataFrame([("1", "Aspirin", "RZVAJINKPMORJF-UHFFFAOYSA-N", "C", "yes", "small molecule"), ("2", "B", "x" * 27, "C", "no", ""), ("3", "C", "short", "C", "", "")], "cid string, title string, inchi_key string, smiles string, approved string, molecule_type string")
    assert [(r.outcome, r.reason) for r in ingest.pubchem(rows).collect()] == [("accepted", None), ("excluded", "not_approved"), ("rejected", "invalid_inchi_key")]
    (tmp_path / "e.json").write_text(json.dumps({"metadata": {}, "data": [{"name": "A", "substance": "x; y", "category": "Human", "status": "Authorised"}, {"name": "V", "substance": "z", "category": "Human", "status": "Authorised", "kind": "Vaccine"}]}))
    schema = "name string, substance string, product_number string, status string, category string, kind string, biologic string"
    from pyspark.sql.types import _parse_datatype_string

    env = files.json_envelope(spark, f"{tmp_path}/e.json", _parse_datatype_string(schema))
    out = ingest.ema(env).collect()
    assert sorted((r.outcome, r.reason or "", r.substance) for r in out) == [("accepted", "", "x"), ("accepted", "", "y"), ("excluded", "biologic_or_advanced_therapy", "z")]


def test_json_lines_and_csv(spark, tmp_path):
    from pyspark.sql.types import _parse_datatype_string

    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n{"a": \n')
    s = _parse_datatype_string("a long")
    assert sorted(r.a for r in files.json_lines(spark, f"{tmp_path}/a.jsonl", s).collect()) == [1, 2]
    with pytest.raises(Exception, match="invalid JSON line"):
        files.json_lines(spark, f"{tmp_path}/b.jsonl", s).collect()
    (tmp_path / "c.csv").write_text("x;y\n1;a, b\n2;c\n")
    assert files.delimited(spark, f"{tmp_path}/c.csv").collect()[0].y == "a, b"


def test_releases_do_not_change(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "f.bin").write_bytes(b"abc")
    from pyspark.sql import functions as F

    before = files.manifest(spark, f"{tmp_path}/r").withColumn("release_id", F.lit("1")).collect()
    before = spark.createDataFrame(before, "path string, size_bytes long, sha256 string, release_id string")
    assert files.changed_artifacts(before, before).count() == 0
    (tmp_path / "r" / "f.bin").write_bytes(b"abd")
    assert files.changed_artifacts(before, files.manifest(spark, f"{tmp_path}/r").withColumn("release_id", F.lit("1"))).count() == 1


def test_candidates(spark):
    rows = spark.createDataFrame([("d", "c", "us 123 a1", "7", None, "exact_structure", None, "-1"), ("d", "c", "EP9", "7", "3", "same_connectivity", "EP", "99")], "drug_id string, compound_id string, publication_number string, source_compound_id string, field_id string, match_type string, country string, family_id string")
    a, b = ingest.patent_candidates(rows).collect()
    assert (a.publication_number, a.confidence, a.country_code, a.family_id) == ("US123A1", 0.98, "US", "surechembl-publication:US123A1")
    assert (b.confidence, b.family_id) == (0.85, "surechembl:99") and a.candidate_id != b.candidate_id
    with pytest.raises(Exception, match="unknown match type"):
        ingest.patent_candidates(rows.withColumn("match_type", rows.country)).collect()
    ok = spark.createDataFrame([("a" * 64,)] * 3, "snapshot_manifest_sha256 string")
    assert ingest.one_manifest(ok) == "a" * 64
    with pytest.raises(ValueError):
        ingest.one_manifest(ok.union(spark.createDataFrame([("b" * 64,)], "x string")))


def test_records_that_require_an_existing_drug_are_held_back(spark):
    rows = [(1, ["K:old"], "Other", True), (2, [], "Aspi-rin", True), (3, ["K:n"], "Twin", True), (4, ["K:m"], "Nobody", True), (5, ["K:new"], "Fresh", False), (6, ["K:new"], "Fresh salt", True), (7, [], "fresh", True), (8, ["K:late"], "Late", True), (9, ["K:late"], "Late", False), (10, [], "Aspirin", None)]
    rec = spark.createDataFrame(rows, "seq long, keys array<string>, name string, requires_existing_drug boolean")
    old = spark.createDataFrame([("drug:old", ["K:old"])], "drug_id string, keys array<string>")
    names = spark.createDataFrame([("drug:a", "ASPI RIN"), ("drug:t1", "twin"), ("drug:t2", "Twin")], "drug_id string, name string")
    out = {r.seq: r for r in ingest.route_identities(rec, old, names).collect()}
    assert {k: (r.outcome, r.reason) for k, r in out.items() if r.reason} == {2: ("excluded", "name_only_match_requires_review"), 3: ("excluded", "ambiguous_name_match"), 4: ("excluded", "unmatched_existing_drug"), 7: ("excluded", "name_only_match_requires_review"), 8: ("excluded", "unmatched_existing_drug")}
    assert out[2].candidates == ["drug:a"] and out[3].candidates == ["drug:t1", "drug:t2"] and out[4].candidates == [] and out[7].candidates == [out[5].drug_id]
    assert out[1].drug_id == "drug:old" and out[6].drug_id == out[5].drug_id and out[9].drug_id and out[10].outcome == "accepted"
    assert all(r.drug_id is None for r in out.values() if r.outcome == "excluded") and len(out) == 10


def test_errors_name_file_and_line(spark, tmp_path):
    from pyspark.sql import types as T

    from attesta.sources import files

    path, schema = tmp_path / "rows.jsonl", T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    good = [f'{{"a": {i}, "b": "é{"x" * (i % 50)}"}}' for i in range(400)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        text = lambda rows: "\n \t\n".join(rows) + "\r\n\n"
        path.write_text(text(good))
        assert len({r.split for r in files.lines(spark, str(path)).select("split").distinct().collect()}) > 3
        assert sorted((r.line, r.value.strip()) for r in files.numbered_lines(spark, str(path)).collect()) == list(enumerate(good, 1))
        assert [r.a for r in files.json_lines(spark, str(path), schema).orderBy("a").collect()] == list(range(400))
        for at in (0, 150, 260, 399):
            path.write_text(text([*good[:at], '{"a": 1', *good[at + 1 :]]))
            with pytest.raises(ValueError, match=rf"rows\.jsonl:{at + 1}: "):
                files.json_lines(spark, str(path), schema)
        with pytest.raises(Exception, match="invalid JSON line in"):
            files.json_lines(spark, str(path), schema, check=False).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_component_names_are_digests_of_sorted_members(spark):
    import hashlib

    groups = {"a": [f"n{i:05d}" for i in range(25_000)], "b": ["x"], "c": ["é", "z", "A"]}
    rows = [(n, k) for k, own in groups.items() for n in own] + [("x", "b"), (None, "b")]
    label = spark.createDataFrame(rows, "node string, component string").repartition(5)
    got = {r.node: r.leakage_group for r in graph.group_names(label, "node", "component").collect() if r.node}
    want = {k: "component:" + hashlib.sha256("|".join(sorted(own)).encode()).hexdigest()[:24] for k, own in groups.items()}
    assert got == {n: want[k] for k, own in groups.items() for n in own}


def test_owners_of_a_key_are_not_gathered(spark):
    ids = spark.createDataFrame([(1, "k1"), (1, "k2"), (2, "k2"), (3, "k3"), (4, "k9"), (5, "k4"), (5, "k5")], "r int, k string")
    own = spark.createDataFrame([("k1", 7), ("k2", 7), ("k2", 7), ("k4", 1), ("k5", 2), ("k2", None), *[("k3", i) for i in range(5000)]], "k string, o int")
    out = {r.r: r for r in matching.identity_conflicts(ids, "r", ["k"], own, "o").collect()}
    assert {(r.r, r.least_owner, r.greatest_owner) for r in out.values()} == {(3, 0, 4999), (5, 1, 2)}
    assert abs(out[3].about_owners - 5000) < 1000 and out[5].about_owners == 2
    plan = matching.identity_conflicts(ids, "r", ["k"], own, "o")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect" not in plan
