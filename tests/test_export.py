"""Nested training records, their report, atoms of formulas and SMILES, and lists of a page."""

import json

import pytest
from pyspark.sql import functions as F

from attesta.functions import structures
from attesta.operators import curation, graph, review


def test_nested_examples_have_every_part(spark):
    step = {
        "publication_number": "US-1-A1", "family_id": "f", "publication_date": "2024-01-01", "title": "t", "target_compound_id": "c", "preferred_name": "n", "active_moiety_id": "m", "material_form": "salt", "smiles": "CO", "inchi_key": "K", "route_id": "r", "step_id": "s1",
        "step_order": 1, "transformation_key": "k", "operation_summary": "o", "source_id": "src", "artifact_sha256": "a", "paragraph_id": "p", "section_type": "d", "char_start": 1, "char_end": 9, "evidence_text": "text", "text_sha256": "h", "evidence_status": "performed", "extraction_method": "x", "extractor_version": "1",
        "source_url": "u", "retrieved_at": "now", "license_code": "l", "redistribution_class": "open", "reaction_id": "R", "basis_kind": None, "basis_value_g": 25.0, "scale_band": "laboratory", "scale_confidence": 0.5, "yield_percent": 80.0, "reaction_confidence": 0.75, "reviewer_id": "w", "decided_at": "then", "rationale": "ok",
    }
    kinds = {int: "bigint", float: "double", str: "string", type(None): "string"}
    steps = spark.createDataFrame([tuple(step.values()), tuple((step | {"step_id": "s2", "reaction_id": "Q", "basis_kind": "batch_mass"}).values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in step.items()))
    who = spark.createDataFrame([("R", "produced", 1.0, "c", "CO", "K"), ("R", "consumed", 2.0, "b", "C", "B"), ("R", "consumed", None, "a", "O", "A")], "reaction_id string, role string, stoichiometry double, compound_id string, smiles string, inchi_key string")
    how = spark.createDataFrame([("R", "2", "time", "1 h", 1.0, "h"), ("R", "1", "temperature", "20 C", 20.0, "C")], "reaction_id string, condition_id string, condition_type string, value_text string, numeric_value double, unit string")
    out = curation.nested_examples(steps, who, how)
    found = {r.example_id: json.loads(p.payload_json) for r, p in zip(out.orderBy("example_id").collect(), curation.training_examples(out.orderBy("example_id")).collect(), strict=True)}
    one = found["reviewed:s1"]
    assert set(one) == {"schema_version", "example_id", "is_synthetic", "patent", "compound", "route", "reaction", "evidence", "quantities", "outcome", "labels", "linkage", "review"}
    assert one["compound"] == {"compound_id": "c", "preferred_name": "n", "active_moiety_id": "m", "material_form": "salt", "smiles": "CO", "inchi_key": "K"}
    assert one["evidence"]["source_artifact_sha256"] == "a" and one["evidence"]["text"] == "text" and one["evidence"]["license"] == "l" and len(one["evidence"]) == 15
    assert [(p["role"], p["compound_id"], p["stoichiometry"]) for p in one["reaction"]["participants"]] == [("consumed", "a", None), ("consumed", "b", 2.0), ("produced", "c", 1.0)]
    assert [c["condition_type"] for c in one["reaction"]["conditions"]] == ["temperature", "time"]
    assert one["quantities"] == [{"kind": "product_mass", "value": 25.0, "unit": "g", "confidence": 0.5}] and one["labels"]["development_stage_basis"] is None
    assert one["review"] == {"status": "accepted", "reviewer_id": "w", "reviewed_at": "then", "rationale": "ok"}
    two = found["reviewed:s2"]
    assert two["reaction"] == {"reaction_id": "Q", "participants": [], "conditions": []} and two["quantities"][0]["kind"] == "batch_mass"


def test_reports_without_anything_eligible(spark):
    reasons = spark.createDataFrame([("a",), ("b",), ("a",)], "reason string")
    report = curation.export_report(reasons, spark.createDataFrame([], "split string")).first()
    assert (report.candidate_steps, report.eligible_examples, report.excluded, report.split_counts) == (3, 0, {"a": 2, "b": 1}, {})
    report = curation.export_report(reasons.limit(0), spark.createDataFrame([], "split string")).first()
    assert (report.candidate_steps, report.excluded) == (0, {})


def test_atoms(spark):
    def atoms(f, *texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("a")).orderBy("i").collect()
        return [None if r.a is None else {x.symbol: x.n for x in r.a} for r in rows]

    assert atoms(structures.formula_atoms, "C8H9NO2", " C9H8O4 ", "C2H4NO2-", "ClCCl3", "NaCl", "CuSO4+2", "C12H10", "", None, "H2O)", "Xx2", "(CH3)2", "H") == [
        {"C": 8, "H": 9, "N": 1, "O": 2}, {"C": 9, "H": 8, "O": 4}, {"C": 2, "H": 4, "N": 1, "O": 2}, {"Cl": 4, "C": 1}, {"Na": 1, "Cl": 1}, {"Cu": 1, "S": 1, "O": 4}, {"C": 12, "H": 10}, None, None, None, None, None, {"H": 1},
    ]
    # paracetamol, aspirin, glycine as an ion, pyrrole, a chlorinated chain, selenophene, heavy water, an unknown symbol
    assert atoms(structures.smiles_atoms, "CC(=O)NC1=CC=C(C=C1)O", "CC(=O)Oc1ccccc1C(=O)O", "[NH3+]CC(=O)[O-]", "c1cc[nH]c1", "ClCC(Br)I", "c1cc[se]c1", "[2H]O[2H]", "[Xx]", "", None, "[C@@H](N)(C)O", "[Na+].[Cl-]") == [
        {"C": 8, "N": 1, "O": 2}, {"C": 9, "O": 4}, {"N": 1, "H": 3, "C": 2, "O": 2}, {"C": 4, "N": 1, "H": 1}, {"Cl": 1, "C": 2, "Br": 1, "I": 1}, {"C": 4, "Se": 1}, {"H": 2, "O": 1}, None, None, None, {"C": 2, "H": 1, "N": 1, "O": 1}, {"Na": 1, "Cl": 1},
    ]
    assert len(structures.ELEMENTS) == 118 and structures.ELEMENTS[78] == "Au"
    one = spark.range(1)
    assert one.select(structures.atomic_number(F.lit("Og")), structures.atomic_number(F.lit("D"))).first()[:] == (118, None)


def test_elements_of_what_is_walked(spark):
    f = spark.createDataFrame
    none = f([], "reaction string, publication string, relationship string")
    compounds = f([("T", True), ("s", True)], "compound string, has_structure boolean")
    elements = structures.compound_elements(f([("T", "C2H6O"), ("s", "C2H4"), ("other", "Au")], "compound string, f string"), "compound", "f")
    out = graph.evidence_backtrack(f([("d", "T")], "drug string, compound string"), f([("x", "T")], "reaction string, compound string"), f([("x", "s", "consumed")], "reaction string, compound string, role string"), none, compounds, 2, elements)
    assert {(r.source_id, r.target_id) for r in out["edges"].collect() if r.edge_type == "contains_element"} == {("compound:T", f"element:{n}") for n in (1, 6, 8)} | {("compound:s", f"element:{n}") for n in (1, 6)}


def test_lists_and_exceptions_have_their_order_and_limit(spark):
    parents = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    child = spark.createDataFrame([("a", i) for i in range(700)] + [("b", 1), ("z", 2)], "k string, n int")
    out = review.child_lists(parents, "k", {"top": (child, [F.col("n").desc()], 500), "all": (child, [F.col("n").asc()], None)}).collect()
    assert [json.loads(r.item)["n"] for r in sorted(out, key=lambda r: r.place) if (r.k, r.list) == ("a", "top")] == list(range(699, 199, -1))
    assert sum(r.k == "a" and r.list == "all" for r in out) == 700 and {r.k for r in out} == {"a", "b"}
    states = spark.createDataFrame([(f"j{i}", "failed" if i % 2 else "succeeded", 1, None if i == 1 else i) for i in range(250)], "job string, status string, attempts int, ended int")
    page = review.exceptions(states, ["job"], ("failed", "blocked"), "ended").collect()
    assert [r.ended for r in page] == list(range(249, 49, -2)) and len(page) == 100


def test_pages_of_the_catalogue_and_reports(spark):
    f = spark.createDataFrame
    drugs = f([(i, f"Drug {i:03d}") for i in range(300)], "drug_id int, preferred_name string")
    steps = ", ".join(f"{s} int" for s in review.STEPS)
    coverage = f([(i, review.STEPS[i % 3], *[int(i % 3 >= k) for k in range(3)], 0, 0, 0, 0, 0) for i in range(300)], f"drug_id int, status string, {steps}")
    aliases, compounds = f([(7, "Ålias"), (8, "alias 50%")], "drug_id int, alias string"), f([(7, "a"), (7, "b")], "drug_id int, compound_id string")
    products = f([(7, "x", "rx"), (7, "y", "otc"), (7, "z", "rx")], "drug_id int, regulatory_product_id string, marketing_status string")
    page = lambda **k: review.catalogue_page(drugs, coverage, aliases, compounds, products, **k)
    assert [r.drug_id for r in page(limit=3, offset=298)["items"].collect()] == [298, 299] and page()["items"].count() == 50 and page()["total"].first().total == 300
    one = page(query="LIAS")["items"].collect()
    assert [(r.drug_id, r.compound_count, r.product_count, r.marketing_statuses) for r in one] == [(7, 2, 3, ["otc", "rx"]), (8, 0, 0, [])]
    assert page(query="drug 01", status="patents_found")["total"].first().total == 4 and page(query="none")["items"].count() == 0
    assert page(query="x", status="identified")["status_counts"].first()[:3] == (300, 200, 100)
    for wrong in ({"status": "unknown"}, {"limit": 251}, {"limit": 0}, {"offset": -1}):
        with pytest.raises(ValueError):
            page(**wrong)
    jobs = f([("a", "failed", 5, 1), ("b", "succeeded", None, 9), ("c", "blocked", 7, 2)], "job string, status string, ended int, started int").withColumn("attempts", F.lit(1))
    out = review.status_report({"drugs": drugs, "none": drugs.limit(0)}, jobs, ["ended", "started"], "job", 2)
    assert {r.table_name: r.n_rows for r in out["tables"].collect()} == {"drugs": 300, "none": 0} and {r.status: r.n for r in out["job_statuses"].collect()} == {"failed": 1, "succeeded": 1, "blocked": 1}
    assert [r.job for r in out["recent"].collect()] == ["b", "c"] and [r.job for r in out["exceptions"].collect()] == ["c", "a"]


def test_extractions_need_review_or_fail(spark):
    f = spark.createDataFrame
    requests = f([(i, "p", "m", "prompt", "made from salt", None, 1) for i in range(7)], "extraction_job_id int, provider string, model string, prompt string, source_text string, source_url string, created_at int")
    good = '{"compounds": [], "reactions": [{"evidence_quote": "from salt"}, {}]}'
    rows = [(0, good, None, "{}", 2), (1, good.replace("salt", "sand"), None, "{}", 2), (2, '{"compounds": []}', None, "{}", 2), (3, None, "timeout", None, 2), (4, good, None, "{}", 2), (4, None, "late", None, 3), (5, "[1", None, "{}", 2)]
    out = {r.extraction_job_id: r for r in review.extraction_jobs(requests, f(rows, "extraction_job_id int, content string, error string, usage string, completed_at int")).collect()}
    assert {k: r.status for k, r in out.items()} == {0: "needs_review", 1: "failed", 2: "failed", 3: "failed", 4: "failed", 5: "failed", 6: "queued"}
    assert out[0].error is None and "absent" in out[1].error and "schema" in out[2].error and out[3].error == "timeout" and out[4].error == "late" and "schema" in out[5].error
    assert out[0].response_sha256 and not out[1].response_sha256 and {r.review_status for k, r in out.items() if k} == {"unreviewed"}


def test_extracted_examples_replace_what_they_said_before(spark):
    def row(seq, i, text, who, how=(), route="r"):
        return (seq, f"e{i}", "US1", "T", "m", route, f"s{i}", f"x{i}", f"name {seq}", text, "p", None, "k", 80.0, 100.0, 0.95, [(c, r, 1.0) for c, r in who], [(t, 1.0, "h") for t in how])

    frame = lambda *rows: spark.createDataFrame(list(rows), curation.EXTRACTED)
    first = curation.ingest_extracted(frame(row(1, 1, "old", [("a", "consumed"), ("T", "produced")], ["time"]), row(2, 2, "two", [("b", "consumed")])))
    candidates = {"patent_candidate": spark.createDataFrame([("US1", "d", "needs_review"), ("US2", "d", "needs_review")], "publication_number string, drug_id string, review_status string")}
    approval = spark.createDataFrame([("US1", "d", "w", "ok", "2024-05-01T10:00:00Z"), ("US2", "other", "w", "no", "2024")], "publication_number string, drug_id string, reviewer_id string, rationale string, decided_at string")
    done = curation.approve_publications(first | candidates, approval)
    assert {r.review_status for t in ("evidence_span", "process_step", "process_route", "reaction_instance") for r in done[t].collect()} == {"accepted"}
    assert {r.publication_number: r.review_status for r in done["patent_candidate"].collect()} == {"US1": "accepted", "US2": "needs_review"}
    assert [r.decision_id for r in done["curation_decision"].collect()] == ["decision:r:2024-05-01T10:00:00"] and [r.subject_id for r in done["link_candidate"].collect()] == ["r"]
    # the same example again, later in the file once more: its last text counts, it waits for review, and the other stays accepted
    again = curation.ingest_extracted(frame(row(1, 1, "new", [("z", "consumed")]), row(2, 1, "newest é", [("c", "consumed")], ["temperature", "time"])), done)
    spans = {r.evidence_span_id: r for r in again["evidence_span"].collect()}
    assert (spans["e1"].evidence_text, spans["e1"].char_end, spans["e1"].review_status, spans["e2"].review_status) == ("newest é", 8, "unreviewed", "accepted")
    assert {(r.reaction_id, r.compound_id) for r in again["reaction_participant"].collect()} == {("x1", "c"), ("x2", "b")}
    assert {r.condition_id for r in again["reaction_condition"].collect()} == {"x1-temperature", "x1-time"}
    assert curation.approve_publications(done, approval)["curation_decision"].count() == 1
