"""Behaviour of the operators on small tables with nulls, ties and repeats."""

import hashlib

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from attesta.functions import scalars as S
from attesta.operators import costing, curation, graph, matching, merge, review, routes, top


def example(i, value, unit, band, text="2 g were made", status="accepted"):
    return Row(
        schema_version="1", example_id=f"e{i}", is_synthetic=False,
        patent=Row(publication_number=f"US-{i}23-A1", family_id=f"f{i % 2}", publication_date="2020-01-31", title="t"),
        compound=Row(compound_id=f"c{i}", preferred_name="n", active_moiety_id=f"m{i % 3}", active_moiety_name="a", material_form="salt", inchi_key=None, connectivity_key=None),
        route=Row(route_id=f"r{i}", step_id=f"s{i}", step_order=1, transformation_key="k", operation_summary="o"),
        evidence=Row(source_id="src", source_artifact_sha256="a" * 64, paragraph_id="p", section_type="x", char_start=0, char_end=len(text), text=text, span_sha256=hashlib.sha256(text.encode()).hexdigest(), status="performed", extraction_method="m", extractor_version="1", retrieved_at="2020-01-01", license="l", redistribution_class="r"),
        quantities=[Row(kind="product_mass", value=float(value), unit=unit, confidence=0.9), Row(kind="input_mass", value=1e6, unit="kg", confidence=0.5)],
        outcome=Row(yield_percent=80.0, purity_percent=99.0, outcome_type="o", confidence=1.0), labels=Row(scale_band=band, development_stage="unknown", development_stage_basis=None, confidence=0.8),
        linkage=Row(match_type="exact_structure", confidence=0.9), review=Row(status=status, reviewer_id="me", reviewed_at="2021-01-01", rationale="x"),
    )


@pytest.fixture(scope="module")
def examples(spark):
    rows = [example(1, 2, "g", "laboratory"), example(2, 25, "kg", "pilot"), example(3, 750, "mg", "sub_gram"), example(4, 150, "kg", "manufacturing")]
    return spark.createDataFrame(rows, _parse_datatype_string(curation.EXAMPLE))


def test_examples_are_valid_and_fill_the_tables(spark, examples):
    sources = spark.createDataFrame([("src",)], "source_id string")
    assert curation.validation_issues(examples, sources).count() == 0
    t = curation.tables(examples)
    assert t["process_step"].count() == 4 and t["active_moiety"].count() == 3 and t["quantity_observation"].count() == 8
    assert {r.step_id: r.basis_value_g for r in t["scale_label"].collect()}["s2"] == 25000.0
    bad = examples.withColumn("evidence", F.col("evidence").withField("text", F.lit("other"))).withColumn("patent", F.col("patent").withField("publication_date", F.lit("2020-13-01")))
    assert {r.code for r in curation.validation_issues(bad, sources).collect()} == {"span_hash_mismatch", "date"}
    assert {r.code for r in curation.validation_issues(examples, sources.limit(0)).collect()} == {"unknown_source"}
    assert curation.duplicate_ids(examples.unionByName(examples.limit(1))).count() == 1


def test_approval_goes_to_spans_and_whole_routes(spark):
    steps = spark.createDataFrame([("s1", "r1", "e1", "needs_review"), ("s2", "r1", "e2", "needs_review"), ("s3", "r2", "e3", "needs_review")], "step_id string, route_id string, evidence_span_id string, review_status string")
    spans = spark.createDataFrame([(f"e{i}", "needs_review") for i in (1, 2, 3)], "evidence_span_id string, review_status string")
    routes = spark.createDataFrame([("r1", "needs_review"), ("r2", "needs_review")], "route_id string, review_status string")
    out = curation.approve(steps, spans, routes, spark.createDataFrame([("s1", "accepted"), ("s3", "accepted")], "step_id string, decision string"))
    assert {r.route_id: r.review_status for r in out["process_route"].collect()} == {"r1": "needs_review", "r2": "accepted"}
    assert {r.evidence_span_id for r in out["evidence_span"].filter("review_status = 'accepted'").collect()} == {"e1", "e3"}


def test_merge_policies(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k long, v string, w string")
    new = spark.createDataFrame([(1, None, "y", 1), (2, "c", "z", 1), (2, None, "q", 2), (3, "n", None, 1), (None, "u", "u", 1)], "k long, v string, w string, seq long")
    get = lambda p, **k: {r.k: (r.v, r.w) for r in merge.upsert(old, new, ["k"], p, order="seq", **k).collect()}
    assert get({}) == {1: (None, "y"), 2: (None, "q"), 3: ("n", None), None: ("u", "u")}
    assert get({"v": merge.NEW_UNLESS_NULL, "w": merge.OLD_UNLESS_NULL}) == {1: ("a", "x"), 2: ("c", "z"), 3: ("n", None), None: ("u", "u")}
    assert get({}, default=merge.FROZEN) == {1: ("a", "x"), 2: ("b", None), 3: ("n", None), None: ("u", "u")}
    again = merge.upsert(merge.upsert(old, new, ["k"], {}, order="seq"), new, ["k"], {}, order="seq")
    assert {r.k: (r.v, r.w) for r in again.collect()} == get({})


def test_or_match_with_nulls(spark):
    seeds = spark.createDataFrame([(1, "A", "p"), (2, None, "q"), (3, "C", None), (4, None, None)], "id long, k string, c string")
    snap = spark.createDataFrame([(10, "A", "p"), (11, None, "q"), (12, "B", "p"), (13, "C", None), (14, None, None)], "sid long, k string, c string")
    out = {(r.id, r.s_sid): (r.match_type, r.confidence) for r in matching.match_either(seeds, snap, "k", "c").collect()}
    e, c = ("exact_structure", 0.98), ("same_connectivity", 0.85)
    assert out == {(1, 10): e, (1, 12): c, (2, 11): c, (3, 13): e}


def test_asof_ties_and_nothing_before(spark):
    a = spark.createDataFrame([(1, "x", 5), (2, "x", 1), (3, "y", 9), (4, "x", 7)], "id long, k string, t long")
    b = spark.createDataFrame([("x", 5, 1.0), ("x", 6, None), ("x", 2, 0.5)], "k string, t2 long, r double")
    assert {r.id: r.r for r in top.asof(a, b, ["k"], "t", "t2", "r", ["id"]).collect()} == {1: 1.0, 4: 1.0}


def test_components_and_backtracking(spark):
    e = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("z1", "z2"), ("z2", "z1"), ("z1", "z1")], "a string, b string")
    out = {r.node: r.component for r in graph.components(e, "a", "b").collect()}
    assert {out[f"n{i:03}"] for i in range(41)} == {"n000"} and out["z2"] == "z1"
    edge = e.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"))
    back = {r.node_id: r.level for r in graph.backtrack(edge, spark.createDataFrame([("n005",), ("z1",)], "node_id string"), 3).collect()}
    assert back == {"n005": 0, "n004": 1, "n003": 2, "n002": 3, "z1": 0, "z2": 1}


def test_routes(spark):
    reactions = spark.createDataFrame([("A", "T", 0.95), ("B", "T", 0.9), ("X", "I", 0.8), ("C", "T", 0.5), ("L", "I", 0.1)], "reaction string, product string, confidence double")
    inputs = spark.createDataFrame([("A", "s1"), ("A", "s3"), ("B", "s2"), ("B", "s3"), ("C", "I"), ("X", "s1"), ("L", "T")], "reaction string, compound string")
    start = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "compound string")
    target = spark.createDataFrame([("T",), ("s1",)], "compound string")
    out = routes.enumerate_routes(reactions, inputs, start, target).collect()
    assert {(r.compound, r.path) for r in out} == {("T", "A"), ("T", "B"), ("T", "X>C"), ("s1", "")}
    assert [r.path for r in sorted((r for r in out if r.compound == "T"), key=lambda r: (r.n_steps, -r.confidence))][0] == "A"
    none = routes.enumerate_routes(reactions.filter("reaction not in ('A', 'B', 'C')"), inputs, start, target.filter("compound = 'T'"))
    assert none.count() == 0
    q = spark.createDataFrame([("s1", "q1", 1000.0, 18.0, 1.0, 1500.0), ("s1", "q2", 2000.0, 36.0, 1.0, 1500.0)], "k string, quote_id string, pack_g double, price double, rate double, need_g double")
    r = costing.cheapest_quotes(q, "k").collect()[0]
    assert (r.quote_id, r.packs, float(r.package_cost), float(r.continuous_cost)) == ("q1", 2, 36.0, 27.0)


def test_review_batch_and_pages(spark):
    fixed = spark.createDataFrame([(1, 5)], "k long, s long")
    auto = spark.createDataFrame([(1, 9), (2, 7), (3, 8)], "k long, s long")
    assert sorted(r.k for r in review.batch(fixed, auto, 2, "k", [F.col("s").desc()]).collect()) == [1, 3]
    with pytest.raises(ValueError):
        review.batch(fixed, auto, 9, "k", [F.col("s").desc()])
    pages = spark.createDataFrame([(1, 1, "A" * 600), (1, 2, "B" * 600), (2, 1, ""), (2, 2, "few words"), (3, 1, None)], "d long, p long, t string")
    assert {r.d: r.route for r in review.pdf_routing(pages, "d", "t").collect()} == {1: "text_extraction", 2: "ocr", 3: "ocr"}
    assert sorted((r.char_start, r.char_end) for r in review.page_offsets(pages.filter("d = 1"), "d", "p", "t").collect()) == [(0, 600), (602, 1202)]


def test_scalars(spark):
    df = spark.createDataFrame([("Aspirin, (USP)",), ("  ",), (None,)], "x string")
    assert [r[0] for r in df.select(S.normalize_name(F.col("x"))).collect()] == ["aspirin usp", "", None]
    assert [r[0] for r in df.select(S.clean(F.col("x"))).collect()] == ["Aspirin, (USP)", None, None]
    one = spark.range(1)
    get = lambda c: one.select(c).collect()[0][0]
    assert get(S.zfill(F.lit("1234567"), 6)) == "1234567" and get(S.zfill(F.lit("7"), 3)) == "007"
    assert get(S.stable_id("p", F.lit("a"), F.lit(None), F.lit(3))) == "p:" + hashlib.sha256(b"a||3").hexdigest()[:24]
    assert get(S.publication_dashed(F.lit("us 123 a1"))) == "US-123-A1" and get(S.publication_dashed(F.lit("?"))) is None
    assert get(S.finite(F.lit("nan"))) is None and get(S.finite(F.lit("1.5"))) == 1.5
    assert get(S.has_phrase(F.lit("process for aspirin tablets"), F.lit("aspirin"))) and not get(S.has_phrase(F.lit("aspirins"), F.lit("aspirin")))
    v = int(hashlib.sha256(b"s|g").hexdigest()[:13], 16) / (1 << 52)
    assert get(S.bucket(F.lit("g"), "s")) == v


@pytest.mark.parametrize("depth", [12, 13])
def test_leaves_of_deep_routes(spark, depth):
    steps = [("r", f"s{i}", f"c{i}", 50.0) for i in range(depth)]
    inputs = [(f"s{i}", c, 1.0) for i in range(depth) for c in (f"c{i + 1}", "solvent")]
    weights = [(f"c{i}", 100.0) for i in range(depth + 1)] + [("solvent", 10.0)]
    frames = lambda inputs: (
        spark.createDataFrame(steps, "route string, step string, product string, yield_percent double"), spark.createDataFrame(inputs, "step string, compound string, stoichiometry double"),
        spark.createDataFrame([("r", "c0", 1.0)], "route string, compound string, mass_g double"), spark.createDataFrame(weights, "compound string, mw double"),
    )
    want = {f"c{depth}": 2.0**depth, "solvent": sum(0.1 * 2.0**i for i in range(1, depth + 1))}
    assert {r.compound: pytest.approx(r.mass_g) for r in costing.leaf_requirements(*frames(inputs)).collect()} == want
    if depth == 12:
        with pytest.raises(ValueError):
            costing.leaf_requirements(*frames([*inputs, (f"s{depth - 1}", "c3", 1.0)]))


def test_routes_of_six_steps_with_exclusions(spark):
    made = [(f"R{i}", f"c{i}", 0.5) for i in range(6)] + [("Q", "c0", 0.25), ("H", "c0", 0.25), ("D", "c0", 0.125)]
    used = [(f"R{i}", f"c{i + 1}") for i in range(6)] + [("R0", "s"), ("Q", "bad"), ("Q", "s"), ("H", "s"), ("D", "s"), ("D", "c6")]
    reactions = spark.createDataFrame(made, "reaction string, product string, confidence double")
    inputs = spark.createDataFrame(used, "reaction string, compound string")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "compound string")
    run = lambda **k: {(r.path, r.n_routes) for r in routes.enumerate_routes(reactions, inputs, names("c6", "s", "bad"), names("c0"), **k).collect()}
    deep = "R5>R4>R3>R2>R1>R0"
    assert run() == {(p, 4) for p in (deep, "Q", "H", "D")}
    assert {n for _, n in run(top=1)} == {4} and len(run(top=1)) == 1
    toxic = spark.createDataFrame([("H", "fumes")], "reaction string, compound string")
    assert run(excluded=names("bad", "c3"), hazardous=names("fumes"), participants=toxic) == {("D", 1)}
    assert run(excluded=names("c0")) == set()
