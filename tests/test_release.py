"""Releases seen at once, and route requests from search to look-up."""

import math

import pytest

from attesta.operators import release, routes


def test_a_fault_in_the_third_table_leaves_the_old_release(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = lambda *n: spark.createDataFrame([(i,) for i in n], "i int")
    assert release.versions(spark, root) == []
    with pytest.raises(ValueError, match="no release"):
        release.read(spark, root, "a")
    assert release.publish(spark, root, {"a": rows(1), "b": rows(2), "c": rows(3)}) == 1
    bad = lambda t: {"c has 9": t["c"].filter("i = 9")}
    with pytest.raises(ValueError, match="c has 9"):
        release.publish(spark, root, {"a": rows(7), "b": rows(8), "c": rows(9)}, bad)
    assert release.versions(spark, root) == [1] and [release.read(spark, root, t).first().i for t in "abc"] == [1, 2, 3]
    # a table may come from its own last release; others stay
    assert release.publish(spark, root, {"a": release.read(spark, root, "a").unionByName(rows(4))}, lambda t: {}) == 2
    assert sorted(r.i for r in release.read(spark, root, "a").collect()) == [1, 4] and release.read(spark, root, "c").first().i == 3
    assert [r.i for r in release.read(spark, root, "a", 1).collect()] == [1]
    with pytest.raises(ValueError, match="no table"):
        release.read(spark, root, "z")
    (tmp_path / "store" / "manifests" / "000000003").mkdir()  # a manifest that was not finished is none
    assert release.versions(spark, root) == [1, 2]


@pytest.fixture
def network(spark):
    f = spark.createDataFrame
    return {
        "reactions": f([("A", "T", 0.95, 80.0, "US-1-A1", False, 500.0), ("B", "T", 0.9, 90.0, None, True, None), ("X", "I", 0.8, 50.0, "US-2-A1", False, 100.0), ("C", "T", 0.5, 0.0, "US-3-A1", False, 10.0)], "reaction string, product string, confidence double, yield_percent double, publication string, is_synthetic boolean, scale_g double"),
        "inputs": f([("A", "I", 1.0), ("A", "s", 2.0), ("B", "s", 1.0), ("X", "s", 1.0), ("C", "s", 1.0)], "reaction string, compound string, stoichiometry double"),
        "starting": f([("s",), ("bought",)], "compound string"), "weights": f([("T", 200.0), ("I", 100.0), ("s", 50.0)], "compound string, mw double"),
        "quotes": f([("s", "q1", 1.0, "kg", 40.0, "USD", "accepted"), ("s", "q2", 100.0, "g", 1.0, "EUR", "accepted"), ("bought", "q3", 10.0, "g", 5.0, "USD", "accepted")], "compound string, quote_id string, pack_value double, pack_unit string, price double, currency string, status string"),
        "rates": f([("2024-01-01", "EUR", "USD", 1.25)], "rate_date string, base string, quote string, rate double"),
        "participants": f([("A", "T"), ("A", "I"), ("A", "s"), ("B", "T"), ("B", "s"), ("X", "I"), ("X", "s"), ("C", "T"), ("C", "s")], "reaction string, compound string"),
        "hazards": f([("s", 0.4, "accepted"), ("I", 0.2, "accepted"), ("T", 0.9, "rejected")], "compound string, severity double, status string"),
    }


def test_a_request_from_search_to_look_up(spark, network, tmp_path):
    target = spark.createDataFrame([("T", 1000.0), ("bought", 25.0), ("nothing", 1.0)], "compound string, mass_g double")
    out = routes.request(network, target, "USD", "2024-05-01")
    assert [r.compound for r in out["gap"].collect()] == ["nothing"]
    candidates = {r.path: r for r in out["route_candidate"].collect()}
    assert set(candidates) == {"B", "C", "X>A", ""}
    score = {r.route: r for r in out["route_evaluation"].collect()}
    # by hand: 1000 g of T are 5 mol, through A 6.25 mol of I and 12.5 of s, through X 12.5 mol of s more: 1250 g of s in 13 packs of 100 g
    a = score[candidates["X>A"].route]
    assert (a.coverage, float(a.actual_cost), a.tier) == (1.0, 13 * 1.25, "cost_complete")
    severity = (0.2 + 0.4 + 0.2 + 0.4) / 4
    assert a.feasibility_score == pytest.approx(100 * (0.25 * 0.4 + 0.15 * (1 - 2 / 12) + 0.2 * (1 - severity) + 0.15 + 0.15 * 0.5 + 0.1))
    b = score[candidates["B"].route]
    assert float(b.actual_cost) == math.ceil(1000 / 200 / 0.9 * 50 / 100) * 1.25
    assert score[candidates["C"].route].tier == "cost_incomplete" and {(r.route, r.step, r.reason) for r in out["route_warning"].collect()} == {(candidates["C"].route, "C", "missing molecular weight or yield")}
    none = score[candidates[""].route]
    assert float(none.actual_cost) == 15.0 and none.feasibility_score == pytest.approx(100 * (0.25 + 0.15 + 0.2 + 0.15))
    assert {score[candidates[p].route].rank for p in ("B", "C", "X>A")} == {1, 2, 3} and score[candidates["C"].route].rank == 3

    root = str(tmp_path / "routes")
    assert routes.store(spark, root, out) == 1
    found = routes.stored(spark, root, candidates["X>A"].route).first()
    assert (found.path, found.rank, [s.reaction for s in found.steps]) == ("X>A", 1, ["X", "A"])
    both = routes.stored(spark, root, candidates["C"].route, candidates["B"].route).collect()
    assert {r.path: r.rank for r in both} == {"B": 1, "C": 2}
    with pytest.raises(ValueError, match="no stored route route-none"):
        routes.stored(spark, root, "route-none", candidates["B"].route)
    # the same request again replaces its routes, another mass adds its own
    more = routes.request(network, spark.createDataFrame([("T", 10.0)], "compound string, mass_g double"), "USD", "2024-05-01")
    assert routes.store(spark, root, out) == 2 and routes.store(spark, root, more) == 3
    assert release.read(spark, root, "route_candidate").count() == 4 + 3
