"""Work that grows with the rows and not with pairs of them."""

import hashlib
import re

from pyspark.sql import functions as F

from attesta.operators import curation, graph, matching
from attesta.plans import registry

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_pair_of_candidates_is_joined_again(spark):
    for name in ("candidate_match_all_seeds", "candidate_match_or_join"):
        p = plan(registry.QUERIES[name](spark, DATA))
        assert p.index("Union") < p.index("Join")


def test_pairs_are_made_by_the_last_step_alone(spark, monkeypatch):
    names = ("candidate_match_all_seeds", "candidate_match_or_join")
    for p in (plan(registry.QUERIES[n](spark, DATA)) for n in names):
        assert "Generate explode" in p[: p.index("Union")]
        # as many tasks as the session names, whatever the bytes
        assert {int(x) for x in re.findall(r"RepartitionByExpression .*, (\d+)", p)} == {4}
    monkeypatch.setattr(matching, "LISTED", 3, raising=False)
    one = spark.range(64).select(F.concat(F.lit("k"), F.col("id") % 16).alias("k"), F.lit("c").alias("c"), "id")
    got = matching.match_either(one, one.repartition(2), "k", "c").withColumn("task", F.spark_partition_id()).collect()
    assert len({(r.id, r.s_id) for r in got}) == len(got) == 64 * 64 and sum(r.match_type == "exact_structure" for r in got) == 16 * 4 * 4
    # rows of one prefix are dealt
    assert len({r.task for r in got if r.match_type == "same_connectivity"}) > 1


def test_lists_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(matching, "LISTED", 2, raising=False)
    whole, start = ("a", "b", "", "x", None), ("p", "q", "", None)
    seeds = [(i if i % 7 else None, whole[i % 5], start[i % 4]) for i in range(60)] + [(5, "a", "p")] * 3
    snap = [(100 + i, whole[i % 5], start[i // 5 % 4]) for i in range(40)] + [(100, "a", "p"), (None, "b", None)]
    kind = lambda k, c, k2, c2: "exact_structure" if k is not None and k == k2 else "same_connectivity" if c is not None and c == c2 else None
    want = sorted(str((i, j, kind(k, c, k2, c2))) for i, k, c in seeds for j, k2, c2 in snap if kind(k, c, k2, c2))
    a, b = spark.createDataFrame(seeds, "id long, k string, c string"), spark.createDataFrame(snap, "sid long, k string, c string")
    every = spark.createDataFrame([(k, c) for k in (*whole, "unknown") for c in start], "k string, c string")
    for df in (matching.match_either(a, b, "k", "c"), matching.match_either(a, b, "k", "c", every)):
        assert sorted(str((r.id, r.s_sid, r.match_type)) for r in df.collect()) == want
    two = matching.match_either(a.withColumn("twice", F.col("id") * 2), b, "k", "c").collect()
    assert sorted(str((r.id, r.s_sid, r.match_type)) for r in two) == want and all(r.twice == (r.id and r.id * 2) for r in two)


def test_pairs_are_counted_without_the_pairs(spark):
    rows = [(i, "A" if i % 3 else None, "p") for i in range(20000)] + [(1, "A", "p"), (-1, "B", None), (-2, None, None), (-3, "C", "q"), (None, "C", "r")]
    part = spark.createDataFrame(rows, "id long, k string, c string")
    got = {r.match_type: tuple(r)[1:] for r in matching.match_counts(part, part, "k", "c", "id", "id").collect()}
    k, none = 13334, 6667  # rows of A and of no key under p
    assert got == {"exact_structure": (k * k + 1 + 4, 13333 + 2, 13333 + 2), "same_connectivity": (2 * k * none + none * none, 20000, 20000)}
    few = spark.createDataFrame([(7, "A", "p"), (8, "B", "z")], "id long, k string, c string")
    got = {r.match_type: tuple(r)[1:] for r in matching.match_counts(few, part, "k", "c", "id", "id").collect()}
    assert got == {"exact_structure": (k + 1, 2, 13334), "same_connectivity": (none, 1, none)}


def test_owners_are_counted_exactly(spark):
    ids = [(1, "a", 1), (1, "a", 1), (1, "a", 2), (2, "b", 1), (3, "a", 2), (3, "c", 1), (4, "d", 9), (5, "c", 2), (5, None, 1), (None, "a", 1)]
    own = [*((f"x{i}", "a", 1) for i in range(3000)), *((f"y{i}", ns, v) for i in range(500) for ns, v in (("a", 1), ("a", 2), ("c", 1))), ("z", "b", 1), ("z", "a", 2), ("y0", "a", 1), (None, "b", 1), ("w", "c", 2), ("v", "c", 2), ("w", None, 1)]
    got = matching.identity_conflicts(spark.createDataFrame(ids, "r long, ns string, v long"), "r", ["ns", "v"], spark.createDataFrame(own, "o string, ns string, v long"), "o")
    want = {}
    for r, *k in ids:
        want.setdefault(r, set()).update(o for o, *k2 in own if o and None not in k and k == k2)
    assert {x.r: (x.n_owners, x.least_owner, x.greatest_owner) for x in got.collect()} == {r: (len(o), min(o), max(o)) for r, o in want.items() if len(o) > 1}
    assert "n_owners" in registry.QUERIES["identity_conflicts"](spark, DATA).columns


def test_requests_of_one_text_are_looked_up_once(spark, monkeypatch):
    names = [("c1", "Alpha Beta"), ("c2", "alpha"), ("c3", "beta x"), ("C4", None), ("c5", "beta y")]
    compounds = spark.createDataFrame([(i, n, "CC" if i == "c3" else None) for i, n in names], "compound_id string, preferred_name string, standardized_smiles string")
    aliases = spark.createDataFrame([("d1", "common"), ("d2", "common"), ("d3", "common")], "drug_id string, normalized_alias string")
    links = spark.createDataFrame([("d1", "c1", "salt"), ("d2", "c2", "active_moiety"), ("d3", "gone", "active_moiety")], "drug_id string, compound_id string, relationship_type string")
    made = spark.createDataFrame([("c2", "accepted"), ("c2", "accepted"), ("c2", "rejected")], "compound_id string, review_status string")
    texts = ["common", "ALPHA ", "c4", "eta", "beta", "a b", "b", "zz", " ", None]
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 50)], "request long, text string")
    want = [(2, "c2"), (1, "c2"), (1, "C4"), (3, "c3"), (3, "c3"), (3, "c1"), (3, "c3"), (None, None), (None, None), (None, None)] * 50
    for page in (1000, 2):  # few open texts, and more than a page of them
        monkeypatch.setattr(matching, "PAGE", page)
        df = matching.resolve(asked, compounds, aliases, links, made)
        got = df.collect()
        assert [(r.stage, r.compound_id) for r in sorted(got)] == want
        assert {r.reviewed_producing_reactions for r in got} == {2, 0, None}
        assert ("BroadcastExchange" in df._jdf.queryExecution().executedPlan().toString()) == (page == 1000)


def test_only_values_that_examples_share_are_linked(spark, monkeypatch):
    rows = [(f"a{i}", f"f{i // 8}", f"m{i // 32}" if i % 8 == 0 and i % 24 else None) for i in range(400)] + [("x", None, None), ("y", "f1", None), ("y", "g", None), ("z", "g", "m9"), (None, "f1", "g")]
    links, plain = [], graph.components
    monkeypatch.setattr(graph, "components", lambda e, a, b: links.append(e.count()) or plain(e, a, b))
    got = curation.assign_splits(spark.createDataFrame(rows, "id string, f string, m string"), "id", ["f", "m"], "s").collect()
    group = {}
    for i, *values in rows:
        for v in [("id", i), *((k, v) for k, v in enumerate(values) if v)] if i else []:
            a, b = (group.setdefault(x, {x}) for x in (("id", i), v))
            if a is not b:
                a |= b
                group.update({x: a for x in b})
    ids = {i for i, *_ in rows if i}
    own = {i: frozenset(x for k, x in group[("id", i)] if k == "id") for i in ids}
    name = {i: "component:" + hashlib.sha256("|".join(sorted(own[i])).encode()).hexdigest()[:24] for i in ids}
    assert sorted((r.id, r.leakage_group) for r in got) == sorted(name.items())
    assert links == [sum(1 for _, f, m in rows[:400] if m) + 2]  # no link for an example of one value


def test_a_walk_reads_only_edges_of_kinds_it_has_met(spark):
    f = lambda rows: spark.createDataFrame(rows, "a string, b string")
    unread = f([("1", "2")]).select(F.raise_error(F.lit("read")).cast("string").alias("a"), "b")
    parts = graph.edges_by_kind((f([("1", "1"), ("1", "2"), ("3", "2"), (None, "2")]), "x", "a", "y", "b", "e"), (f([("2", "9"), ("7", "8"), ("9", "9")]), "y", "a", "y", "b", "f"), (unread, "z", "a", "w", "b", "g"))
    node = spark.createDataFrame([(i, i.upper()) for i in ("x:1", "x:3", "y:2", "y:9")], "node_id string, label string")
    start = spark.createDataFrame([("x:1",), (None,)], "node_id string")
    got = lambda edge, depth: sorted(map(tuple, graph.traverse(edge, node, start, depth).na.fill("-").collect()))
    one = [("x:1", "y:1", "e", "x:1", 1, "X:1", "-"), ("x:1", "y:2", "e", "x:1", 1, "X:1", "Y:2")]
    two = [("-", "y:2", "e", "y:2", 2, "-", "Y:2"), ("x:1", "y:1", "e", "y:1", 2, "X:1", "-"), ("x:1", "y:2", "e", "y:2", 2, "X:1", "Y:2"), ("x:3", "y:2", "e", "y:2", 2, "X:3", "Y:2"), ("y:2", "y:9", "f", "y:2", 2, "Y:2", "Y:9")]
    three = [("x:3", "y:2", "e", "x:3", 3, "X:3", "Y:2"), ("y:2", "y:9", "f", "y:9", 3, "Y:2", "Y:9"), ("y:9", "y:9", "f", "y:9", 3, "Y:9", "Y:9")]
    assert got(parts, 1) == one and got(parts, 3) == sorted(one + two + three)
    assert got(parts[0][2].unionByName(parts[1][2]), 3) == sorted(one + two + three)
    assert got(parts[2:], 2) == []


def test_distinct_links_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(graph, "DISTINCT_ROWS", 100, raising=False)
    df = registry.QUERIES["graph_kinds"](spark, DATA)
    dealt = [int(x) for x in re.findall(r"RepartitionByExpression .*, (\d+)", plan(df))]
    assert len(dealt) == 3 and all(n >= 10 for n in dealt) and max(dealt) >= 60  # about 6,000 lines in parts of 100


def test_files_are_digested_in_pieces(spark):
    before = {tuple(r) for r in registry.QUERIES["manifest_listing"](spark, DATA).collect()}
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)  # a cell of Spark ends at 2 GB
    try:
        assert {tuple(r) for r in registry.QUERIES["manifest_listing"](spark, DATA).collect()} == before
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
