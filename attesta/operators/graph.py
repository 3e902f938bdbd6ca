"""Nodes and edges of the evidence graph and walks over them."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions.session import few, shared_folder, written

#: Rows that a task holds the distinct ones of.
DISTINCT_ROWS = 500_000


def node_id(kind: str, col: str):
    """``kind:id``; an id that has the prefix keeps it."""
    c = F.col(col).cast("string")
    return F.when(c.startswith(f"{kind}:"), c).otherwise(F.concat(F.lit(f"{kind}:"), c))


def nodes(*parts: tuple[DataFrame, str, str, str]) -> DataFrame:
    """Union of (table, kind, id column, label column) as node_id, node_type, label, record_id."""
    return reduce(DataFrame.unionByName, [t.select(node_id(k, i).alias("node_id"), F.lit(k).alias("node_type"), F.col(n).cast("string").alias("label"), F.col(i).cast("string").alias("record_id")) for t, k, i, n in parts])


def edges(*parts: tuple[DataFrame, str, str, str, str, str]) -> DataFrame:
    """Union of (table, source kind, source column, target kind, target column, edge type)."""
    return reduce(DataFrame.unionByName, [t.select(node_id(a, x).alias("source_id"), node_id(b, y).alias("target_id"), F.lit(e).alias("edge_type")) for t, a, x, b, y, e in parts])


def edges_by_kind(*parts: tuple[DataFrame, str, str, str, str, str]) -> list[tuple[str, str, DataFrame]]:
    """The tables of ``edges`` one by one, each with the kinds of its sources and targets."""
    return [(p[1], p[3], edges(p)) for p in parts]


def distinct_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Distinct rows, dealt by the keys to as many tasks as their number asks for: what a task holds does not grow with the table."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // DISTINCT_ROWS))
    return rows.repartition(n, *keys).distinct()


def neighbours(edge: DataFrame, node: str, direction: str = "both", limit: int = 100) -> DataFrame:
    """Edges of a node in order, ``limit`` at most (a page of the report), and whether there are more."""
    out, into = F.col("source_id") == node, F.col("target_id") == node
    own = edge.filter({"out": out, "in": into}.get(direction, out | into))
    page = own.orderBy("edge_type", "source_id", "target_id").limit(limit + 1)
    w = W.orderBy("edge_type", "source_id", "target_id")
    return page.withColumn("rn", F.row_number().over(w)).withColumn("truncated", F.max("rn").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) > limit).filter(F.col("rn") <= limit).drop("rn")


def backtrack(edge: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node_id, level): nodes from which the start nodes are reached along edges, with the fewest steps, ``depth`` at most.

    A step joins the newest level alone with the edges and drops nodes seen
    before; levels are written out, so the plan does not grow with the depth.
    """
    shared_folder(edge.sparkSession)
    seen = start.select("node_id").distinct().withColumn("level", F.lit(0))
    new = seen
    for level in range(1, depth + 1):
        step = edge.join(new.select(F.col("node_id").alias("target_id")), "target_id").select(F.col("source_id").alias("node_id")).distinct()
        new = step.join(seen.select("node_id"), "node_id", "left_anti").withColumn("level", F.lit(level)).checkpoint()
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen


def _among(rows: DataFrame, col: str, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select(F.col("node_id").alias(col)), col, "left_semi")


def traverse(edge: DataFrame | list[tuple[str, str, DataFrame]], node: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Edges met on a walk from the start nodes in both directions: (source_id, target_id, edge_type, traversed_from, level) with the labels of both ends.

    A node is expanded once, at the fewest steps from a start; an edge between
    two expanded nodes is met from each of them.  Every level filters the edges
    for its nodes, which Spark does where the tables are read, and writes out
    what it meets; nothing is made of the other edges.  Edges may be given by
    the kinds of their ends (``edges_by_kind``): those whose kinds a level has
    no node of are not read for it.  Labels are looked up for nodes that are met.
    """
    parts = edge if isinstance(edge, list) else [(None, None, edge)]
    kinds = sorted({k for a, b, _ in parts for k in (a, b) if k})
    new = seen = written(start.select("node_id").filter("node_id is not null").distinct())
    levels = []
    for level in range(1, depth + 1):
        front = few(new)
        here = {r.kind for r in new.select(F.substring_index("node_id", ":", 1).alias("kind")).filter(F.col("kind").isin(kinds)).distinct().collect()} if kinds else set()
        met = []
        for a, b, e in parts:
            e = e.select("source_id", "target_id", "edge_type")
            if a is None or a in here:
                met.append(_among(e, "source_id", front).withColumn("traversed_from", F.col("source_id")))
            if b is None or b in here:
                met.append(_among(e.filter("not (source_id <=> target_id)"), "target_id", front).withColumn("traversed_from", F.col("target_id")))
        met = met or [parts[0][2].filter("false").withColumn("traversed_from", F.col("source_id"))]
        levels.append(written(reduce(DataFrame.unionByName, [m.select("source_id", "target_id", "edge_type", "traversed_from") for m in met]).withColumn("level", F.lit(level))))
        if level == depth:
            break
        other = F.when(F.col("traversed_from") == F.col("source_id"), F.col("target_id")).otherwise(F.col("source_id"))
        new = written(levels[-1].select(other.alias("node_id")).filter("node_id is not null").distinct().join(few(seen), "node_id", "left_anti"))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    met = reduce(DataFrame.unionByName, levels)
    ends = few(written(met.select(F.col("source_id").alias("node_id")).unionByName(met.select(F.col("target_id").alias("node_id"))).distinct()))
    named = few(written(_among(node, "node_id", ends).select("node_id", "label")))
    for end in ("source", "target"):
        met = met.join(named.select(F.col("node_id").alias(f"{end}_id"), F.col("label").alias(f"{end}_label")), f"{end}_id", "left")
    return met.select("source_id", "target_id", "edge_type", "traversed_from", "level", "source_label", "target_label")


def evidence_backtrack(targets: DataFrame, produced: DataFrame, inputs: DataFrame, evidence: DataFrame, compounds: DataFrame, depth: int, elements: DataFrame | None = None) -> dict[str, DataFrame]:
    """How each drug's compounds are made, back to ``depth`` reactions: levels, edges and gaps, for all drugs at once.

    targets (drug, compound), produced (reaction, compound), inputs (reaction,
    compound, role), evidence (reaction, publication, relationship), compounds
    (compound, has_structure).  levels has each (drug, compound) with the
    fewest steps to it; edges are (drug, source_id, target_id, edge_type) of the
    reactions expanded, their inputs and publications, and, with elements
    (compound, element_id), of the elements of all compounds; gaps are compounds
    without a record or a structure, and those above the depth that nothing
    recorded makes.
    """
    shared_folder(targets.sparkSession)
    seen = targets.select("drug", "compound").distinct().withColumn("level", F.lit(0)).checkpoint()
    new = seen
    for level in range(1, depth + 1):
        down = new.join(produced, "compound").select("drug", "reaction").distinct().join(inputs, "reaction").select("drug", "compound").distinct()
        new = down.join(seen, ["drug", "compound"], "left_anti").withColumn("level", F.lit(level)).checkpoint()
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    open_ = seen.filter(F.col("level") < depth)
    record = seen.join(compounds.select("compound", "has_structure", F.lit(True).alias("there")), "compound", "left")
    made = open_.join(produced, "compound")
    name = lambda kind, col: F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))
    edge = lambda d, a, b, t: d.select("drug", a.alias("source_id"), b.alias("target_id"), t.alias("edge_type")).distinct()
    used = made.select("drug", "reaction").distinct()
    edges = (
        edge(targets, name("drug", "drug"), name("compound", "compound"), F.lit("active_moiety"))
        .unionByName(edge(made, name("reaction", "reaction"), name("compound", "compound"), F.lit("produced")))
        .unionByName(edge(used.join(inputs, "reaction"), name("compound", "compound"), name("reaction", "reaction"), F.col("role")))
        .unionByName(edge(used.join(evidence, "reaction"), name("patent", "publication"), name("reaction", "reaction"), F.col("relationship")))
    )
    if elements is not None:
        edges = edges.unionByName(edge(seen.join(elements, "compound"), name("compound", "compound"), name("element", "element_id"), F.lit("contains_element")))
    gap = lambda d, why: d.select("drug", "compound", F.lit(why).alias("reason"))
    gaps = (
        gap(record.filter("there is null"), "missing_compound_record")
        .unionByName(gap(record.filter("there and not has_structure"), "structure_or_atom_counts_unavailable"))
        .unionByName(gap(record.filter("there").filter(F.col("level") < depth).join(produced.select("compound"), "compound", "left_anti"), "no_evidence_backed_producing_reaction"))
    )
    return {"levels": seen, "edges": edges, "gaps": gaps}


def group_names(label: DataFrame, node: str, component: str) -> DataFrame:
    """(node, leakage_group): components named by a hash of their sorted members joined by ``|``, so that the name does not depend on the walk.

    The digest runs over the sorted members as they come by; no component is
    held as a whole.
    """
    spark, key = label.sparkSession, T.StructField("key", T.StringType())

    def run(batches):
        own, digest = None, None
        name = lambda: f"component:{digest.hexdigest()[:24]}"
        for batch in batches:
            keys, nodes, done = batch.column(0), batch.column(1).to_pylist(), []
            ends = [*(np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), len(keys)]
            start = 0
            for end in ends if len(keys) else []:
                if (found := keys[start].as_py()) != own:
                    if digest:
                        done.append((own, name()))
                    own, digest = found, hashlib.sha256()
                    digest.update("|".join(nodes[start:end]).encode())
                else:
                    digest.update(("|" + "|".join(nodes[start:end])).encode())
                start = end
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], names=["key", "leakage_group"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (own, name())], names=["key", "leakage_group"])

    text = lambda c: F.col(c).cast("string")
    members = label.select(text(component).alias("key"), text(node).alias("member")).filter("key is not null and member is not null").distinct()
    ordered = members.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key", "member")
    named = ordered.mapInArrow(run, T.StructType([key, T.StructField("leakage_group", T.StringType())]))
    return label.join(named, text(component) == named["key"]).select(node, "leakage_group")


def components(edge: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, by labels that spread and jump.

    Every round a node takes the least label among its neighbours', then the
    label of its label; rounds grow with the logarithm of a component's width.
    """
    shared_folder(edge.sparkSession)
    both = edge.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edge.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct().checkpoint()
    label = both.select(F.col("x").alias("node")).distinct().withColumn("component", F.col("node")).checkpoint()
    while True:
        near = both.join(label.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("m"))
        spread = label.join(near, "node").select("node", F.least("component", "m").alias("component"))
        # what a label's own node has found, and the least that any member of a label has found
        best = spread.join(label.withColumnRenamed("component", "old"), "node").groupBy("old").agg(F.min("component").alias("n"))
        joined = spread.join(label.withColumnRenamed("component", "old"), "node").join(best, "old").select("node", F.least("component", "n").alias("component"))
        jump = joined.select(F.col("node").alias("component"), F.col("component").alias("j"))
        after = joined.join(jump, "component", "left").select("node", F.least("component", F.coalesce("j", "component")).alias("component")).checkpoint()
        moved = after.join(label.withColumnRenamed("component", "old"), "node").filter("component <> old").limit(1).count()
        label = after
        if not moved:
            return label
