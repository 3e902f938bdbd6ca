"""How complete the evidence of each entity is, and integrity checks over the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of coverage, lowest first, fixed values. The last that holds is the status.
LADDER = ("identified", "patents_found", "examples_extracted", "routes_under_review", "complete_reviewed_route", "price_complete", "cost_comparison_ready")


def refresh(entities: DataFrame, key: str, candidates: DataFrame, evidence: DataFrame, routes: DataFrame, prices: DataFrame, overrides: DataFrame) -> DataFrame:
    """Counts, flags and status per entity.

    candidates (key, publication, status), evidence (publication, span, status),
    routes (key, route, status), prices (key, priced, coverage) and overrides
    (key).  Four aggregations, each joined to the entities by key.
    """
    live = candidates.filter(F.col("status") != "rejected")
    patents = live.groupBy(key).agg(F.countDistinct("publication").alias("patent_count"))
    # evidence is credited to every candidate of its publication, whatever the candidate's own status
    spans = candidates.select(key, "publication").distinct().join(evidence.filter(F.col("status") != "rejected").select("publication", "span"), "publication")
    examples = spans.groupBy(key).agg(F.countDistinct("span").alias("example_count"))
    is_ = lambda *s: F.when(F.col("status").isin(*s), F.col("route"))
    reviewed = routes.groupBy(key).agg(F.countDistinct(is_("accepted")).alias("reviewed_count"), F.countDistinct(is_("needs_review", "unreviewed")).alias("review_count"))
    priced = prices.groupBy(key).agg(F.countDistinct("priced").alias("priced_count"), F.max("coverage").alias("max_coverage"))
    out = entities.select(key)
    for part in (patents, examples, reviewed, priced):
        out = out.join(part, key, "left")
    out = out.join(overrides.select(key, F.lit(1).alias("unavailable")).distinct(), key, "left").na.fill(0)
    flags = {
        "identified": F.lit(True),
        "patents_found": F.col("patent_count") > 0,
        "examples_extracted": F.col("example_count") > 0,
        "routes_under_review": F.col("review_count") > 0,
        "complete_reviewed_route": F.col("reviewed_count") > 0,
        "price_complete": (F.col("reviewed_count") > 0) & (F.col("max_coverage") >= 0.8),
        "cost_comparison_ready": (F.col("reviewed_count") > 0) & (F.col("priced_count") >= 2),
    }
    out = out.withColumns({k: v.cast("int") for k, v in flags.items()})
    return out.withColumn("status", F.when(F.col("unavailable") == 1, "public_evidence_unavailable").otherwise(ladder()))


def ladder() -> Column:
    return F.coalesce(*[F.when(F.col(s) == 1, s) for s in reversed(LADDER)])


def summary(coverage: DataFrame) -> DataFrame:
    """Entities per status, and the sums of the flags over all of them."""
    return coverage.groupBy("status").agg(F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(s) for s in LADDER])


def check(name: str, severity: str, affected: DataFrame) -> DataFrame:
    """One row: pass if nothing is affected."""
    n = F.count(F.lit(1))
    return affected.agg(n.alias("affected_count")).select(F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), "affected_count", F.when(F.col("affected_count") == 0, "pass").otherwise("fail").alias("status"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def leaking_groups(members: DataFrame, group: str, split: str) -> DataFrame:
    """Groups whose members are in more than one split."""
    return members.groupBy(group).agg(F.countDistinct(split).alias("n")).filter("n > 1")


def reconcile(rows: DataFrame, outcome: str, strict: bool = False) -> DataFrame:
    """One row: input, accepted, excluded and rejected rows, and whether they add up; with ``strict`` it is an error if they do not."""
    n = lambda v: F.count(F.when(F.col(outcome) == v, 1))
    counts = rows.agg(F.count(F.lit(1)).alias("input_rows"), n("accepted").alias("accepted_rows"), n("excluded").alias("excluded_rows"), n("rejected").alias("rejected_rows"))
    balanced = F.col("input_rows") == F.col("accepted_rows") + F.col("excluded_rows") + F.col("rejected_rows")
    if strict:
        balanced = F.when(balanced, True).otherwise(F.raise_error(F.lit("rows do not add up")).cast("boolean"))
    return counts.withColumn("balanced", balanced)


def histogram(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows), a row for each table."""
    return reduce(DataFrame.unionByName, [t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, t in tables.items()])


def batch_report(examples: DataFrame, issues: DataFrame) -> DataFrame:
    """One row for a batch: examples, valid ones, issues (a repeated id is one for each row after the first) and distinct ids that occur more than once."""
    bad = issues.groupBy("example_id").agg(F.count(F.lit(1)).alias("n_issues"))
    ids = examples.groupBy("example_id").agg(F.count(F.lit(1)).alias("n")).join(bad, "example_id", "left").na.fill(0, ["n_issues"])
    return ids.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("examples"),
        F.count(F.when((F.col("n_issues") == 0) & (F.col("n") == 1), 1)).alias("valid"),
        F.coalesce(F.sum(F.col("n_issues") + F.col("n") - 1), F.lit(0)).alias("issues"),
        F.count(F.when(F.col("n") > 1, 1)).alias("duplicate_ids"),
    )


def annotation_accounting(rows: DataFrame, structure: str, valid: Column) -> DataFrame:
    """One row: compounds, those annotated, without and with an invalid structure; an error if they do not add up."""
    s = F.nullif(F.col(structure), F.lit(""))
    counts = rows.agg(F.count(F.lit(1)).alias("input"), F.count(F.when(s.isNotNull() & valid, 1)).alias("annotated"), F.count(F.when(s.isNull(), 1)).alias("missing_structure"), F.count(F.when(s.isNotNull() & ~F.coalesce(valid, F.lit(False)), 1)).alias("invalid_structure"))
    whole = F.col("input") == F.col("annotated") + F.col("missing_structure") + F.col("invalid_structure")
    return counts.filter(F.when(whole, True).otherwise(F.raise_error(F.lit("compounds do not add up")).cast("boolean")))
