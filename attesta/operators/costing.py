"""Routes to a product: mass balance, price, score and rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions.scalars import grams
from attesta.functions.session import shared_folder


def cheapest_quotes(quotes: DataFrame, key: str) -> DataFrame:
    """Of quotes (key, quote_id, pack_g, price, rate, need_g): the cheapest by whole packs for each key.

    packs = need / pack rounded up; ties go to the smaller quote id.  A pack
    without a mass is no offer.
    """
    packs = F.ceil(F.col("need_g") / F.col("pack_g"))
    package = F.round((packs * F.col("price") * F.col("rate")).cast("decimal(20,6)"), 4)
    continuous = F.round((F.col("need_g") / F.col("pack_g") * F.col("price") * F.col("rate")).cast("decimal(20,6)"), 4)
    q = quotes.filter("pack_g > 0").withColumns({"packs": packs, "package_cost": package, "continuous_cost": continuous})
    best = q.groupBy(key).agg(F.min_by(F.struct("quote_id", "packs", "package_cost", "continuous_cost"), F.struct("package_cost", "quote_id")).alias("b"))
    return best.select(key, "b.*")


def leaf_requirements(steps: DataFrame, inputs: DataFrame, target: DataFrame, weights: DataFrame) -> DataFrame:
    """(route, compound, mass_g): the leaves of ``mass_balance``."""
    return mass_balance(steps, inputs, target, weights)[0]


def mass_balance(steps: DataFrame, inputs: DataFrame, target: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each route needs of its starting materials (route, compound, mass_g), and warnings (route, step, compound, reason) about what it cannot tell.

    steps (route, step, product, yield_percent), inputs (step, compound,
    stoichiometry), target (route, compound, mass_g), weights (compound, mw).
    Masses go down the tree level by level to its leaves, however deep; a cycle
    raises ValueError.  Of several steps for a product the last counts.  A step
    whose product has no weight above 0 or which has no yield above 0 is left
    out with a warning (without a compound), as is an input without weight or
    stoichiometry; one for each time that they are met.
    """
    shared_folder(steps.sparkSession)
    last = steps.groupBy("route", "product").agg(F.max_by(F.struct("step", "yield_percent"), F.col("step")).alias("s")).select("route", F.col("product").alias("compound"), "s.*")
    mw = weights.filter("mw > 0").select("compound", "mw")
    warn = lambda d, compound, reason: d.select("route", "step", compound.alias("compound"), F.lit(reason).alias("reason"))
    need = target.select("route", "compound", "mass_g").checkpoint()
    leaves, warnings = need.limit(0), None
    # a path without a cycle makes each product of its route once, and has a leaf below
    deepest = last.groupBy("route").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    for _ in range(deepest + 1):
        leaves = leaves.unionByName(need.join(last.select("route", "compound"), ["route", "compound"], "left_anti"))
        made = need.join(last, ["route", "compound"]).join(mw, "compound", "left").withColumn("ok", F.coalesce(F.col("mw").isNotNull() & (F.col("yield_percent") > 0), F.lit(False)))
        moles = F.col("mass_g") / F.col("mw") / (F.col("yield_percent") / 100)
        down = made.filter("ok").select("route", "step", moles.alias("moles")).join(inputs.select("step", "compound", "stoichiometry"), "step").join(mw, "compound", "left")
        down = down.withColumn("mass_g", F.when(F.col("stoichiometry") != 0, F.col("moles") * F.col("stoichiometry") * F.col("mw"))).checkpoint()
        told = warn(made.filter("not ok"), F.lit(None).cast("string"), "missing molecular weight or yield").unionByName(warn(down.filter("mass_g is null"), F.col("compound"), "missing molecular weight or stoichiometry"))
        warnings = told if warnings is None else warnings.unionByName(told)
        need = down.filter("mass_g is not null").select("route", "compound", "mass_g")
        if need.isEmpty():
            break
    else:
        raise ValueError("a route needs its own product to make it")
    return leaves.groupBy("route", "compound").agg(F.sum("mass_g").alias("mass_g")), warnings


def step_summary(steps: DataFrame, participants: DataFrame, hazards: DataFrame) -> DataFrame:
    """Per route what its steps say: n_steps, cumulative_yield, evidence_share, max_scale_g, severity.

    steps (route, reaction, yield_percent, publication, is_synthetic, scale_g),
    participants (reaction, compound), hazards (compound, severity, status).
    The yield is a product if every step has one, else 0.  The share of
    evidence counts steps with a publication that are not synthetic.  Severity
    is the average over accepted hazards of all participations, one that takes
    part in two reactions counting twice; 0 without any.
    """
    known = F.col("yield_percent") > 0
    complete = F.count(F.lit(1)) == F.count(F.when(known, 1))
    own = steps.groupBy("route").agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.when(complete, F.product(F.col("yield_percent") / 100)).otherwise(0.0).alias("cumulative_yield"),
        F.avg(F.when(F.col("publication").isNotNull() & ~F.coalesce("is_synthetic", F.lit(False)), 1.0).otherwise(0.0)).alias("evidence_share"),
        F.max("scale_g").alias("max_scale_g"),
    )
    # summed by reaction first: routes that share reactions do not repeat the join with the hazards
    burden = participants.join(hazards.filter("status = 'accepted'"), "compound").groupBy("reaction").agg(F.sum("severity").alias("s"), F.count("severity").alias("m"))
    severity = steps.select("route", "reaction").distinct().join(burden, "reaction").groupBy("route").agg((F.sum("s") / F.sum("m")).alias("severity"))
    return own.join(severity, "route", "left").withColumn("severity", F.coalesce("severity", F.lit(0.0)))


def convert_quotes(quotes: DataFrame, rates: DataFrame, currency: str, at: str) -> DataFrame:
    """Accepted quotes with ``pack_g`` and ``rate`` into one currency; quotes without a mass or a rate go.

    quotes (compound, quote_id, pack_value, pack_unit, price, currency,
    status), rates (rate_date, base, quote, rate): of each pair the last rate
    that is not after ``at`` counts.
    """
    last = rates.filter((F.col("quote") == currency) & (F.col("rate_date") <= F.lit(at).cast(rates.schema["rate_date"].dataType))).groupBy(F.col("base").alias("currency")).agg(F.max_by("rate", "rate_date").alias("fx"))
    ok = quotes.filter("status = 'accepted'").withColumn("pack_g", grams(F.col("pack_value"), F.col("pack_unit"))).filter("pack_g > 0")
    return ok.join(last, "currency", "left").withColumn("rate", F.when(F.col("currency") == currency, 1.0).otherwise(F.col("fx"))).filter("rate is not null").drop("fx")


def priced_requirements(needs: DataFrame, quotes: DataFrame) -> DataFrame:
    """Per route total_g, priced_g and cost of its leaf requirements (route, compound, mass_g) at the cheapest quotes (compound, quote_id, pack_g, price, rate)."""
    line = needs.join(quotes, "compound").withColumn("need_g", F.col("mass_g")).withColumn("line", F.struct("route", "compound"))
    best = cheapest_quotes(line, "line").select("line.*", "package_cost")
    return needs.join(best, ["route", "compound"], "left").groupBy("route").agg(F.sum("mass_g").alias("total_g"), F.coalesce(F.sum(F.when(F.col("package_cost").isNotNull(), F.col("mass_g"))), F.lit(0.0)).alias("priced_g"), F.sum("package_cost").cast("double").alias("cost"))


def evaluate(routes: DataFrame) -> DataFrame:
    """Indices and tier of routes with total_g, priced_g, target_g, cost, n_steps, cumulative_yield, evidence_share, max_scale_g, severity.

    A cost counts only where 0.8 of the mass has a price.  Weights are fixed values.
    """
    c = F.col
    coverage = F.coalesce(F.try_divide(c("priced_g"), c("total_g")), F.lit(0.0))
    intensity = F.coalesce(F.try_divide(c("total_g"), c("target_g")), F.lit(0.0))
    length = F.least(c("n_steps") / 12, F.lit(1.0))
    hazard = F.coalesce(c("severity"), F.lit(0.0)) * 100
    scale = F.least(F.lit(1.0), F.coalesce(F.try_divide(c("max_scale_g"), c("target_g")), F.lit(0.0)))
    relative = 100 * (0.30 * F.least(intensity / 5, F.lit(1.0)) + 0.25 * (1 - c("cumulative_yield")) + 0.15 * length + 0.10 * hazard / 100 + 0.05 * (1 - c("evidence_share")))
    feasible = 100 * (0.25 * c("cumulative_yield") + 0.15 * (1 - length) + 0.20 * (1 - hazard / 100) + 0.15 + 0.15 * scale + 0.10 * c("evidence_share"))
    out = routes.withColumns({"coverage": coverage, "relative_cost_index": relative, "feasibility_score": feasible})
    out = out.withColumn("actual_cost", F.when(c("coverage") >= 0.8, c("cost")))
    return out.withColumn("tier", F.when(c("actual_cost").isNotNull(), "cost_complete").otherwise("cost_incomplete"))


def rank_score(cost: Column, low: Column, high: Column, tier: Column, feasibility: Column) -> Column:
    """Half cost, half feasibility where the cost is complete; lower is better."""
    norm = F.when(high > low, 100 * (cost - low) / (high - low)).otherwise(F.lit(0.0))
    return F.when(tier == "cost_complete", 0.5 * norm + 0.5 * (100 - feasibility)).otherwise(100 - feasibility)


def rank(evaluated: DataFrame, group: list[str]) -> DataFrame:
    """Ranks within each target's routes (a request has ten at most, so a group is small)."""
    whole = W.partitionBy(*group)
    cost = F.when(F.col("tier") == "cost_complete", F.col("actual_cost"))
    score = rank_score(F.col("actual_cost"), F.min(cost).over(whole), F.max(cost).over(whole), F.col("tier"), F.col("feasibility_score"))
    out = evaluated.withColumn("rank_score", score)
    return out.withColumn("rank", F.row_number().over(whole.orderBy("tier", "rank_score", "route")))


def compare(pairs: DataFrame) -> DataFrame:
    """Verdict on a hypothesis against a baseline: pairs has hyp_ and base_ columns of the metrics, and ``checks`` (array of nullable booleans) and ``unsupported`` (steps without a precedent).

    A metric counts where both sides have it; differences below 1e-9 are none.
    """
    lower = ("step_count", "process_mass_intensity", "hazard_score", "material_cost_per_kg")
    delta = {m: F.round((F.col(f"base_{m}") - F.col(f"hyp_{m}")).cast("decimal(28,10)"), 8) for m in lower} | {"yield": F.round((F.col("hyp_yield") - F.col("base_yield")).cast("decimal(28,10)"), 8)}
    out = pairs.withColumns({f"delta_{m}": d for m, d in delta.items()})
    count = lambda test: sum((F.coalesce(test(F.col(f"delta_{m}")), F.lit(False)).cast("int") for m in delta), F.lit(0))
    out = out.withColumns({"n_deltas": count(lambda d: d.isNotNull()), "n_better": count(lambda d: d > 1e-9), "n_worse": count(lambda d: d < -1e-9)})
    gate = F.when(F.exists("checks", lambda x: x == F.lit(False)), "rejected").when(F.exists("checks", lambda x: x.isNull()) | (F.col("unsupported") > 0), "needs_validation").otherwise("eligible")
    verdict = (
        F.when(F.col("gate") != "eligible", "blocked_validation").when(F.col("n_deltas") == 0, "insufficient_data")
        .when((F.col("n_better") > 0) & (F.col("n_worse") == 0), "improved").when((F.col("n_worse") > 0) & (F.col("n_better") == 0), "not_improved").otherwise("mixed")
    )
    named = lambda test: F.array_sort(F.array_compact(F.array(*[F.when(test(F.col(f"delta_{m}")), F.lit("cumulative_yield" if m == "yield" else m)) for m in delta])))
    return out.withColumn("gate", gate).withColumns({"verdict": verdict, "improved_metrics": named(lambda d: d > 1e-9), "worsened_metrics": named(lambda d: d < -1e-9)})
