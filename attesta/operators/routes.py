"""Search for the best routes to wanted compounds, from the targets backwards.

A reaction makes its product out of all of its inputs, and a compound may have
many reactions: an AND/OR graph.  Only what the targets need is looked at.
Routes are then grown by size, the smallest first, and growth ends with the
size at which every target has its best ones, as size comes first in their
order.

Where routes cannot meet themselves again (no cycles, and no reaction whose
inputs are made of a common compound) sizes and confidences add up.  Then a
compound keeps its best routes only, with all that tie, and the number of all
routes is a sum of products over sizes; nothing is enumerated for it.
Otherwise all routes within the limit are grown and counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions.session import shared_folder
from attesta.operators import costing, graph, release

_NAMES = "array<string>"
#: Confidences are added as decimals, so that sums do not depend on their order.
_EXACT = "decimal(30,15)"


def _network(reactions: DataFrame, inputs: DataFrame, starting: DataFrame, target: DataFrame, max_steps: int) -> tuple[DataFrame, DataFrame]:
    """(makers, wants) that routes of ``max_steps`` to the targets can use.

    makers (reaction, product, arity, made, confidence, room): ``made`` tells how
    many inputs have to be made, ``room`` how many steps a route to the product
    may have.  wants (reaction, compound, k, made): the k-th input.
    """
    buy = starting.select(F.col("compound"), F.lit(False).alias("made")).distinct()
    used = inputs.select("reaction", "compound").distinct().join(buy, "compound", "left").withColumn("made", F.coalesce("made", F.lit(True)))
    makers = reactions.select("reaction", "product", F.coalesce("confidence", F.lit(0.0)).cast(_EXACT).alias("confidence")).distinct()
    # a starting material is bought and not made
    makers = makers.join(buy.select(F.col("compound").alias("product")), "product", "left_anti").checkpoint()
    arrows = makers.join(used, "reaction").select(F.col("compound").alias("source_id"), F.col("product").alias("target_id")).distinct().checkpoint()
    needed = graph.backtrack(arrows, target.select(F.col("compound").alias("node_id")), max_steps - 1)
    makers = makers.join(needed.select(F.col("node_id").alias("product"), (max_steps - F.col("level")).alias("room")), "product")
    used = used.join(makers.select("reaction").distinct(), "reaction", "left_semi")
    wants = used.withColumn("k", F.row_number().over(W.partitionBy("reaction").orderBy("compound"))).checkpoint()
    arity = wants.groupBy("reaction").agg(F.max("k").alias("arity"), F.sum(F.col("made").cast("int")).alias("made"))
    return makers.join(arity, "reaction").checkpoint(), wants


def _separable(makers: DataFrame, wants: DataFrame, max_steps: int) -> int | None:
    """How many reactions follow each other at most, if no compound is needed to make itself and no two inputs of a reaction need a common compound (as far as ``max_steps`` tell; if in doubt, None)."""
    depth, down = 1, makers.join(wants.filter("made"), "reaction").select(F.col("product").alias("node"), F.col("compound").alias("below")).distinct().checkpoint()
    left = down
    for _ in range(max_steps):  # what needs nothing made goes; a cycle never does
        if left.isEmpty():
            break
        depth += 1
        left = left.join(left.select(F.col("node").alias("below")).distinct(), "below", "left_semi").select("node", "below").checkpoint()
    else:
        if not left.isEmpty():
            return None
    two = makers.filter("made > 1").select("reaction").join(wants.filter("made"), "reaction").select("reaction", F.col("compound").alias("input"), F.col("compound").alias("node")).checkpoint()
    seen = two
    while not two.isEmpty():
        if not seen.groupBy("reaction", "node").agg(F.countDistinct("input").alias("n")).filter("n > 1").isEmpty():
            return None
        two = two.join(down, "node").select("reaction", "input", F.col("below").alias("node")).distinct().checkpoint()
        seen = seen.unionByName(two).distinct()
    return depth


def _grow(makers: DataFrame, wants: DataFrame, routes: DataFrame, n: int, most: int, apart: bool) -> DataFrame:
    """Routes of exactly ``n`` steps out of smaller ones: (compound, steps, makes, confidence)."""
    none = F.array().cast(_NAMES)
    open_ = makers.filter(F.col("room") >= n)
    partial = open_.select("reaction", "product", "arity", "made", "confidence", none.alias("steps"), none.alias("makes"))
    out = None
    for k in range(1, most + 1):
        nxt = wants.filter(F.col("k") == k).select("reaction", "compound", F.col("made").alias("bought_not"))
        nxt = nxt.join(routes.select("compound", F.col("steps").alias("s2"), F.col("makes").alias("m2"), F.col("confidence").alias("c2")), "compound").drop("compound")
        both = partial.join(nxt, "reaction").filter(~F.array_contains("m2", F.col("product")))
        steps, makes = F.array_distinct(F.concat("steps", "s2")), F.array_distinct(F.concat("makes", "m2"))
        # inputs that have still to be made take a step each
        made = F.col("made") - F.col("bought_not").cast("int")
        both = both.select("reaction", "product", "arity", made.alias("made"), (F.col("confidence") + F.col("c2")).cast(_EXACT).alias("confidence"), steps.alias("steps"), makes.alias("makes"))
        room = F.col("made") if apart else F.lit(0)
        partial = both.filter(F.size("steps") + room < n)
        full = partial.filter((F.col("arity") == k) & (F.size("steps") == n - 1))
        out = full if out is None else out.unionByName(full)
        partial = partial.filter(F.col("arity") > k)
    steps, makes = F.concat("steps", F.array("reaction")), F.concat("makes", F.array("product"))
    grown = out.select(F.col("product").alias("compound"), steps.alias("steps"), makes.alias("makes"), "confidence").filter(F.size("steps") == F.size("makes"))
    return grown.dropDuplicates(["compound", "steps"])


def _count(makers: DataFrame, wants: DataFrame, starting: DataFrame, depth: int, most: int) -> DataFrame:
    """(compound, n, ways): how many routes of n steps there are, where routes are separable and ``depth`` reactions follow each other at most."""
    base = starting.select("compound").distinct().select("compound", F.lit(0).alias("n"), F.lit(1).cast("decimal(38,0)").alias("ways"))
    known = base
    for _ in range(depth):  # a product is known when its inputs are
        partial = makers.select("reaction", "product", "arity", "room", F.lit(1).alias("n"), F.lit(1).cast("decimal(38,0)").alias("ways"))
        out = None
        for k in range(1, most + 1):
            nxt = wants.filter(F.col("k") == k).select("reaction", "compound").join(known.select("compound", F.col("n").alias("m"), F.col("ways").alias("w")), "compound")
            partial = partial.join(nxt, "reaction").withColumn("n", F.col("n") + F.col("m")).filter("n <= room")
            partial = partial.groupBy("reaction", "product", "arity", "room", "n").agg(F.sum((F.col("ways") * F.col("w")).cast("decimal(38,0)")).cast("decimal(38,0)").alias("ways"))
            full = partial.filter(F.col("arity") == k).select(F.col("product").alias("compound"), "n", "ways")
            out = full if out is None else out.unionByName(full)
            partial = partial.filter(F.col("arity") > k)
        known = base.unionByName(out.groupBy("compound", "n").agg(F.sum("ways").cast("decimal(38,0)").alias("ways"))).checkpoint()
    return known


def search(reactions: DataFrame, inputs: DataFrame, starting: DataFrame, target: DataFrame, max_steps: int = 6, top: int = 10, excluded: DataFrame | None = None, hazardous: DataFrame | None = None, participants: DataFrame | None = None) -> DataFrame:
    """``enumerate_routes`` with the array of its ``steps`` besides the path."""
    if excluded is not None:
        starting, reactions = starting.join(excluded, "compound", "left_anti"), reactions.join(excluded.select(F.col("compound").alias("product")), "product", "left_anti")
    if hazardous is not None:
        involved = inputs.select("reaction", "compound").unionByName(reactions.select("reaction", F.col("product").alias("compound")))
        involved = involved if participants is None else involved.unionByName(participants.select("reaction", "compound"))
        reactions = reactions.join(involved.join(hazardous, "compound", "left_semi"), "reaction", "left_anti")
    shared_folder(reactions.sparkSession)
    target = target.select("compound").distinct().checkpoint()
    makers, wants = _network(reactions, inputs, starting, target, max_steps)
    most = makers.agg(F.coalesce(F.max("arity"), F.lit(0))).first()[0]
    needed = wants.select("compound").unionByName(target).distinct()
    buy = starting.select("compound").distinct().join(needed, "compound", "left_semi").checkpoint()
    none = F.array().cast(_NAMES)
    routes = buy.select("compound", none.alias("steps"), none.alias("makes"), F.lit(0).cast(_EXACT).alias("confidence")).checkpoint()
    depth = _separable(makers, wants, max_steps) if most else None
    apart = depth is not None
    first = W.partitionBy("compound").orderBy(F.size("steps"), F.col("confidence").desc())
    for n in range(1, max_steps + 1 if most else 1):
        routes = routes.unionByName(_grow(makers, wants, routes, n, most, apart))
        if not apart:
            routes = routes.checkpoint()
            continue
        routes = routes.withColumn("r", F.rank().over(first)).filter(F.col("r") <= top).drop("r").checkpoint()
        served = routes.join(target, "compound").groupBy("compound").count().filter(F.col("count") >= top)
        if target.join(served, "compound", "left_anti").isEmpty():
            break
    found = routes.join(target, "compound")
    if not apart:  # steps that several inputs share count once
        each = makers.select("reaction", F.col("confidence").alias("c")).distinct()
        found = found.select("compound", "steps", F.explode_outer("steps").alias("reaction")).join(each, "reaction", "left").groupBy("compound", "steps").agg(F.coalesce(F.sum("c"), F.lit(0)).cast(_EXACT).alias("confidence"))
    key = F.concat_ws(">", "steps")
    scored = found.select("compound", "steps", key.alias("path"), F.size("steps").alias("n_steps"), F.col("confidence").cast("double").alias("confidence"), F.concat(F.lit("route:"), F.substring(F.sha2(F.concat_ws("|", "compound", key), 256), 1, 24)).alias("route_id"))
    if apart:
        tally = _count(makers, wants, buy, depth, most).join(target, "compound").groupBy("compound").agg(F.sum("ways").cast("bigint").alias("n_routes"))
    else:
        tally = scored.groupBy("compound").agg(F.count(F.lit(1)).alias("n_routes"))
    w = W.partitionBy("compound").orderBy("n_steps", F.col("confidence").desc(), "route_id")
    best = scored.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= top).drop("rn")
    return best.join(tally, "compound").select("compound", "path", "n_steps", "confidence", "route_id", "n_routes", "steps")


def enumerate_routes(reactions: DataFrame, inputs: DataFrame, starting: DataFrame, target: DataFrame, max_steps: int = 6, top: int = 10, excluded: DataFrame | None = None, hazardous: DataFrame | None = None, participants: DataFrame | None = None) -> DataFrame:
    """Routes from starting materials to the targets: (compound, path, n_steps, confidence, route_id, n_routes), the best ``top`` of each target; n_routes counts them all.

    reactions (reaction, product, confidence), inputs (reaction, compound),
    starting (compound), target (compound).  A route takes one reaction for each
    compound that it makes, ``max_steps`` in all at most, and uses what it has
    made as often as it is needed; its path names the inputs' steps in the order
    of the inputs' names, then the reaction.  Fewer steps come first, then
    higher confidence (the sum over the steps), then the id.  Reactions without
    inputs are skipped; a target that is a starting material has the route of no
    steps.  Compounds in excluded (compound) are neither bought nor made;
    reactions with a compound in hazardous (compound) among their inputs,
    product or other participants (reaction, compound) are not used.
    """
    return search(reactions, inputs, starting, target, max_steps, top, excluded, hazardous, participants).drop("steps")


#: Name under which routes of this search are stored.
ALGORITHM = "backward-by-size-1"


def request(network: dict[str, DataFrame], target: DataFrame, currency: str, at: str | None = None, **options) -> dict[str, DataFrame]:
    """Routes to the wanted compounds (compound, mass_g), found, priced, scored and ranked: the tables route_candidate, route_step, route_evaluation, route_warning and gap.

    network: reactions (reaction, product, confidence, yield_percent,
    publication, is_synthetic, scale_g), inputs (reaction, compound,
    stoichiometry), starting (compound), weights (compound, mw), quotes and
    rates as for ``costing.convert_quotes``, participants (reaction, compound)
    and hazards (compound, severity, status).  ``options`` are those of the
    search.  Without ``at`` the last rates count.  A route's id depends on its
    steps, mass, currency and date.  A route of no steps is the compound bought
    as it is.  Targets without a route are in gap (compound).
    """
    n, c = network, F.col
    found = search(n["reactions"].select("reaction", "product", "confidence"), n["inputs"], n["starting"], target, participants=n["participants"], **options)
    mass = target.select("compound", c("mass_g").cast("double").alias("target_g"))
    basis = F.concat_ws("|", "route_id", c("target_g").cast("string"), F.lit(currency), F.lit(at or "latest"))
    found = found.join(mass, "compound").withColumn("route", F.concat(F.lit("route-"), F.substring(F.sha2(basis, 256), 1, 16))).checkpoint()
    steps = found.select("route", F.posexplode("steps").alias("step_order", "reaction")).join(n["reactions"], "reaction").checkpoint()
    step = steps.select("route", c("reaction").alias("step"), "product", "yield_percent")
    leaves, warnings = costing.mass_balance(step, n["inputs"].select(c("reaction").alias("step"), "compound", "stoichiometry"), found.select("route", "compound", c("target_g").alias("mass_g")), n["weights"])
    priced = costing.priced_requirements(leaves, costing.convert_quotes(n["quotes"], n["rates"], currency, at or "9999-12-31"))
    summary = costing.step_summary(steps, n["participants"], n["hazards"])
    whole = found.select("route", "compound", "target_g").join(priced, "route", "left").join(summary, "route", "left")
    # nothing is lost on the way of a route without steps, and nothing speaks for it
    whole = whole.fillna({"n_steps": 0, "cumulative_yield": 1.0, "evidence_share": 0.0, "severity": 0.0, "total_g": 0.0, "priced_g": 0.0})
    ranked = costing.rank(costing.evaluate(whole), ["compound"])
    return {
        "route_candidate": found.select("route", "compound", "target_g", F.lit(currency).alias("base_currency"), F.lit(at).cast("string").alias("fx_date"), "path", "n_steps", "confidence", F.lit(ALGORITHM).alias("algorithm")),
        "route_step": steps.select("route", "step_order", "reaction", "product", "yield_percent", "scale_g", "confidence", "publication", "is_synthetic"),
        "route_evaluation": ranked.select("route", "coverage", "actual_cost", "relative_cost_index", "feasibility_score", "rank_score", "rank", "tier"),
        "route_warning": warnings.select("route", "step", "compound", "reason") if warnings is not None else found.select("route", *[F.lit(None).cast("string").alias(x) for x in ("step", "compound", "reason")]).limit(0),
        "gap": target.select("compound").distinct().join(found, "compound", "left_anti"),
    }


def _faults(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    routes, evaluations = tables["route_candidate"].select("route"), tables["route_evaluation"].select("route")
    return {
        "repeated routes": tables["route_candidate"].groupBy("route").count().filter("count > 1"),
        "routes without an evaluation": routes.join(evaluations, "route", "left_anti"),
        "evaluations or steps without a route": evaluations.unionByName(tables["route_step"].select("route")).join(routes, "route", "left_anti"),
    }


def store(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """Publishes the routes of a request with those stored before, as one release; routes of the same id are replaced."""
    names = ("route_candidate", "route_step", "route_evaluation", "route_warning")
    old = release.tables_of(spark, root) if release.versions(spark, root) else {}
    new = tables["route_candidate"].select("route").checkpoint()
    merged = {}
    for t in names:
        merged[t] = tables[t]
        if t in old:
            merged[t] = release.read(spark, root, t).join(new, "route", "left_anti").unionByName(tables[t])
    return release.publish(spark, root, merged, _faults)


def stored(spark: SparkSession, root: str, *ids: str) -> DataFrame:
    """Stored routes by their ids, in the rank that they have among each other: route, compound, path, tier, scores, ``rank`` and their steps in order; ValueError names the ids that are not there."""
    wanted = spark.createDataFrame([(i,) for i in ids], "route string").distinct()
    own = lambda t: release.read(spark, root, t).join(F.broadcast(wanted), "route", "left_semi")
    found = own("route_candidate").join(own("route_evaluation").drop("rank", "rank_score"), "route")
    if lost := sorted(set(ids) - {r.route for r in found.select("route").collect()}):
        raise ValueError(f"no stored route {', '.join(lost)}")
    steps = own("route_step").groupBy("route").agg(F.array_sort(F.collect_list(F.struct("step_order", "reaction", "product", "yield_percent"))).alias("steps"))
    return costing.rank(found.withColumn("all", F.lit(1)), ["all"]).drop("all").join(steps, "route", "left")
