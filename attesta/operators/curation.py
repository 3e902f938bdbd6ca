"""Curated process-step examples and source registries: validation, tables, approval and price lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions import scalars as S
from attesta.functions.session import shared_folder
from attesta.operators import graph, merge

#: The nested record of an example.
EXAMPLE = """schema_version string, example_id string, is_synthetic boolean,
patent struct<publication_number: string, family_id: string, publication_date: string, title: string>,
compound struct<compound_id: string, preferred_name: string, active_moiety_id: string, active_moiety_name: string, material_form: string, inchi_key: string, connectivity_key: string>,
route struct<route_id: string, step_id: string, step_order: bigint, transformation_key: string, operation_summary: string>,
evidence struct<source_id: string, source_artifact_sha256: string, paragraph_id: string, section_type: string, char_start: bigint, char_end: bigint, text: string, span_sha256: string, status: string, extraction_method: string, extractor_version: string, retrieved_at: string, license: string, redistribution_class: string>,
quantities array<struct<kind: string, value: double, unit: string, confidence: double>>,
outcome struct<yield_percent: double, purity_percent: double, outcome_type: string, confidence: double>,
labels struct<scale_band: string, development_stage: string, development_stage_basis: string, confidence: double>,
linkage struct<match_type: string, confidence: double>,
review struct<status: string, reviewer_id: string, reviewed_at: string, rationale: string>"""
#: Values that a field may have, fixed values.
REVIEW = ("accepted", "rejected", "needs_review")
EVIDENCE = ("performed", "historical", "prophetic", "generic", "ambiguous")
STAGES = ("discovery", "preclinical", "phase_1", "phase_2", "phase_3", "approved", "post_approval", "unknown")
LINKS = ("exact_structure", "same_connectivity", "active_moiety", "regulatory_patent", "family_only", "name_only", "analogue")
WEAK_LINKS = ("name_only", "family_only", "analogue")
BANDS = ("unknown", *[name for _, name in S.BANDS])
#: A site that is not to be read by machine, a fixed value.
CLOSED_SITE = "wipo_patentscope_public"


def largest_basis(quantities: Column) -> Column:
    """Grams of the largest quantity of the kind that comes first as a basis; null without one."""
    usable = F.transform(quantities, lambda q: F.struct((-S.basis_rank(q["kind"])).alias("r"), S.grams(q["value"], q["unit"]).alias("g")))
    return F.array_max(F.filter(usable, lambda x: x["r"].isNotNull() & x["g"].isNotNull())).getField("g")


def _iso(text: Column) -> Column:
    """Whether a text is a date, with or without a time in UTC; null is none."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}(T.*Z)?$") & F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).isNotNull() & (~text.contains("T") | F.try_to_timestamp(text).isNotNull()), F.lit(False))


def validation_issues(examples: DataFrame, sources: DataFrame) -> DataFrame:
    """(example_id, code, path, severity) of everything that is wrong with an example; ``sources`` (source_id) is the registry. Quantities are told by their number, from 0."""
    c = F.col
    blank = lambda x: S.clean(x).isNull()
    outside = lambda x, low, high: F.coalesce(~x.between(low, high), F.lit(False))
    one_of = lambda x, values: F.coalesce(x.isin(*values), F.lit(False))
    is_hash = lambda x: F.coalesce(x.rlike("^[A-Fa-f0-9]{64}$"), F.lit(False))
    some = lambda x, bad: x.isNotNull() & (x != "") & bad
    required = ("schema_version", "example_id", "patent.family_id", "compound.compound_id", "compound.active_moiety_id", "route.route_id", "route.step_id", "evidence.source_id", "evidence.paragraph_id", "evidence.text", "evidence.extraction_method", "evidence.license", "evidence.redistribution_class", "review.reviewer_id")
    rules = [("required", path, blank(c(path))) for path in required]
    band, stage, basis = c("labels.scale_band"), c("labels.development_stage"), c("labels.development_stage_basis")
    rules += [
        ("required_boolean", "is_synthetic", c("is_synthetic").isNull()),
        ("patent_number", "patent.publication_number", S.publication_dashed(c("patent.publication_number")).isNull()),
        ("date", "patent.publication_date", some(c("patent.publication_date"), ~_iso(c("patent.publication_date")))),
        ("inchi_key", "compound.inchi_key", some(c("compound.inchi_key"), ~c("compound.inchi_key").rlike(S.KEY_PATTERN))),
        ("connectivity_key", "compound.connectivity_key", some(c("compound.connectivity_key"), ~c("compound.connectivity_key").rlike(S.CONNECTIVITY_PATTERN))),
        ("unknown_source", "evidence.source_id", ~c("__known")),
        ("sha256", "evidence.source_artifact_sha256", ~is_hash(c("evidence.source_artifact_sha256"))),
        ("sha256", "evidence.span_sha256", ~is_hash(c("evidence.span_sha256"))),
        ("span_hash_mismatch", "evidence.span_sha256", is_hash(c("evidence.span_sha256")) & (c("evidence.span_sha256") != F.sha2("evidence.text", 256))),
        ("offset", "evidence.char_start", ~F.coalesce(c("evidence.char_start") >= 0, F.lit(False))),
        ("offset", "evidence.char_end", c("evidence.char_end").isNull() | F.coalesce(c("evidence.char_end") < c("evidence.char_start"), F.lit(False))),
        ("evidence_status", "evidence.status", ~one_of(c("evidence.status"), EVIDENCE)),
        ("date", "evidence.retrieved_at", ~_iso(c("evidence.retrieved_at"))),
        ("quantities", "quantities", c("quantities").isNull()),
        ("scale_band", "labels.scale_band", ~one_of(band, BANDS)),
        ("scale_mismatch", "labels.scale_band", one_of(band, BANDS) & (band != F.coalesce(S.scale_band(largest_basis(c("quantities"))), F.lit("unknown")))),
        ("development_stage", "labels.development_stage", ~one_of(stage, STAGES)),
        ("stage_basis", "labels.development_stage_basis", (F.coalesce(stage, F.lit("")) != "unknown") & (F.coalesce(basis, F.lit("")) == "")),
        ("stage_from_scale", "labels.development_stage_basis", basis == "scale"),
        ("yield", "outcome.yield_percent", outside(c("outcome.yield_percent"), 0, 105)),
        ("purity", "outcome.purity_percent", outside(c("outcome.purity_percent"), 0, 100)),
        ("link_type", "linkage.match_type", ~one_of(c("linkage.match_type"), LINKS)),
        ("confidence", "linkage.confidence", ~F.coalesce(c("linkage.confidence").between(0, 1), F.lit(False))),
        ("review_status", "review.status", ~one_of(c("review.status"), REVIEW)),
        ("date", "review.reviewed_at", ~_iso(c("review.reviewed_at"))),
        ("training_evidence_status", "evidence.status", ~F.coalesce(c("is_synthetic"), F.lit(False)) & (c("review.status") == "accepted") & ~one_of(c("evidence.status"), ("performed", "historical"))),
    ]
    weak = ("weak_identity", "linkage.match_type", one_of(c("linkage.match_type"), WEAK_LINKS) & (c("review.status") == "accepted"))
    told = lambda code, path, severity="error": F.struct(F.lit(code).alias("code"), path.alias("path"), F.lit(severity).alias("severity"))

    def of_quantity(q: Column, i: Column) -> Column:
        at = lambda field: F.concat(F.lit("quantities["), i.cast("string"), F.lit(f"].{field}"))
        bad = [("required", "kind", blank(q["kind"])), ("required", "unit", blank(q["unit"])), ("quantity_value", "value", F.coalesce(F.isnan(q["value"]) | (q["value"] < 0), F.lit(True))), ("confidence", "confidence", outside(q["confidence"], 0, 1))]
        return F.array_compact(F.array(*[F.when(wrong, told(code, at(field))) for code, field, wrong in bad]))

    known = sources.select(F.col("source_id").alias("__id"), F.lit(True).alias("__k")).distinct()
    with_known = examples.join(known, F.col("evidence.source_id") == F.col("__id"), "left").withColumn("__known", F.coalesce("__k", F.lit(False)))
    fixed = F.array_compact(F.array(*[F.when(bad, told(code, F.lit(path))) for code, path, bad in rules], F.when(weak[2], told(weak[0], F.lit(weak[1]), "warning"))))
    each = F.flatten(F.transform(F.coalesce("quantities", F.array().cast(examples.schema["quantities"].dataType)), of_quantity))
    return with_known.select("example_id", F.explode(F.concat(fixed, each)).alias("i")).select("example_id", "i.*")


def duplicate_ids(examples: DataFrame) -> DataFrame:
    return examples.groupBy("example_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def registry_issues(sources: DataFrame) -> DataFrame:
    """(source_id, code, severity): missing fields, repeated ids, sources that are not known to be dispensable while the engine runs, and forbidden or doubtful acquisition.

    A source without ``runtime_dependency`` or, for the site named below,
    without ``automated_acquisition_allowed`` has not ruled it out: an error.
    """
    c = F.col
    rules = [(f"required_{n}", F.coalesce(c(n), F.lit("")) == "", "error") for n in ("name", "authority", "role", "collection_mode", "license_code")]
    rules += [
        ("required_source_id", F.coalesce(c("source_id").cast("string"), F.lit("")) == "", "error"),
        ("runtime_dependency", F.coalesce(c("runtime_dependency"), F.lit(True)), "error"),
        ("wipo_terms", (c("source_id").cast("string") == CLOSED_SITE) & F.coalesce(c("automated_acquisition_allowed"), F.lit(True)), "error"),
        ("restricted_acquisition", (c("redistribution") == "restricted") & c("automated_acquisition_allowed"), "warning"),
    ]
    each = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, bad, severity in rules]))
    found = sources.select("source_id", F.explode(each).alias("i")).select("source_id", "i.*")
    twice = sources.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("source_id", F.lit("duplicate_source").alias("code"), F.lit("error").alias("severity"))
    return found.unionByName(twice)


def register_sources(stored: DataFrame, registry: DataFrame) -> DataFrame:
    """The stored sources after a registry without errors was merged in: what it says of a source replaces what was known. An error in it is a ValueError that names one."""
    if bad := registry_issues(registry).filter("severity = 'error'").orderBy("source_id", "code").first():
        raise ValueError(f"registry: {bad.source_id} {bad.code}")
    return merge.upsert(stored, registry, ["source_id"])


def tables(examples: DataFrame, version: str = "working", policy: str = "1.0.0", path: str = "examples.jsonl") -> dict[str, DataFrame]:
    """The examples as rows of the stored tables, one plan for each; nothing is accepted by it that was not accepted before.

    They belong to the dataset ``version``.  Of a release, artifact or family
    that several examples name, the one of the least id tells the details.
    """
    e, c = examples, F.col
    release = F.concat("evidence.source_id", F.lit(":fixture-release"))
    first = lambda d, key, **cols: d.groupBy(key).agg(F.min_by(F.struct(*[v.alias(n) for n, v in cols.items()]), "example_id").alias("r")).select(key, "r.*")
    released = e.withColumns({"release_id": release, "artifact_id": F.concat(release, F.lit(":"), F.substring("evidence.source_artifact_sha256", 1, 16)), "family_id": S.clean(c("patent.family_id"))})
    span = S.stable_id("span", c("patent.publication_number"), c("evidence.char_start"), c("evidence.char_end"), c("evidence.span_sha256"))
    q = e.select(c("route.step_id").alias("step_id"), F.posexplode("quantities").alias("at", "q"))
    return {
        "dataset_version": e.sparkSession.createDataFrame([(version, "working", policy)], "dataset_version_id string, status string, policy_version string"),
        "source_release": first(released.filter("release_id is not null"), "release_id", source_id=c("evidence.source_id"), released_on=c("patent.publication_date"), schema_version=c("schema_version")),
        "artifact": first(released.filter("artifact_id is not null"), "artifact_id", release_id=c("release_id"), relative_path=F.lit(path), sha256=c("evidence.source_artifact_sha256"), size_bytes=F.octet_length("evidence.text").cast("bigint"), media_type=F.lit("application/x-ndjson")),
        "patent_family": first(released.filter("family_id is not null"), "family_id", source_id=c("evidence.source_id"), confidence=c("linkage.confidence")),
        "dataset_example": e.groupBy("example_id").agg(F.max_by(F.struct(c("route.step_id").alias("step_id"), c("patent.family_id").alias("family_id"), c("compound.active_moiety_id").alias("active_moiety_id"), c("labels.scale_band").alias("scale_band"), c("is_synthetic").alias("is_synthetic"), S.canonical_json(e, *e.columns).alias("payload_json")), c("route.step_id")).alias("r")).select(F.lit(version).alias("dataset_version_id"), "example_id", "r.*"),
        "patent_document": e.select(c("patent.publication_number").alias("publication_number"), F.substring("patent.publication_number", 1, 2).alias("country_code"), c("patent.publication_date").alias("publication_date"), c("patent.title").alias("title"), c("evidence.source_id").alias("source_id")).distinct(),
        "patent_family_member": e.filter(S.clean(c("patent.family_id")).isNotNull()).select(c("patent.family_id").alias("family_id"), c("patent.publication_number").alias("publication_number"), F.lit("member").alias("relationship")).distinct(),
        "active_moiety": e.filter(c("compound.active_moiety_id").isNotNull()).groupBy(c("compound.active_moiety_id").alias("active_moiety_id")).agg(F.min("compound.active_moiety_name").alias("preferred_name")),
        "compound": e.groupBy(c("compound.compound_id").alias("compound_id")).agg(F.min(F.struct("compound.preferred_name", "compound.active_moiety_id", "compound.material_form")).alias("r")).select("compound_id", "r.*"),
        "evidence_span": e.select(span.alias("evidence_span_id"), c("patent.publication_number").alias("publication_number"), c("evidence.char_start").alias("char_start"), c("evidence.char_end").alias("char_end"), c("evidence.text").alias("evidence_text"), c("evidence.span_sha256").alias("text_sha256"), c("evidence.status").alias("evidence_status"), c("review.status").alias("review_status")).dropDuplicates(["evidence_span_id"]),
        "process_route": e.select(c("route.route_id").alias("route_id"), c("compound.active_moiety_id").alias("active_moiety_id"), c("compound.compound_id").alias("target_compound_id")).distinct(),
        "process_step": e.select(c("route.step_id").alias("step_id"), c("route.route_id").alias("route_id"), span.alias("evidence_span_id"), c("route.step_order").alias("step_order"), c("route.transformation_key").alias("transformation_key"), c("review.status").alias("review_status")).dropDuplicates(["step_id"]),
        "quantity_observation": q.select(S.stable_id("quantity", c("step_id"), c("at")).alias("quantity_id"), "step_id", c("q.kind").alias("quantity_kind"), c("q.value").alias("original_value"), c("q.unit").alias("original_unit"), S.grams(c("q.value"), c("q.unit")).alias("normalized_value"), c("q.confidence").alias("confidence")),
        "outcome_observation": e.filter(c("outcome").isNotNull()).select(S.stable_id("outcome", c("route.step_id")).alias("outcome_id"), c("route.step_id").alias("step_id"), "outcome.*"),
        "scale_label": e.select(S.stable_id("scale", c("route.step_id")).alias("scale_label_id"), c("route.step_id").alias("step_id"), c("labels.scale_band").alias("scale_band"), largest_basis(c("quantities")).alias("basis_value_g"), c("labels.development_stage").alias("development_stage")),
        "curation_decision": e.filter(c("review.reviewer_id").isNotNull()).select(S.stable_id("decision", c("example_id"), c("review.reviewed_at")).alias("decision_id"), F.lit("example").alias("object_type"), c("example_id").alias("object_id"), c("review.status").alias("decision"), c("review.reviewer_id").alias("reviewer_id"), c("review.reviewed_at").alias("decided_at"), c("review.rationale").alias("rationale")),
    }


def approve(steps: DataFrame, spans: DataFrame, routes: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """Review states after the decisions (step_id, decision): a step's decision goes to its span, and a route is accepted when all its steps are."""
    decided = decisions.select("step_id", F.col("decision").alias("review_status"))
    steps = merge.update_where(steps, decided, ["step_id"], ["review_status"])
    by_span = steps.join(decided.select("step_id"), "step_id", "left_semi").groupBy("evidence_span_id").agg(F.min("review_status").alias("review_status"))
    whole = steps.groupBy("route_id").agg(F.bool_and(F.col("review_status") == "accepted").alias("ok")).filter("ok").select("route_id", F.lit("accepted").alias("review_status"))
    return {"process_step": steps, "evidence_span": merge.update_where(spans, by_span, ["evidence_span_id"], ["review_status"]), "process_route": merge.update_where(routes, whole, ["route_id"], ["review_status"])}


#: An example that was extracted from a publication.
EXTRACTED = """seq bigint, example_id string, publication_number string, target_compound_id string, active_moiety_id string, route_id string, step_id string, reaction_id string, name string, text string, paragraph_id string, source_url string, transformation_key string, yield_percent double, scale_g double, confidence double,
participants array<struct<compound_id: string, role: string, stoichiometry: double>>, conditions array<struct<condition_type: string, numeric_value: double, unit: string>>"""


def ingest_extracted(examples: DataFrame, stored: dict[str, DataFrame] | None = None, source: str = "surechembl_bulk", status: str = "unreviewed", method: str = "llm_assisted_review", version: str = "review-v1") -> dict[str, DataFrame]:
    """The tables evidence_span, process_route, process_step, reaction_instance, reaction_participant and reaction_condition after extracted examples (EXTRACTED) were merged into the stored ones.

    What an example says of its span, route, step and reaction replaces what was
    stored, its review state included; of two in a file the later (``seq``)
    counts.  Participants and conditions of its reaction are replaced as a
    whole.  Nothing is accepted by it unless ``status`` says so.
    """
    c, state = F.col, F.lit(status).alias("review_status")
    e = examples.withColumns({"text": F.coalesce("text", F.lit("")), "hash": F.sha2(F.coalesce("text", F.lit("")), 256)})
    one = {
        "evidence_span": (["evidence_span_id"], e.select("seq", c("example_id").alias("evidence_span_id"), "publication_number", F.lit(source).alias("source_id"), c("hash").alias("artifact_sha256"), F.lit("example").alias("section_type"), "paragraph_id", F.lit(0).cast("bigint").alias("char_start"), F.length("text").cast("bigint").alias("char_end"), c("text").alias("evidence_text"), c("hash").alias("text_sha256"), F.lit("performed").alias("evidence_status"), F.lit(method).alias("extraction_method"), F.lit(version).alias("extractor_version"), state, "source_url")),
        "process_route": (["route_id"], e.select("seq", "route_id", "active_moiety_id", "target_compound_id", F.substring("hash", 1, 16).alias("route_fingerprint"), state)),
        "process_step": (["step_id"], e.select("seq", "step_id", "route_id", c("example_id").alias("evidence_span_id"), F.lit(1).cast("bigint").alias("step_order"), "transformation_key", c("target_compound_id").alias("product_compound_id"), c("name").alias("operation_summary"), F.lit("performed").alias("evidence_status"), state)),
        "reaction_instance": (["reaction_id"], e.select("seq", "reaction_id", c("name").alias("reaction_name"), "transformation_key", c("example_id").alias("evidence_span_id"), "yield_percent", c("scale_g").alias("demonstrated_scale_g"), "confidence", state, F.lit(False).alias("is_synthetic"))),
    }
    last = e.groupBy("reaction_id").agg(F.max_by(F.struct("example_id", "participants", "conditions"), "seq").alias("r")).select("reaction_id", "r.*")
    who = last.select("reaction_id", F.explode("participants").alias("p")).select("reaction_id", "p.*")
    how = last.select("reaction_id", "example_id", F.explode("conditions").alias("c")).select(F.concat_ws("-", "reaction_id", "c.condition_type").alias("condition_id"), "reaction_id", "c.*", c("example_id").alias("evidence_span_id"))
    stored, out = stored or {}, {}
    for name, (key, rows) in one.items():
        out[name] = merge.upsert(stored.get(name, rows.drop("seq").limit(0)), rows, key, order="seq")
    for name, rows in (("reaction_participant", who), ("reaction_condition", how)):
        old = stored.get(name, rows.limit(0))
        # an example without any leaves none
        out[name] = old.join(last.select("reaction_id"), "reaction_id", "left_anti").select(rows.columns).unionByName(rows)
    return out


def approve_publications(stored: dict[str, DataFrame], approvals: DataFrame) -> dict[str, DataFrame]:
    """The tables after reviewers accepted what publications say of drugs: approvals (publication_number, drug_id, reviewer_id, rationale, decided_at).

    By the candidate (patent_candidate) an approval reaches the spans of its
    publication, their steps, routes and reactions: all become accepted, the
    candidate too, and each route gets a link_candidate and a curation_decision.
    An approval without a candidate does nothing.
    """
    c, t = F.col, stored
    known = approvals.join(t["patent_candidate"].select("publication_number", "drug_id").distinct(), ["publication_number", "drug_id"])
    spans = known.join(t["evidence_span"].select("publication_number", "evidence_span_id"), "publication_number")
    reached = spans.join(t["process_step"].select("evidence_span_id", "step_id", "route_id"), "evidence_span_id").join(t["reaction_instance"].select("evidence_span_id", "reaction_id"), "evidence_span_id").join(t["process_route"].select("route_id", "target_compound_id"), "route_id")
    accepted = lambda key: reached.select(key).distinct().withColumn("review_status", F.lit("accepted"))
    out = dict(t)
    for name, key in (("evidence_span", "evidence_span_id"), ("process_step", "step_id"), ("process_route", "route_id"), ("reaction_instance", "reaction_id")):
        out[name] = merge.update_where(t[name], accepted(key), [key], ["review_status"])
    out["patent_candidate"] = merge.update_where(t["patent_candidate"], known.select("publication_number", "drug_id").distinct().withColumn("review_status", F.lit("accepted")), ["publication_number", "drug_id"], ["review_status"])
    route = reached.groupBy("route_id").agg(F.max_by(F.struct("target_compound_id", "reviewer_id", "rationale", "decided_at"), F.struct("decided_at", "reviewer_id")).alias("r")).select("route_id", "r.*").withColumn("candidate_id", F.concat(F.lit("link-candidate:"), "route_id"))
    links = route.select("candidate_id", F.lit("process_route").alias("subject_type"), c("route_id").alias("subject_id"), F.lit("compound").alias("object_type"), c("target_compound_id").alias("object_id"), F.lit("synthesis_route").alias("relationship_type"), F.lit(1.0).alias("score"))
    decisions = route.select(F.concat_ws(":", F.lit("decision"), "route_id", F.substring(c("decided_at").cast("string"), 1, 19)).alias("decision_id"), "candidate_id", F.lit("process_route").alias("object_type"), c("route_id").alias("object_id"), F.lit("accepted").alias("decision"), "reviewer_id", "rationale", "decided_at")
    for name, key, rows in (("link_candidate", "candidate_id", links), ("curation_decision", "decision_id", decisions)):
        out[name] = merge.upsert(t.get(name, rows.limit(0)), rows, [key])
    return out


def import_quotes(quotes: DataFrame, compounds: DataFrame, suppliers: DataFrame, order: str) -> dict[str, DataFrame]:
    """Suppliers with the new ones, quotes of known compounds, and the rejected others."""
    known = compounds.select("compound_id").distinct()
    ok = quotes.join(known, "compound_id", "left_semi")
    named = ok.select(S.stable_id("supplier", S.normalize_name(F.col("supplier_name"))).alias("supplier_id"), "supplier_name", order)
    return {"supplier": merge.insert_ignore(suppliers, named, ["supplier_id"], order), "material_quote": ok.withColumn("supplier_id", S.stable_id("supplier", S.normalize_name(F.col("supplier_name")))), "rejected": quotes.join(known, "compound_id", "left_anti")}


def training_examples(steps: DataFrame) -> DataFrame:
    """Eligible steps as nested records, as JSON with its keys in order."""
    return steps.select(S.canonical_json(steps, *steps.columns).alias("payload_json"))


#: Fields of a step that make up each part of an exported example, under the part's own names.
_PARTS = {
    "patent": "publication_number family_id publication_date title",
    "compound": "compound_id=target_compound_id preferred_name active_moiety_id material_form smiles inchi_key",
    "route": "route_id step_id step_order transformation_key operation_summary",
    "evidence": "source_id source_artifact_sha256=artifact_sha256 paragraph_id section_type char_start char_end text=evidence_text span_sha256=text_sha256 status=evidence_status extraction_method extractor_version source_url retrieved_at license=license_code redistribution_class",
}


def nested_examples(steps: DataFrame, participants: DataFrame, conditions: DataFrame) -> DataFrame:
    """Eligible steps as nested records of the exchange format, an example each.

    steps have the fields of _PARTS and reaction_id, basis_kind, basis_value_g,
    scale_band, scale_confidence, yield_percent, reaction_confidence,
    reviewer_id, decided_at and rationale; participants (reaction_id, role,
    stoichiometry, compound_id, smiles, inchi_key) and conditions (reaction_id,
    condition_id, condition_type, value_text, numeric_value, unit) come in the
    order of role and compound, and of their ids.
    """
    c = F.col
    listed = lambda d, order, fields, name: d.groupBy("reaction_id").agg(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*fields).alias("v")))).alias("l")).select("reaction_id", F.transform("l", lambda x: x["v"]).alias(name))
    who = listed(participants, ["role", "compound_id"], ["role", "stoichiometry", "compound_id", "smiles", "inchi_key"], "participants")
    how = listed(conditions, ["condition_id"], ["condition_type", "value_text", "numeric_value", "unit"], "conditions")
    s = steps.join(who, "reaction_id", "left").join(how, "reaction_id", "left")
    none = lambda name: F.array().cast(s.schema[name].dataType)
    field = lambda f: c(f.rpartition("=")[2]).alias(f.partition("=")[0])
    part = {name: F.struct(*[field(f) for f in fields.split()]) for name, fields in _PARTS.items()}
    part["reaction"] = F.struct("reaction_id", F.coalesce("participants", none("participants")).alias("participants"), F.coalesce("conditions", none("conditions")).alias("conditions"))
    part["quantities"] = F.array(F.struct(F.coalesce("basis_kind", F.lit("product_mass")).alias("kind"), c("basis_value_g").alias("value"), F.lit("g").alias("unit"), c("scale_confidence").alias("confidence")))
    part["outcome"] = F.struct("yield_percent", F.lit("reported").alias("outcome_type"), c("reaction_confidence").alias("confidence"))
    part["labels"] = F.struct("scale_band", F.lit("unknown").alias("development_stage"), F.lit(None).cast("string").alias("development_stage_basis"), c("scale_confidence").alias("confidence"))
    part["linkage"] = F.struct(F.lit("exact_structure").alias("match_type"), F.lit(1).alias("confidence"))
    part["review"] = F.struct(F.lit("accepted").alias("status"), "reviewer_id", c("decided_at").alias("reviewed_at"), "rationale")
    return s.select(F.lit("1.0.0").alias("schema_version"), F.concat(F.lit("reviewed:"), c("step_id").cast("string")).alias("example_id"), F.lit(False).alias("is_synthetic"), *[v.alias(n) for n, v in part.items()])


def export_report(reasons: DataFrame, assignments: DataFrame) -> DataFrame:
    """One row on an export: candidate_steps, eligible_examples, how many were excluded for each reason, and how many are in each split. reasons (reason, null if eligible), assignments (split)."""
    kind = F.when(F.col("reason").isNull(), "eligible").otherwise("excluded")
    counts = reasons.groupBy(kind.alias("kind"), F.col("reason").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.unionByName(assignments.groupBy(F.lit("split").alias("kind"), F.col("split").alias("name")).agg(F.count(F.lit(1)).alias("n")))
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    named = lambda k: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("name", "n")))))
    # ten reasons and three splits at most
    return counts.agg(total(F.col("kind") != "split").alias("candidate_steps"), total(F.col("kind") == "eligible").alias("eligible_examples"), named("excluded").alias("excluded"), named("split").alias("split_counts"))


def mapped_reactions(participants: DataFrame, reaction: str) -> DataFrame:
    """(reaction, mapped): whether a reaction consumes and produces something and all that takes part (role, has_structure) has a structure."""
    role = F.col("role")
    return participants.groupBy(reaction).agg((F.bool_or(role == "consumed") & F.bool_or(role == "produced") & F.bool_and(F.coalesce("has_structure", F.lit(False)))).alias("mapped"))


def export_reason() -> Column:
    """Why a step is not exported, the first of ten reasons; null if it is.

    Columns: step_status, route_status, evidence_status, reaction_status (null
    without a reaction), is_synthetic, mapped, basis_g, family_id,
    publication_date, structure.
    """
    c = F.col
    other = lambda n: ~F.coalesce(c(n) == "accepted", F.lit(False))
    return S.first_reason(
        ("step_not_accepted", other("step_status")),
        ("route_not_accepted", other("route_status")),
        ("evidence_not_accepted", other("evidence_status")),
        ("reaction_not_accepted", other("reaction_status")),
        ("synthetic_reaction", F.coalesce(c("is_synthetic"), F.lit(True))),
        ("reaction_mapping_incomplete", ~F.coalesce(c("mapped"), F.lit(False))),
        ("missing_mass_basis", F.coalesce(c("basis_g"), F.lit(0)) == 0),
        ("missing_patent_family", S.clean(c("family_id")).isNull()),
        ("missing_publication_date", c("publication_date").isNull()),
        ("missing_validated_structure", ~F.coalesce(c("structure"), F.lit(False))),
    )


def assign_splits(examples: DataFrame, id_col: str, groups: list[str], seed: str) -> DataFrame:
    """(id, leakage_group, split): examples that share a value of any group column, directly or in a chain, come into one split."""
    # an example stands for its least value, and only values that examples have together are linked
    value = F.explode_outer(F.array_compact(F.array(*[F.concat(F.lit(f"{i}:"), F.col(g).cast("string")) for i, g in enumerate(groups)])))
    shared_folder(examples.sparkSession)
    own = examples.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("node"), value.alias("value")).withColumn("least", F.min("value").over(W.partitionBy("node"))).checkpoint()
    label = graph.components(own.filter("value <> least").select("least", "value").distinct(), "least", "value").withColumnRenamed("node", "least")
    first = own.groupBy("node").agg(F.min("least").alias("least"))
    label = first.join(label, "least", "left").select("node", F.coalesce("component", "least", F.concat(F.lit("e:"), F.col("node").cast("string"))).alias("component"))
    named = graph.group_names(label, "node", "component")
    return named.select(F.col("node").alias(id_col), "leakage_group", S.split_name(S.bucket(F.col("leakage_group"), seed)).alias("split"))
