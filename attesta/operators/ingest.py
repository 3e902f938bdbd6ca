"""Ingestion of released catalogues into entities, products, aliases and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions import scalars as S
from attesta.functions.session import shared_folder
from attesta.operators import graph, merge

#: Values that mean approval in a list export, fixed values; a blank passes too.
APPROVED = ("1", "true", "yes", "approved", "authorised", "authorized")


def _missing(**named: Column) -> Column:
    """``missing_a_and_b`` of the named columns that are blank; null if none is."""
    parts = F.concat_ws("_and_", *[F.when(S.clean(c).isNull(), F.lit(n)) for n, c in named.items()])
    return F.when(parts != "", F.concat(F.lit("missing_"), parts))


def regulatory_products(products: DataFrame, statuses: DataFrame | None, lookup: DataFrame | None, source: str = "products") -> DataFrame:
    """Products with outcome and reason, one row for each active ingredient.

    products: application_number, product_number, trade_name, ingredient,
    form_route, strength and, where there is no status table, type.  statuses
    (application_number, product_number, status_id) and lookup (status_id,
    description) are joined by padded numbers.
    """
    p = products.withColumns({"app": S.zfill(S.clean(F.col("application_number")), 6), "prod": S.zfill(S.clean(F.col("product_number")), 3)})
    if statuses is not None:
        s = statuses.select(S.zfill(S.clean(F.col("application_number")), 6).alias("app"), S.zfill(S.clean(F.col("product_number")), 3).alias("prod"), S.clean(F.col("status_id")).alias("status_id"))
        if lookup is not None:
            s = s.join(lookup.select(S.clean(F.col("status_id")).alias("status_id"), "description"), "status_id", "left")
        else:
            s = s.withColumn("description", F.lit(None).cast("string"))
        s = s.groupBy("app", "prod").agg(F.min_by(F.coalesce("description", "status_id"), "status_id").alias("status_text"))
        p = p.join(s, ["app", "prod"], "left")
    else:
        p = p.withColumn("status_text", F.col("type"))
    form, route = S.split_pair(F.col("form_route"))
    reason = _missing(application_number=F.col("application_number"), product_number=F.col("product_number"), active_ingredient=F.col("ingredient"))
    return p.select(
        F.when(reason.isNull(), "accepted").otherwise("rejected").alias("outcome"),
        reason.alias("reason"),
        F.concat_ws(":", F.lit("fda"), F.lit(source), "app", "prod").alias("regulatory_product_id"),
        F.col("app").alias("application_number"),
        F.col("prod").alias("product_number"),
        S.clean(F.col("trade_name")).alias("trade_name"),
        form.alias("dosage_form"),
        route.alias("route"),
        S.clean(F.col("strength")).alias("strength"),
        S.marketing_status(F.coalesce("status_text", F.lit(""))).alias("marketing_status"),
        F.explode_outer(S.split_list(F.col("ingredient"))).alias("ingredient"),
    )


def product_entities(products: DataFrame) -> dict[str, DataFrame]:
    """Entities, aliases and identifiers of accepted products."""
    ok = products.filter("outcome = 'accepted'").withColumn("normalized_alias", S.normalize_name(F.col("ingredient"))).withColumn("drug_id", S.stable_id("drug", F.col("normalized_alias")))
    drugs = ok.groupBy("drug_id").agg(F.min("ingredient").alias("preferred_name"))
    kinds = [("preferred_name", "ingredient"), ("active_ingredient", "ingredient"), ("brand_name", "trade_name")]
    aliases = None
    for kind, col in kinds:
        own = ok.filter(F.col(col).isNotNull()).select("drug_id", F.col(col).alias("alias"), S.normalize_name(F.col(col)).alias("normalized_alias"), F.lit(kind).alias("alias_type")).distinct()
        aliases = own if aliases is None else aliases.unionByName(own)
    identifiers = ok.select("drug_id", F.lit("FDA_APPLICATION").alias("namespace"), F.col("application_number").alias("identifier_value")).distinct()
    return {"drug_entity": drugs, "drug_alias": aliases, "drug_identifier": identifiers, "regulatory_product_drug": ok.select("regulatory_product_id", "drug_id").distinct()}


def chemical_dictionary(molecules: DataFrame, structures: DataFrame, hierarchy: DataFrame, synonyms: DataFrame, modalities: tuple[str, ...], phase: int = 4) -> DataFrame:
    """Approved molecules under their parents: one row for each, with structure, form and sorted synonyms.

    A molecule without a parent is its own; ``material_form`` tells parents
    (active_moiety) from salts and other forms.
    """
    m = molecules.filter((F.col("max_phase") >= phase) & F.lower("molecule_type").isin(*[x.lower() for x in modalities]))
    parent = molecules.select(F.col("molregno").alias("parent_molregno"), F.col("chembl_id").alias("parent_id"), F.col("pref_name").alias("parent_name"))
    own = m.join(hierarchy.select("molregno", F.col("parent_molregno").alias("p")), "molregno", "left").withColumn("parent_molregno", F.coalesce("p", "molregno")).join(parent, "parent_molregno", "left")
    names = synonyms.groupBy("molregno").agg(F.array_sort(F.collect_set(F.struct("synonyms", "syn_type"))).alias("synonyms"))
    out = own.join(structures, "molregno", "left").join(names, "molregno", "left")
    return out.select(
        F.concat(F.lit("drug:CHEMBL:"), F.coalesce("parent_id", "chembl_id")).alias("drug_id"),
        F.concat(F.lit("compound:CHEMBL:"), "chembl_id").alias("compound_id"),
        F.coalesce("parent_name", "pref_name", "chembl_id").alias("preferred_name"),
        F.lower(F.regexp_replace("molecule_type", " ", "_")).alias("modality"),
        F.when(F.col("molregno") == F.col("parent_molregno"), "active_moiety").otherwise("salt_or_form").alias("material_form"),
        "canonical_smiles",
        "standard_inchi_key",
        F.substring("standard_inchi_key", 1, 14).alias("connectivity_key"),
        F.coalesce("synonyms", F.array()).alias("synonyms"),
    )


def pubchem(rows: DataFrame) -> DataFrame:
    """List export (cid, title, inchi_key, smiles, approved, molecule_type) with outcome and reason; the last of equal (cid, key) counts."""
    approved, kind = F.lower(S.strip(F.coalesce("approved", F.lit("")))), F.lower(S.strip(F.coalesce("molecule_type", F.lit(""))))
    key = F.upper(S.clean(F.col("inchi_key")))
    why = F.coalesce(
        F.when(~approved.isin("", *APPROVED), F.struct(F.lit("excluded").alias("outcome"), F.lit("not_approved").alias("reason"))),
        F.when(~kind.isin("", "small molecule"), F.struct(F.lit("excluded").alias("outcome"), F.lit("not_small_molecule").alias("reason"))),
        F.when(S.clean(F.col("cid")).isNull() | S.clean(F.col("title")).isNull() | key.isNull(), F.struct(F.lit("rejected").alias("outcome"), F.lit("missing_field").alias("reason"))),
        F.when(F.length(key) != 27, F.struct(F.lit("rejected").alias("outcome"), F.lit("invalid_inchi_key").alias("reason"))),
        F.struct(F.lit("accepted").alias("outcome"), F.lit(None).cast("string").alias("reason")),
    )
    return rows.select(why.alias("w"), S.clean(F.col("cid")).alias("cid"), S.clean(F.col("title")).alias("preferred_name"), key.alias("inchi_key"), F.substring(key, 1, 14).alias("connectivity_key"), S.clean(F.col("smiles")).alias("smiles")).select("w.*", "cid", "preferred_name", "inchi_key", "connectivity_key", "smiles")


def ema(rows: DataFrame) -> DataFrame:
    """Medicines (name, substance, product_number, status, category, kind, biologic) with outcome and reason, a row for each active substance."""
    low = lambda c: F.lower(S.strip(F.coalesce(c, F.lit(""))))
    biologic = low("biologic").isin("1", "true", "yes") | low("kind").rlike("biologic|vaccine|cell therapy|gene therapy")
    why = F.when(~low("category").isin("", "human"), "not_human_medicine").when(~low("status").isin("authorised", "authorized"), "not_authorised").when(biologic, "biologic_or_advanced_therapy")
    bad = _missing(name=F.col("name"), active_substance=F.col("substance"))
    return rows.select(F.when(why.isNotNull(), "excluded").when(bad.isNotNull(), "rejected").otherwise("accepted").alias("outcome"), F.coalesce(why, bad).alias("reason"), S.clean(F.col("name")).alias("trade_name"), S.clean(F.col("product_number")).alias("product_number"), F.explode_outer(S.split_list(F.col("substance"), "[|;]")).alias("substance"))


def unichem(rows: DataFrame) -> DataFrame:
    """Cross-references (name, inchi_key, source_id, source_compound_id, unichem_id) with outcome and reason, a row for each identifier: that of the source, and the register's own where there is one."""
    c = lambda n: S.clean(F.col(n))
    key = F.upper(c("inchi_key"))
    bad = F.when(F.coalesce(*[F.when(c(n).isNull(), True) for n in ("name", "inchi_key", "source_id", "source_compound_id")]), "missing_field").when(F.length(key) != 27, "invalid_inchi_key")
    own = F.struct(F.concat(F.lit("UNICHEM_SOURCE_"), S.namespace(c("source_id"))).alias("namespace"), c("source_compound_id").alias("value"))
    also = F.struct(F.lit("UNICHEM").alias("namespace"), c("unichem_id").alias("value"))
    ids = F.filter(F.array(own, also), lambda x: x["value"].isNotNull())
    return rows.select(F.when(bad.isNotNull(), "rejected").otherwise("accepted").alias("outcome"), bad.alias("reason"), c("name").alias("preferred_name"), key.alias("inchi_key"), F.explode_outer(ids).alias("i")).select("outcome", "reason", "preferred_name", "inchi_key", "i.*")


def large_chemicals(molecules: DataFrame, modalities: dict[str, str]) -> DataFrame:
    """Molecules (chembl_id, molecule_type, parent_id, pref_name, smiles, inchi_key, synonyms array<string>) of the wanted types as catalogue records; other types are an error that names the molecule.

    Synonyms are trimmed, and given once in any case, without the name itself.
    """
    c = F.col
    kind = F.coalesce(*[F.when(c("molecule_type") == k, F.lit(v)) for k, v in modalities.items()], F.raise_error(F.concat(F.lit("no wanted modality: "), F.coalesce("chembl_id", F.lit("null")))).cast("string"))
    parent, name = F.coalesce("parent_id", "chembl_id"), F.coalesce(S.clean(c("pref_name")), c("chembl_id"))
    trimmed = F.filter(F.transform(F.coalesce("synonyms", F.array().cast("array<string>")), S.strip), lambda x: (x != "") & (F.lower(x) != F.lower(name)))
    first = F.filter(trimmed, lambda x, i: F.array_position(F.transform(trimmed, lambda y: F.lower(y)), F.lower(x)) == i + 1)
    form = F.when(c("chembl_id") == parent, "active_moiety").otherwise("salt_or_form")
    return molecules.select(name.alias("preferred_name"), kind.alias("modality"), first.alias("aliases"), parent.alias("chembl_parent"), F.concat(F.lit("chembl-moiety:"), parent).alias("active_moiety_id"), c("chembl_id").alias("compound_id"), "smiles", S.clean(c("inchi_key")).alias("inchi_key"), form.alias("material_form"))


def modality_report(records: DataFrame) -> DataFrame:
    """(modality, n, missing_structures) of large_chemicals."""
    return records.groupBy("modality").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("inchi_key").isNull(), 1)).alias("missing_structures"))


def merge_candidates(rows: DataFrame, links: DataFrame, seq: str, stored: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The four tables after a file of candidates: patent_family, patent_document, patent_family_member, patent_candidate.

    rows as for patent_candidates, with publication_date, title, field_name and
    ``seq`` (their order).  A candidate without a link (drug_id, compound_id) is
    an error.  Families and members that are there stay; title and date of a
    document are those of the last row that has them; of a candidate the name
    of its field and the confidence are those of the last row, and the type of
    its match that of the first.
    """
    stored = stored or {}
    known = links.select("drug_id", "compound_id", F.lit(True).alias("__known")).distinct()
    checked = rows.join(known, ["drug_id", "compound_id"], "left")
    checked = checked.filter(F.when(F.col("__known"), True).otherwise(F.raise_error(F.concat_ws(" ", F.lit("no link of"), "drug_id", "compound_id")).cast("boolean"))).drop("__known")
    more = ["publication_date", "title", "field_name", seq]
    c = patent_candidates(checked, *more)
    family = c.select("family_id", F.lit("surechembl").alias("source"), F.lit(0.9).alias("confidence"), seq)
    document = c.select("publication_number", "country_code", S.clean(F.col("publication_date")).alias("publication_date"), S.clean(F.col("title")).alias("title"), seq)
    member = c.select("family_id", "publication_number", F.lit("member").alias("relationship"), seq)
    candidate = c.select("candidate_id", "drug_id", "compound_id", "publication_number", "match_type", "confidence", "field_name", "review_status", seq)
    keep, last = {"title": merge.NEW_UNLESS_NULL, "publication_date": merge.NEW_UNLESS_NULL}, {"field_name": merge.OVERWRITE, "confidence": merge.OVERWRITE}
    out = {}
    for name, new, key, policies in (("patent_family", family, ["family_id"], {}), ("patent_document", document, ["publication_number"], keep), ("patent_family_member", member, ["family_id", "publication_number"], {}), ("patent_candidate", candidate, ["candidate_id"], last)):
        old = stored.get(name, new.drop(seq).limit(0))
        out[name] = merge.upsert(old, new, key, policies, merge.FROZEN, seq)
    return out


def resolve_identities(records: DataFrame, existing: DataFrame) -> DataFrame:
    """(seq, drug_id, n_existing) of catalogue records: those that share an identifier, directly or in a chain, are one entity.

    records (seq, keys array<string>), existing (drug_id, keys).  Records are
    linked through their keys; a component takes the entity that one of its
    keys has already, else an id from its first record.  ``n_existing`` over 1
    is a conflict for review.
    """
    node = F.concat(F.lit("r:"), F.format_string("%020d", F.col("seq")))
    edges = records.select(node.alias("a"), F.explode("keys").alias("k")).select("a", F.concat(F.lit("z:"), "k").alias("b"))
    owned = existing.select("drug_id", F.explode("keys").alias("k")).select(F.concat(F.lit("z:"), "k").alias("node"), "drug_id")
    label = graph.components(edges, "a", "b")
    owner = label.join(owned, "node").groupBy("component").agg(F.min("drug_id").alias("owner"), F.countDistinct("drug_id").alias("n_existing"))
    own = records.select("seq", node.alias("node")).join(label, "node", "left").withColumn("component", F.coalesce("component", "node")).join(owner, "component", "left")
    return own.select("seq", F.coalesce("owner", S.stable_id("drug", F.col("component"))).alias("drug_id"), F.coalesce("n_existing", F.lit(0)).alias("n_existing"))


def route_identities(records: DataFrame, existing: DataFrame, aliases: DataFrame) -> DataFrame:
    """(seq, drug_id, n_existing, outcome, reason, candidates): resolve_identities, with the records held back that need an existing drug and share no identifier with one.

    records have name and requires_existing_drug too; aliases (drug_id, name).
    Such a record may also join the entity of an earlier record without the
    flag.  Else it is excluded and gets no drug_id; candidates are the drugs
    with its normalised name, among aliases and earlier accepted records.
    """
    flag = F.coalesce("requires_existing_drug", F.lit(False))
    own = resolve_identities(records, existing).join(records.select("seq", S.normalize_name(F.col("name")).alias("name"), flag.alias("flag")), "seq")
    made = own.filter("not flag").groupBy("drug_id").agg(F.min("seq").alias("made"))
    own = own.join(made, "drug_id", "left").withColumn("held", F.col("flag") & (F.col("n_existing") == 0) & (F.col("made").isNull() | (F.col("made") > F.col("seq"))))
    known = aliases.select("drug_id", S.normalize_name(F.col("name")).alias("name"), F.lit(None).cast("long").alias("since")).unionByName(own.filter("not held").select("drug_id", "name", F.col("seq").cast("long").alias("since")))
    known = known.groupBy("name", F.col("drug_id").alias("hit")).agg(F.min(F.coalesce("since", F.lit(-(2**63)))).alias("since"))
    hits = own.filter("held").select("seq", "name").join(known, "name").filter("since < seq").groupBy("seq").agg(F.array_sort(F.collect_set("hit")).alias("candidates"))
    n = F.size("candidates")
    reason = F.when(F.col("held"), F.when(n == 0, "unmatched_existing_drug").when(n == 1, "name_only_match_requires_review").otherwise("ambiguous_name_match"))
    out = own.join(hits, "seq", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    return out.select("seq", F.when(~F.col("held"), F.col("drug_id")).alias("drug_id"), "n_existing", F.when(F.col("held"), "excluded").otherwise("accepted").alias("outcome"), reason.alias("reason"), "candidates")


def patent_candidates(rows: DataFrame, *more: str) -> DataFrame:
    """Candidates (drug_id, compound_id, publication_number, source_compound_id, field_id, match_type, country, family_id) with id, confidence, family and country; an error on an unknown match type."""
    known = F.when(F.col("match_type").isin(*S.CONFIDENCE), F.col("match_type")).otherwise(F.raise_error(F.concat(F.lit("unknown match type: "), F.coalesce("match_type", F.lit("null")))))
    pub = S.publication_compact(F.col("publication_number"))
    return rows.select(
        S.stable_id("candidate", F.col("drug_id"), F.col("compound_id"), pub, F.col("source_compound_id"), F.col("field_id")).alias("candidate_id"),
        "drug_id", "compound_id", pub.alias("publication_number"), known.alias("match_type"), S.confidence(F.col("match_type")).alias("confidence"),
        F.coalesce("country", F.substring(pub, 1, 2)).alias("country_code"), S.family_id(F.col("family_id"), pub).alias("family_id"), F.lit("needs_review").alias("review_status"), *more,
    )


def one_manifest(rows: DataFrame, col: str = "snapshot_manifest_sha256") -> str:
    """The manifest hash that all rows of a file carry; an error if there are several or it is none."""
    found = [r[0] for r in rows.select(col).distinct().limit(2).collect()]
    import re

    if len(found) != 1 or not re.fullmatch("[0-9a-f]{64}", found[0] or ""):
        raise ValueError(f"{col} must be one SHA-256 in all rows")
    return found[0]


# --- whole catalogues ------------------------------------------------------------------------

#: Kinds of drugs that are chemicals, and forms of a material, fixed values.
MODALITIES = ("small_molecule", "inorganic_small_molecule", "polymeric_small_molecule", "oligosaccharide", "oligonucleotide")
FORMS = ("active_moiety", "salt", "solvate", "stereoisomer", "salt_or_form", "unknown")
#: A record of a catalogue.
RECORD = """seq bigint, preferred_name string, modality string, requires_existing_drug boolean, active_moiety_id string,
identifiers map<string, array<string>>, aliases array<struct<value: string, type: string>>,
compound struct<compound_id: string, smiles: string, inchi: string, inchi_key: string, material_form: string, relationship_type: string>,
regulatory_products array<struct<regulatory_product_id: string, jurisdiction: string, application_number: string, product_number: string, trade_name: string, dosage_form: string, route: string, strength: string, approval_date: string, marketing_status: string, applicant: string>>"""
#: The stored tables: columns and, before the bar, the key.
CATALOGUE = {
    "drug_entity": "drug_id string | preferred_name string, active_moiety_id string, modality string, review_status string",
    "drug_alias": "drug_id string, normalized_alias string, alias_type string, source_id string | alias string",
    "drug_identifier": "namespace string, identifier_value string, source_id string | drug_id string",
    "active_moiety": "active_moiety_id string | preferred_name string, structure_key string, structure_source string, review_status string",
    "compound": "compound_id string | preferred_name string, smiles string, inchi string, inchi_key string, connectivity_key string, active_moiety_id string, material_form string, source_id string, review_status string",
    "drug_compound": "drug_id string, compound_id string, relationship_type string | review_status string",
    "regulatory_product": "regulatory_product_id string | jurisdiction string, application_number string, product_number string, trade_name string, dosage_form string, route string, strength string, approval_date string, marketing_status string, applicant string, source_id string, raw_record_json string",
    "regulatory_product_drug": "regulatory_product_id string, drug_id string, relationship_type string |",
    "link_candidate": "candidate_id string | subject_type string, subject_id string, object_type string, object_id string, relationship_type string, score double, method string, model_version string, features_json string",
}
#: What becomes of columns that are met again; all others stay as they were first.
_UPSERTS = {
    "drug_entity": {"modality": merge.OVERWRITE, "active_moiety_id": merge.NEW_UNLESS_NULL, "preferred_name": merge.OLD_UNLESS_NULL},
    "compound": {c: merge.NEW_UNLESS_NULL for c in ("smiles", "inchi", "inchi_key", "connectivity_key")},
    "regulatory_product": {c: merge.NEW_UNLESS_NULL for c in ("trade_name", "approval_date")} | {c: merge.OVERWRITE for c in ("marketing_status", "raw_record_json")},
}
_BEFORE = -(2**63)


def _keys(table: str) -> list[str]:
    return [c.split()[0] for c in CATALOGUE[table].split("|")[0].split(",")]


def _empty(spark, table: str) -> DataFrame:
    return spark.createDataFrame([], CATALOGUE[table].replace("|", ",").rstrip(" ,"))


def _record_errors(r: DataFrame) -> DataFrame:
    """(seq, error): the first fault of a record by itself."""
    c = F.col
    bad_product = F.exists("regulatory_products", lambda p: F.coalesce(p.isNull() | S.clean(p["jurisdiction"]).isNull() | F.coalesce(S.clean(p["application_number"]), S.clean(p["product_number"])).isNull(), F.lit(True)))
    error = S.first_reason(
        ("preferred_name is required", F.coalesce(c("normal"), F.lit("")) == ""),
        ("unsupported chemical modality", ~c("modality").isin(*MODALITIES)),
        ("inchi_key must contain 27 characters", F.length("inchi_key") != 27),
        ("unsupported material_form", c("compound").isNotNull() & ~c("form").isin(*FORMS)),
        ("regulatory product requires jurisdiction and application_number or product_number", bad_product),
    )
    return r.select("seq", error.alias("error")).filter("error is not null")


def _accepted(keys: DataFrame, owned: DataFrame, records: DataFrame) -> DataFrame:
    """(seq) of the records that are taken: those that need no existing drug, and those that share a key with a stored drug or a record that was taken before them.

    A record that is taken makes its keys known from its place on, so the set
    grows by rounds until nothing is added.
    """
    free = records.filter("not flag").select("seq")
    taken = free.unionByName(keys.join(owned, "key", "left_semi").select("seq")).distinct().checkpoint()
    while True:
        since = keys.join(taken, "seq", "left_semi").groupBy("key").agg(F.min("seq").alias("since"))
        more = keys.join(taken, "seq", "left_anti").join(since, "key").filter("since < seq").select("seq").distinct().checkpoint()
        if more.isEmpty():
            return taken
        taken = taken.unionByName(more).checkpoint()


def _drugs(keys: DataFrame, owned: DataFrame, own: DataFrame) -> DataFrame:
    """(seq, drug_id, matched, conflict) of the taken records ``own`` (seq, made: the drug that a record makes if nothing matches).

    Every key leads to the stored drug that has it, or to the first record that
    has it; records point to earlier ones until one has a drug of its own, and
    what is pointed to is shortened by half in every round.
    """
    first = keys.groupBy("key").agg(F.min("seq").alias("first"))
    met = keys.join(first, "key").join(owned, "key", "left").select("seq", F.when(F.col("least").isNull() & (F.col("first") < F.col("seq")), F.col("first")).alias("at"), "least", "greatest").checkpoint()
    to = met.groupBy("seq").agg(F.min("at").alias("at"), F.min("least").alias("least"))
    label = own.join(to, "seq", "left").select("seq", F.coalesce("least", F.when(F.col("at").isNull(), F.col("made"))).alias("drug_id"), F.when(F.col("least").isNull(), F.col("at")).alias("at"), (F.col("least").isNotNull() | F.col("at").isNotNull()).alias("matched")).checkpoint()
    while not label.filter("drug_id is null").isEmpty():
        up = label.select(F.col("seq").alias("at"), F.col("drug_id").alias("up_drug"), F.col("at").alias("up_at"))
        label = label.join(up, "at", "left").select("seq", F.coalesce("drug_id", "up_drug").alias("drug_id"), F.when(F.coalesce("drug_id", "up_drug").isNull(), F.col("up_at")).alias("at"), "matched").checkpoint()
    leads = met.join(label.select(F.col("seq").alias("at"), "drug_id"), "at", "left").groupBy("seq").agg(F.min(F.least("least", "drug_id")).alias("low"), F.max(F.greatest("greatest", "drug_id")).alias("high"))
    return label.join(leads, "seq", "left").select("seq", "drug_id", "matched", F.coalesce(F.col("low") < F.col("high"), F.lit(False)).alias("conflict"))


def ingest_catalogue(records: DataFrame, stored: dict[str, DataFrame], source: str, release: str) -> dict[str, DataFrame]:
    """The CATALOGUE tables after the records of a file, in the order of ``seq``, were merged into the stored ones; ``routes`` has (seq, drug_id, outcome, reason).

    A record is the drug that has one of its identifiers or its structure
    already, in store or by an earlier record; else it makes one, named by its
    CHEMBL id or its name.  One that needs an existing drug and finds none by
    key is held back with a reason, and drugs of its name, those of earlier
    records and their aliases included, become candidates for review.  A drug
    that is made is linked for review with the earliest other drug of its name.
    Whatever is wrong with a record, with what it matches (several drugs) or
    with its name (known with another structure) fails the whole file: a
    ValueError names the first such record, and no table is given.
    """
    spark = records.sparkSession
    shared_folder(spark)
    stored = {t: stored[t] if t in stored else _empty(spark, t) for t in CATALOGUE}
    c, src = F.col, F.lit(source)
    identifiers = F.filter(F.flatten(F.transform(F.map_entries(F.coalesce("identifiers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>")))), lambda e: F.transform(e["value"], lambda v: F.struct(e["key"].alias("namespace"), S.clean(v).alias("value"))))), lambda i: i["value"].isNotNull())
    name = S.strip(c("preferred_name"))
    r = records.withColumns({"name": name, "normal": S.normalize_name(name), "modality": F.coalesce(S.clean(c("modality")), F.lit("small_molecule")), "flag": F.coalesce("requires_existing_drug", F.lit(False)), "ids": identifiers, "inchi_key": S.clean(c("compound.inchi_key")), "form": F.coalesce(S.clean(c("compound.material_form")), F.lit("active_moiety"))})
    r = r.withColumn("chembl", F.get(F.filter("ids", lambda i: i["namespace"] == "CHEMBL"), 0)["value"]).checkpoint()
    if r.isEmpty():
        raise ValueError("the file has no records")
    structure = lambda k: F.concat(F.lit("structure|"), k)
    key_list = F.array_compact(F.array_append(F.transform("ids", lambda i: F.concat(F.lit("id|"), i["namespace"], F.lit("|"), i["value"])), structure(c("inchi_key"))))
    keys = r.select("seq", F.explode(F.array_distinct(key_list)).alias("key")).checkpoint()
    structures = stored["drug_compound"].join(stored["compound"].filter("inchi_key is not null").select("compound_id", "inchi_key"), "compound_id").select("drug_id", "inchi_key")
    facts = stored["drug_identifier"].select(F.concat(F.lit("id|"), "namespace", F.lit("|"), "identifier_value").alias("key"), "drug_id").unionByName(structures.select(structure(c("inchi_key")).alias("key"), "drug_id"))
    owned = facts.join(keys.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("drug_id").alias("least"), F.max("drug_id").alias("greatest")).checkpoint()
    taken = _accepted(keys, owned, r)
    made = S.stable_id("drug", src, F.coalesce(F.concat(F.lit("CHEMBL:"), "chembl"), c("normal")))
    drugs = _drugs(keys.join(taken, "seq", "left_semi"), owned, r.join(taken, "seq", "left_semi").select("seq", made.alias("made"))).checkpoint()
    ok = r.join(drugs.select("seq", "drug_id", "matched"), "seq").checkpoint()

    # names and structures, each known from the record on that brings it
    aliases = ok.select("seq", "drug_id", F.explode(F.concat(F.array(F.struct(c("name").alias("value"), F.lit("preferred_name").alias("type"))), F.coalesce(F.transform("aliases", lambda a: F.struct(a["value"].alias("value"), F.coalesce(a["type"], F.lit("synonym")).alias("type"))), F.array().cast("array<struct<value: string, type: string>>")))).alias("a"))
    aliases = aliases.select("seq", "drug_id", S.strip(c("a.value")).alias("alias"), S.normalize_name(c("a.value")).alias("normal"), c("a.type").alias("alias_type")).filter("normal <> ''").checkpoint()
    known = stored["drug_alias"].select("drug_id", c("normalized_alias").alias("normal"), F.lit(_BEFORE).alias("since")).unionByName(aliases.select("drug_id", "normal", c("seq").alias("since")))
    known = known.join(r.select("normal").distinct(), "normal", "left_semi").groupBy("normal", "drug_id").agg(F.min("since").alias("since")).checkpoint()
    solid = structures.select("drug_id", F.lit(_BEFORE).alias("at")).unionByName(ok.filter("inchi_key is not null").select("drug_id", c("seq").alias("at"))).groupBy("drug_id").agg(F.min("at").alias("at"))
    # a record that matches nothing has a structure that nothing has: any structure under its name is another one
    clash = known.join(solid, "drug_id").groupBy("normal").agg(F.min(F.greatest("since", "at")).alias("from"))
    nameless = ok.filter("not matched and inchi_key is not null and chembl is null").unionByName(r.join(taken, "seq", "left_anti").filter("inchi_key is not null and chembl is null").select(*r.columns, F.lit(None).cast("string").alias("drug_id"), F.lit(False).alias("matched")))
    errors = _record_errors(r).unionByName(drugs.filter("conflict").select("seq", F.lit("its identifiers and structure match several drugs").alias("error")))
    errors = errors.unionByName(nameless.join(clash, "normal").filter(c("from") < c("seq")).select("seq", F.lit("its name is known with another structure").alias("error")))
    if first := errors.orderBy("seq", "error").first():
        raise ValueError(f"record {first.seq}: {first.error}")

    # of each name the two drugs known first tell whether there is none, one or several at a record's place
    two = known.withColumn("n", F.row_number().over(W.partitionBy("normal").orderBy("since", "drug_id"))).filter("n <= 2").groupBy("normal").agg(F.min(F.when(c("n") == 1, F.struct("since", "drug_id"))).alias("a"), F.min(F.when(c("n") == 2, F.struct("since", "drug_id"))).alias("b"))
    held = r.join(taken, "seq", "left_anti").join(two, "normal", "left")
    earlier = lambda side: F.coalesce(c(f"{side}.since") < c("seq"), F.lit(False))
    held = held.select("seq", "normal", "name", F.when(~earlier("a"), "unmatched_existing_drug").when(~earlier("b"), "name_only_match_requires_review").otherwise("ambiguous_name_match").alias("reason")).checkpoint()
    routes = ok.select("seq", "drug_id", F.lit("accepted").alias("outcome"), F.lit(None).cast("string").alias("reason")).unionByName(held.select("seq", F.lit(None).cast("string").alias("drug_id"), F.lit("excluded").alias("outcome"), "reason"))

    link = lambda d, kind, subject, relation, features: d.select("seq", S.stable_id("link-candidate", F.lit(kind), subject, c("object"), F.lit(relation)).alias("candidate_id"), F.lit(kind).alias("subject_type"), subject.alias("subject_id"), F.lit("drug_entity").alias("object_type"), c("object").alias("object_id"), F.lit(relation).alias("relationship_type"), F.lit(0.7).alias("score"), F.lit("normalized_name").alias("method"), F.lit("name-review-v1").alias("model_version"), F.to_json(features).alias("features_json"))
    last = held.groupBy("normal").agg(F.max("seq").alias("seq"), F.min_by("name", "seq").alias("name"))  # a name's candidates are the same for all its records
    of_source = link(last.join(known.withColumnRenamed("drug_id", "object"), "normal").filter("since < seq"), "source_record", S.stable_id("source-record", src, F.lit(release), c("normal")), "possible_drug_identity", F.struct(c("normal").alias("normalized_name"), c("name").alias("preferred_name"), F.lit(release).alias("release"), src.alias("source_id")))
    fresh = ok.filter("not matched").join(two, "normal").withColumn("object", F.when(c("a.drug_id") != c("drug_id"), F.when(earlier("a"), c("a.drug_id"))).otherwise(F.when(earlier("b"), c("b.drug_id")))).filter("object is not null")
    of_drug = link(fresh, "drug_entity", c("drug_id"), "same_active_moiety", F.struct(c("normal").alias("normalized_name"), src.alias("source_id")))

    has = ok.filter("compound is not null").withColumns({"compound_id": F.coalesce(S.clean(c("compound.compound_id")), S.stable_id("compound", F.coalesce("inchi_key", "compound.smiles", "name"))), "moiety": F.coalesce(S.clean(c("active_moiety_id")), S.stable_id("moiety", F.substring(F.coalesce("inchi_key", "normal"), 1, 14)))})
    connectivity, new = F.substring("inchi_key", 1, 14), F.lit("unreviewed").alias("review_status")
    product = ok.select("seq", "drug_id", F.explode("regulatory_products").alias("p"))
    plain = {f: S.clean(c(f"p.{f}")) for f in ("jurisdiction", "application_number", "product_number", "trade_name", "dosage_form", "route", "strength", "approval_date", "applicant")}
    product = product.select("seq", "drug_id", *[v.alias(f) for f, v in plain.items()], F.coalesce(S.clean(c("p.marketing_status")), F.lit("unknown")).alias("marketing_status"), F.coalesce(S.clean(c("p.regulatory_product_id")), S.stable_id("regulatory-product", *[plain[f] for f in ("jurisdiction", "application_number", "product_number")])).alias("regulatory_product_id"), src.alias("source_id"), F.to_json("p").alias("raw_record_json"))
    ids = ok.select("seq", "drug_id", F.explode("ids").alias("i")).select("seq", "drug_id", c("i.namespace").alias("namespace"), c("i.value").alias("identifier_value"), src.alias("source_id"))
    moiety_of = has.select("seq", c("moiety").alias("m"))
    rows = {
        "drug_entity": ok.join(moiety_of, "seq", "left").select("seq", "drug_id", c("name").alias("preferred_name"), c("m").alias("active_moiety_id"), "modality", new),
        "drug_alias": aliases.select("seq", "drug_id", "alias", c("normal").alias("normalized_alias"), "alias_type", src.alias("source_id")),
        "drug_identifier": ids,
        "active_moiety": has.select("seq", c("moiety").alias("active_moiety_id"), c("name").alias("preferred_name"), connectivity.alias("structure_key"), src.alias("structure_source"), new),
        "compound": has.select("seq", "compound_id", c("name").alias("preferred_name"), S.clean(c("compound.smiles")).alias("smiles"), S.clean(c("compound.inchi")).alias("inchi"), "inchi_key", connectivity.alias("connectivity_key"), c("moiety").alias("active_moiety_id"), c("form").alias("material_form"), src.alias("source_id"), new),
        "drug_compound": has.select("seq", "drug_id", "compound_id", F.coalesce(S.clean(c("compound.relationship_type")), F.lit("active_moiety")).alias("relationship_type"), new),
        "regulatory_product": product.drop("drug_id"),
        "regulatory_product_drug": product.select("seq", "regulatory_product_id", "drug_id", F.lit("active_ingredient").alias("relationship_type")),
        "link_candidate": of_source.unionByName(of_drug),
    }
    out = {}
    for table, added in rows.items():
        rest = [x for x in stored[table].columns if x not in _keys(table)]
        if rest:
            out[table] = merge.upsert(stored[table], added, _keys(table), _UPSERTS.get(table, {}), merge.FROZEN, "seq")
        else:
            out[table] = stored[table].unionByName(added.select(stored[table].columns)).distinct()
    return out | {"routes": routes}
