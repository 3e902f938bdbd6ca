"""Queries over ingestion, curation, costing and reports: the operators on inputs made from the star-schema tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions import scalars as S
from attesta.functions import structures
from attesta.functions.session import shared_folder
from attesta.operators import costing, coverage, curation, graph, ingest, matching, review, top
from attesta.plans.evidence import table
from attesta.sources import files

QUERIES: dict = {}
ORACLES: dict = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def text(col: str):
    return F.col(col).cast("string")


def name(prefix: str, col):
    return F.concat(F.lit(prefix), (F.col(col) if isinstance(col, str) else col).cast("string"))


def pick(key, **cases):
    """The value whose number (``k0``, ``k1``, ...) the key is; None for other keys."""
    return F.coalesce(*[F.when(key == int(k[1:]), v) for k, v in cases.items()])


# --- normal forms ----------------------------------------------------------------------------


@query("""WITH t AS (SELECT o_orderkey, regexp_replace(upper(trim(CASE o_orderkey % 8 WHEN 0 THEN 'US/' || o_orderkey || '/A1' WHEN 1 THEN 'us d' || o_orderkey || ' s1' WHEN 2 THEN 'USRE' || o_orderkey || 'E1' WHEN 3 THEN 'US' || o_orderkey || 'A'
 WHEN 4 THEN ' ep--' || o_orderkey || '-b ' WHEN 5 THEN 'WO 2020/' || o_orderkey || ' A1' WHEN 6 THEN '  ' END)), '[\\s/-]+', '-', 'g') AS d FROM orders), c AS (SELECT *, replace(d, '-', '') AS c FROM t)
SELECT o_orderkey, CASE WHEN regexp_matches(d, '^[A-Z]{2}-[A-Z0-9]+-[A-Z][0-9]?$') THEN d WHEN regexp_matches(c, '^[A-Z]{2}[A-Z0-9]+[A-Z][0-9]$') THEN c[1:2] || '-' || c[3:length(c) - 2] || '-' || right(c, 2) END AS dashed FROM c""")
def publication_forms(spark, sf_dir):
    k, n = F.col("o_orderkey") % 8, text("o_orderkey")
    raw = pick(k, k0=F.concat(F.lit("US/"), n, F.lit("/A1")), k1=F.concat(F.lit("us d"), n, F.lit(" s1")), k2=F.concat(F.lit("USRE"), n, F.lit("E1")), k3=F.concat(F.lit("US"), n, F.lit("A")), k4=F.concat(F.lit(" ep--"), n, F.lit("-b ")), k5=F.concat(F.lit("WO 2020/"), n, F.lit(" A1")), k6=F.lit("  "))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.publication_dashed(raw).alias("dashed"))


@query("""SELECT o_orderkey, CASE WHEN t LIKE '%withdraw%' THEN 'withdrawn' WHEN t LIKE '%discont%' OR t = 'discn' THEN 'discontinued' WHEN t LIKE '%tentative%' THEN 'tentative' WHEN t IN ('rx', 'otc') OR t LIKE '%prescription%' OR t LIKE '%over the counter%' THEN 'active' ELSE 'unknown' END AS status
FROM (SELECT o_orderkey, trim(regexp_replace(lower(['Over-the-counter', 'Rx.', 'OTC (human)', '*Discontinued*', 'withdrawn?', 'Tentative-Approval', ' DISCN. ', NULL][1 + o_orderkey % 8]), '[^a-z0-9]+', ' ', 'g')) AS t FROM orders)""")
def marketing_status_forms(spark, sf_dir):
    forms = F.array(*[F.lit(x) for x in ("Over-the-counter", "Rx.", "OTC (human)", "*Discontinued*", "withdrawn?", "Tentative-Approval", " DISCN. ", None)])
    return table(spark, sf_dir, "orders").select("o_orderkey", S.marketing_status(F.element_at(forms, (1 + F.col("o_orderkey") % 8).cast("int"))).alias("status"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(upper(trim(q)), '^[A-Z]{14}-[A-Z]{10}-[A-Z]$') THEN 'inchi_key' WHEN regexp_matches(q, '[=()\\[\\]#]') THEN 'structure' ELSE 'name' END AS kind
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'CC(=O)' || p_name WHEN 1 THEN ' abcdefghijklmn-abcdefghij-' || chr((97 + p_partkey % 26)::INT) ELSE p_name END AS q FROM part)""")
def query_kinds(spark, sf_dir):
    k = F.col("p_partkey")
    q = pick(k % 3, k0=F.concat(F.lit("CC(=O)"), "p_name"), k1=F.concat(F.lit(" abcdefghijklmn-abcdefghij-"), F.char(97 + k % 26)), k2=F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", S.query_kind(q).alias("kind"))


@query("SELECT source, 'surechembl-' || source || CASE WHEN doc_id % 2 = 0 THEN '-large-chemical-delta' ELSE '-ranked-local' END AS release, count(*) AS n, count(*) FILTER (doc_id % 3 <> 0 AND length(substr(text, 11, 30)) > 0) AS quotes_found FROM documents GROUP BY 1, 2")
def release_labels(spark, sf_dir):
    """Documents by release label, and how many of the quotations made from them stand in them."""
    path = F.concat(F.lit("/in/"), "source", F.when(F.col("doc_id") % 2 == 0, "-large-chemical").otherwise(""), F.lit("/candidates.jsonl"))
    quote = F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("\u0001")).otherwise(""), F.substring("text", 11, 30))
    d = table(spark, sf_dir, "documents").select("source", S.release_label(path).alias("release"), S.quote_found(F.col("text"), quote).alias("hit"))
    return d.groupBy("source", "release").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("hit"), 1)).alias("quotes_found"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, c_mktsegment) AS title, nullif(trim(CASE WHEN c_custkey % 2 = 0 THEN '  ' ELSE c_name END), '') AS alias, NULL::VARCHAR AS absent FROM customer")
def header_synonyms(spark, sf_dir):
    row = {"Preferred-Name": F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")), "TITLE": F.col("c_mktsegment"), "compound name ": F.when(F.col("c_custkey") % 2 == 0, "  ").otherwise(F.col("c_name"))}
    return table(spark, sf_dir, "customer").select("c_custkey", S.synonym_value(row, "preferred_name", "title").alias("title"), S.synonym_value(row, "Compound_Name").alias("alias"), S.synonym_value(row, "cid").alias("absent"))


# --- ingestion ---------------------------------------------------------------------------------


def outcomes(df, *more: str):
    return df.groupBy("outcome", "reason", *more).agg(F.count(F.lit(1)).alias("n"))


def key_of(col: str, short):
    return F.upper(F.substring(F.sha2(F.coalesce(F.col(col), F.lit("")), 256), 1, F.when(short, 26).otherwise(27)))


@query("""WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 13 <> 0 THEN p_partkey END AS cid, nullif(trim(p_name), '') AS title, CASE WHEN p_size % 7 = 0 THEN 26 ELSE 27 END AS len, p_size % 5 = 0 AS no, p_brand LIKE '%3' AS protein FROM part)
SELECT outcome, reason, count(*) AS n FROM (SELECT CASE WHEN no OR protein THEN 'excluded' WHEN cid IS NULL OR title IS NULL OR len <> 27 THEN 'rejected' ELSE 'accepted' END AS outcome,
 CASE WHEN no THEN 'not_approved' WHEN protein THEN 'not_small_molecule' WHEN cid IS NULL OR title IS NULL THEN 'missing_field' WHEN len <> 27 THEN 'invalid_inchi_key' END AS reason FROM r) GROUP BY ALL""")
def ingest_pubchem(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(F.when(k % 13 != 0, text("p_partkey")).alias("cid"), F.col("p_name").alias("title"), key_of("p_name", size % 7 == 0).alias("inchi_key"), F.lit("C").alias("smiles"), F.when(size % 5 == 0, "No").when(size % 5 == 1, " Approved ").alias("approved"), F.when(F.col("p_brand").endswith("3"), "Protein").otherwise("Small Molecule").alias("molecule_type"))
    return outcomes(ingest.pubchem(rows))


@query("""WITH r AS (SELECT CASE WHEN c_custkey % 17 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 19 <> 0 THEN c_mktsegment || ' ; ' || c_name || '|' END AS substance, c_nationkey = 3 AS vet, c_acctbal < 0 AS refused, c_mktsegment = 'MACHINERY' OR c_nationkey = 5 AS biologic FROM customer),
o AS (SELECT CASE WHEN vet OR refused OR biologic THEN 'excluded' WHEN name IS NULL OR substance IS NULL THEN 'rejected' ELSE 'accepted' END AS outcome, CASE WHEN vet THEN 'not_human_medicine' WHEN refused THEN 'not_authorised' WHEN biologic THEN 'biologic_or_advanced_therapy'
 WHEN name IS NULL AND substance IS NULL THEN 'missing_name_and_active_substance' WHEN name IS NULL THEN 'missing_name' WHEN substance IS NULL THEN 'missing_active_substance' END AS reason, CASE WHEN substance IS NULL THEN 1 ELSE 2 END AS rows_ FROM r)
SELECT outcome, reason, sum(rows_)::BIGINT AS n FROM o GROUP BY ALL""")
def ingest_ema(spark, sf_dir):
    c, k = F.col, F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        F.when(k % 17 != 0, c("c_name")).alias("name"), F.when(k % 19 != 0, F.concat("c_mktsegment", F.lit(" ; "), "c_name", F.lit("|"))).alias("substance"), text("c_custkey").alias("product_number"), F.when(c("c_acctbal") < 0, "Refused").otherwise("Authorised ").alias("status"),
        F.when(c("c_nationkey") == 3, "Veterinary").when(c("c_nationkey") != 4, "Human").alias("category"), F.when(c("c_mktsegment") == "MACHINERY", "Vaccine product").alias("kind"), F.when(c("c_nationkey") == 5, "Yes").alias("biologic"),
    )
    return outcomes(ingest.ema(rows))


@query("""WITH r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 9 <> 0 THEN s_name END AS name, CASE WHEN s_suppkey % 7 = 0 THEN 26 ELSE 27 END AS len, 'UNICHEM_SOURCE_SRC_' || s_nationkey AS ns, s_suppkey % 2 = 0 AS own FROM supplier),
i AS (SELECT *, ns AS namespace FROM r UNION ALL SELECT *, 'UNICHEM' FROM r WHERE own)
SELECT CASE WHEN name IS NULL OR len <> 27 THEN 'rejected' ELSE 'accepted' END AS outcome, CASE WHEN name IS NULL THEN 'missing_field' WHEN len <> 27 THEN 'invalid_inchi_key' END AS reason, namespace, count(*) AS n FROM i GROUP BY ALL""")
def ingest_unichem(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.when(k % 9 != 0, F.col("s_name")).alias("name"), key_of("s_name", k % 7 == 0).alias("inchi_key"), name("src-", "s_nationkey").alias("source_id"), text("s_suppkey").alias("source_compound_id"), F.when(k % 2 == 0, name("U", "s_suppkey")).alias("unichem_id"))
    return outcomes(ingest.unichem(rows), "namespace")


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN lpad(o_orderkey::VARCHAR, greatest(6, length(o_orderkey::VARCHAR))::INT, '0') END AS app, [NULL, ['A', 'B'], ['A'], ['C']][1 + o_orderkey % 4] AS ing, o_orderstatus FROM orders),
o AS (SELECT concat_ws('_and_', CASE WHEN app IS NULL THEN 'application_number' END, CASE WHEN ing IS NULL THEN 'active_ingredient' END) AS m, CASE WHEN app IS NULL THEN 'unknown' WHEN o_orderstatus = 'F' THEN 'active' WHEN o_orderstatus = 'O' THEN 'discontinued' ELSE 'unknown' END AS marketing_status, unnest(coalesce(ing, [NULL])) AS ingredient FROM r)
SELECT CASE WHEN m = '' THEN 'accepted' ELSE 'rejected' END AS outcome, CASE WHEN m <> '' THEN 'missing_' || m END AS reason, marketing_status, ingredient, count(*) AS n FROM o GROUP BY ALL""")
def ingest_products(spark, sf_dir):
    """Regulatory products with their states joined by padded numbers."""
    k = F.col("o_orderkey")
    app, prod = F.when(k % 11 == 0, "  ").otherwise(text("o_orderkey")), (k % 7).cast("string")
    o = table(spark, sf_dir, "orders")
    products = o.select(app.alias("application_number"), prod.alias("product_number"), F.col("o_orderpriority").alias("trade_name"), pick(k % 4, k0=F.lit(" ; "), k1=F.lit("A; B"), k2=F.lit("A"), k3=F.lit(" C ;")).alias("ingredient"), F.lit("TABLET; ORAL").alias("form_route"), F.lit("5MG").alias("strength"))
    products = products.withColumn("ingredient", F.when(F.col("ingredient") != " ; ", F.col("ingredient")))
    statuses = o.select(app.alias("application_number"), prod.alias("product_number"), F.col("o_orderstatus").alias("status_id"))
    lookup = spark.createDataFrame([("F", "Prescription"), ("O", "Discontinued")], "status_id string, description string")
    return outcomes(ingest.regulatory_products(products, statuses, lookup), "marketing_status", "ingredient")


_ROUTING = """WITH r AS (SELECT c_custkey AS seq, c_custkey // 2 AS j, 'seg ' || (c_custkey % 60) AS name, c_custkey % 3 = 0 AS flag, (c_custkey // 2) % 5 = 0 AS owned FROM customer),
m AS (SELECT *, min(CASE WHEN NOT flag THEN seq END) OVER (PARTITION BY j) AS made, CASE WHEN owned THEN 'd' || j ELSE 'drug:' || substr(sha256('r:' || lpad(min(seq) OVER (PARTITION BY j)::VARCHAR, 20, '0')), 1, 24) END AS drug FROM r),
h AS (SELECT *, flag AND NOT owned AND (made IS NULL OR made > seq) AS held FROM m),
k AS (SELECT DISTINCT 'd' || j AS hit, 'seg ' || (j % 60) AS name, -1 AS since FROM r WHERE owned UNION ALL SELECT drug, name, seq FROM h WHERE NOT held),
c AS (SELECT h.seq, count(DISTINCT hit) AS n FROM h JOIN k ON h.held AND k.name = h.name AND k.since < h.seq GROUP BY h.seq)
SELECT h.seq, CASE WHEN NOT held THEN drug END AS drug_id, owned::BIGINT AS n_existing, CASE WHEN held THEN 'excluded' ELSE 'accepted' END AS outcome, CASE WHEN held THEN CASE coalesce(n, 0) WHEN 0 THEN 'unmatched_existing_drug' WHEN 1 THEN 'name_only_match_requires_review' ELSE 'ambiguous_name_match' END END AS reason, coalesce(n, 0)::INT AS n_candidates FROM h LEFT JOIN c ON c.seq = h.seq"""


@query(_ROUTING)
def catalogue_routing(spark, sf_dir):
    """Records of a catalogue: those that share an identifier are one entity, and those that need an existing one are held back without it."""
    k = F.col("c_custkey")
    j = F.floor(k / 2)
    c = table(spark, sf_dir, "customer")
    records = c.select(k.alias("seq"), F.array(name("k", j)).alias("keys"), name("seg ", k % 60).alias("name"), (k % 3 == 0).alias("requires_existing_drug"))
    owned = c.select(j.alias("j")).distinct().filter("j % 5 = 0")
    existing = owned.select(name("d", "j").alias("drug_id"), F.array(name("k", "j")).alias("keys"))
    aliases = owned.select(name("d", "j").alias("drug_id"), name("Seg-", F.col("j") % 60).alias("name"))
    return ingest.route_identities(records, existing, aliases).select("seq", "drug_id", "n_existing", "outcome", "reason", F.size("candidates").alias("n_candidates"))


@query("""WITH r AS (SELECT c_custkey AS seq, c_custkey // 2 AS j, 'seg ' || (c_custkey % 60) AS name, c_custkey % 3 = 0 AS flag, (c_custkey // 2) % 5 = 0 AS owned FROM customer),
m AS (SELECT *, min(CASE WHEN NOT flag THEN seq END) OVER (PARTITION BY j) AS made FROM r), a AS (SELECT *, coalesce(owned OR NOT flag OR made < seq, FALSE) AS ok FROM m),
d AS (SELECT *, CASE WHEN owned THEN 'd' || j ELSE 'drug:' || substr(sha256('src|seg ' || (made % 60)), 1, 24) END AS drug, NOT owned AND seq = made AS fresh FROM a WHERE ok),
o AS (SELECT DISTINCT 'd' || j AS drug, 'seg ' || (j % 60) AS name FROM r WHERE owned),
k AS (SELECT name, drug, min(since) AS since FROM (SELECT name, drug, -1 AS since FROM o UNION ALL SELECT name, drug, seq FROM d) GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY since, drug) AS n FROM k),
f AS (SELECT DISTINCT d.drug, CASE WHEN x.drug <> d.drug THEN CASE WHEN x.since < d.seq THEN x.drug END WHEN y.since < d.seq THEN y.drug END AS object FROM d JOIN t x ON x.name = d.name AND x.n = 1 LEFT JOIN t y ON y.name = d.name AND y.n = 2 WHERE d.fresh),
l AS (SELECT DISTINCT a.name, k.drug FROM a JOIN k ON k.name = a.name AND k.since < a.seq WHERE NOT ok),
u AS (SELECT drug, 1 AS alias, 0 AS ids, 0 AS held, 0 AS linked FROM (SELECT DISTINCT drug, name FROM d) UNION ALL SELECT drug, 1, 1, 0, 0 FROM o UNION ALL SELECT drug, 0, 1, 0, 0 FROM (SELECT DISTINCT drug, j FROM d) UNION ALL SELECT drug, 0, 0, 1, 0 FROM l UNION ALL SELECT drug, 0, 0, 0, 1 FROM f WHERE object IS NOT NULL)
SELECT drug AS drug_id, sum(alias)::BIGINT AS n_aliases, sum(ids)::BIGINT AS n_identifiers, sum(held)::BIGINT AS n_candidate_for, sum(linked)::BIGINT AS n_links FROM u GROUP BY drug""")
def catalogue_tables(spark, sf_dir):
    """A whole catalogue merged into the stored tables: names, identifiers and review links of every drug."""
    k = F.col("c_custkey")
    j = F.floor(k / 2)
    c = table(spark, sf_dir, "customer")
    own = lambda d, key: F.create_map(F.lit("K"), F.array(key.cast("string")))
    records = c.select(k.alias("seq"), name("Seg-", k % 60).alias("preferred_name"), F.lit(None).cast("string").alias("modality"), (k % 3 == 0).alias("requires_existing_drug"), F.lit(None).cast("string").alias("active_moiety_id"), own(c, j).alias("identifiers"))
    fields = {f.name: f.dataType for f in spark.createDataFrame([], ingest.RECORD).schema.fields}
    records = records.select(*[F.col(f) if f in records.columns else F.lit(None).cast(t).alias(f) for f, t in fields.items()])
    d = c.select(j.alias("j")).distinct().filter("j % 5 = 0").select(name("d", "j").alias("drug_id"), "j", name("seg ", F.col("j") % 60).alias("normal"))
    new, old = F.lit("unreviewed").alias("review_status"), F.lit("old").alias("source_id")
    stored = {
        "drug_entity": d.select("drug_id", F.col("normal").alias("preferred_name"), F.lit(None).cast("string").alias("active_moiety_id"), F.lit("small_molecule").alias("modality"), new),
        "drug_alias": d.select("drug_id", F.col("normal").alias("normalized_alias"), F.lit("preferred_name").alias("alias_type"), old, F.col("normal").alias("alias")),
        "drug_identifier": d.select(F.lit("K").alias("namespace"), text("j").alias("identifier_value"), old, "drug_id"),
    }
    out = ingest.ingest_catalogue(records, stored, "src", "1")
    count = lambda t, by, kind, n: out[t].filter(kind).groupBy(F.col(by).alias("drug_id")).agg(F.count(F.lit(1)).alias(n))
    parts = [count("drug_alias", "drug_id", F.lit(True), "n_aliases"), count("drug_identifier", "drug_id", F.lit(True), "n_identifiers"), count("link_candidate", "object_id", F.col("subject_type") == "source_record", "n_candidate_for"), count("link_candidate", "subject_id", F.col("subject_type") == "drug_entity", "n_links")]
    found = out["drug_entity"].select("drug_id")
    for p in parts:
        found = found.join(p, "drug_id", "left")
    return found.na.fill(0)


@query("WITH k AS (SELECT DISTINCT p_type, p_brand FROM part WHERE p_retailprice > 905 AND p_size > 20), n AS (SELECT p_type, count(*) AS known_keys FROM k GROUP BY 1) SELECT p_partkey AS seq, known_keys::INT AS known_keys FROM part JOIN n USING (p_type) WHERE p_size > 1 AND NOT EXISTS (SELECT 1 FROM k WHERE k.p_type = part.p_type AND k.p_brand = part.p_brand)")
def name_structure_conflicts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    known = p.filter("p_retailprice > 905 and p_size > 20").select(F.col("p_partkey").alias("drug_id"), F.concat(F.lower("p_type"), F.lit(" .")).alias("name"), F.col("p_brand").alias("inchi_key"))
    records = p.select(F.col("p_partkey").alias("seq"), F.col("p_type").alias("name"), F.when(F.col("p_size") > 1, F.col("p_brand")).alias("inchi_key"))
    return matching.structure_conflicts(records, known.select("drug_id", "name"), known.select("drug_id", "inchi_key"))


def candidate_tables(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        name("d", F.col("o_custkey") % 50).alias("drug_id"), name("c", F.col("o_custkey") % 7).alias("compound_id"), F.concat(F.lit(" us "), (k % 90).cast("string"), F.lit("a1")).alias("publication_number"), (F.col("o_custkey") % 3).cast("string").alias("source_compound_id"), (k % 2).cast("string").alias("field_id"),
        F.when(F.col("o_orderstatus") == "F", "exact_structure").otherwise("same_connectivity").alias("match_type"), F.lit(None).cast("string").alias("country"), F.when(k % 3 == 0, "-1").otherwise((k % 90).cast("string")).alias("family_id"),
        F.when(k % 4 != 0, text("o_orderpriority")).alias("title"), F.when(k % 5 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("publication_date"), F.col("o_orderpriority").alias("field_name"), k.alias("seq"),
    )
    return ingest.merge_candidates(rows, rows.select("drug_id", "compound_id"), "seq")


_CANDIDATES = """WITH r AS (SELECT o_orderkey AS seq, 'd' || (o_custkey % 50) AS drug_id, 'c' || (o_custkey % 7) AS compound_id, 'US' || (o_orderkey % 90) || 'A1' AS pub, (o_custkey % 3)::VARCHAR AS src, (o_orderkey % 2)::VARCHAR AS field, CASE o_orderstatus WHEN 'F' THEN 'exact_structure' ELSE 'same_connectivity' END AS match_type,
 CASE WHEN o_orderkey % 3 = 0 THEN 'surechembl-publication:US' || (o_orderkey % 90) || 'A1' ELSE 'surechembl:' || (o_orderkey % 90) END AS family_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS title, CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date, o_orderpriority AS field_name FROM orders)"""


@query(_CANDIDATES + """ SELECT 'candidate:' || substr(sha256(concat_ws('|', drug_id, compound_id, pub, src, field)), 1, 24) AS candidate_id, arg_min(match_type, seq) AS match_type, CASE arg_max(match_type, seq) WHEN 'exact_structure' THEN 0.98 ELSE 0.85 END::DOUBLE AS confidence, arg_max(field_name, seq) AS field_name FROM r GROUP BY drug_id, compound_id, pub, src, field""")
def candidate_merge(spark, sf_dir):
    return candidate_tables(spark, sf_dir)["patent_candidate"].select("candidate_id", "match_type", "confidence", "field_name")


@query(_CANDIDATES + " SELECT pub AS publication_number, 'US' AS country_code, arg_max(title, seq) FILTER (title IS NOT NULL) AS title, arg_max(date, seq) FILTER (date IS NOT NULL) AS publication_date, count(DISTINCT family_id) AS n_families FROM r GROUP BY pub")
def candidate_documents(spark, sf_dir):
    t = candidate_tables(spark, sf_dir)
    members = t["patent_family_member"].join(t["patent_family"].select("family_id"), "family_id").groupBy("publication_number").agg(F.count(F.lit(1)).alias("n_families"))
    return t["patent_document"].select("publication_number", "country_code", "title", "publication_date").join(members, "publication_number")


_MOLECULES = "WITH m AS (SELECT p_partkey AS k, 'C' || p_partkey AS chembl_id, nullif(p_name, '') AS pref_name, p_size % 5 AS phase, CASE p_size % 3 WHEN 0 THEN 'Protein' WHEN 1 THEN 'Small molecule' ELSE 'Cell' END AS kind, CASE WHEN p_partkey % 4 = 0 THEN p_partkey - 1 ELSE p_partkey END AS parent FROM part)"


@query(_MOLECULES + """ SELECT 'drug:CHEMBL:' || coalesce(p.chembl_id, m.chembl_id) AS drug_id, 'compound:CHEMBL:' || m.chembl_id AS compound_id, coalesce(p.pref_name, m.pref_name, m.chembl_id) AS preferred_name, lower(replace(m.kind, ' ', '_')) AS modality, CASE WHEN m.k = m.parent THEN 'active_moiety' ELSE 'salt_or_form' END AS material_form, CASE WHEN m.k % 3 <> 0 THEN 2 ELSE 0 END AS n_synonyms
FROM m LEFT JOIN m p ON p.k = m.parent WHERE m.phase >= 4 AND m.kind IN ('Small molecule', 'Protein')""")
def dictionary_export(spark, sf_dir):
    """Approved molecules of a chemical dictionary under their parents."""
    k, size = F.col("p_partkey"), F.col("p_size")
    p = table(spark, sf_dir, "part")
    molecules = p.select(k.alias("molregno"), name("C", "p_partkey").alias("chembl_id"), F.nullif("p_name", F.lit("")).alias("pref_name"), (size % 5).alias("max_phase"), pick(size % 3, k0=F.lit("Protein"), k1=F.lit("Small molecule"), k2=F.lit("Cell")).alias("molecule_type"))
    structures = p.select(k.alias("molregno"), F.lit("C").alias("canonical_smiles"), key_of("p_name", F.lit(False)).alias("standard_inchi_key"))
    hierarchy = p.filter(k % 4 == 0).select(k.alias("molregno"), (k - 1).alias("parent_molregno"))
    synonyms = p.filter(k % 3 != 0).select(k.alias("molregno"), F.explode(F.array("p_type", "p_type", "p_brand")).alias("synonyms"), F.lit("TRADE_NAME").alias("syn_type"))
    out = ingest.chemical_dictionary(molecules, structures, hierarchy, synonyms, ("Small Molecule", "Protein"))
    return out.select("drug_id", "compound_id", "preferred_name", "modality", "material_form", F.size("synonyms").alias("n_synonyms"))


@query("""WITH r AS (SELECT p_partkey, CASE p_size % 2 WHEN 0 THEN 'protein' ELSE 'antibody' END AS modality, coalesce(nullif(p_name, ''), 'C' || p_partkey) AS preferred_name, CASE WHEN p_size % 5 <> 0 THEN p_name END AS key, CASE WHEN p_size % 3 = 0 THEN 'salt_or_form' ELSE 'active_moiety' END AS form, lower(p_type) <> lower(coalesce(nullif(p_name, ''), 'C' || p_partkey)) AS named FROM part)
SELECT modality, form AS material_form, count(*) AS n, count(*) FILTER (key IS NULL) AS missing_structures, sum(named::INT)::BIGINT AS n_aliases FROM r GROUP BY ALL""")
def large_chemicals(spark, sf_dir):
    """Large molecules as catalogue records: by modality and form, those without a structure, and aliases."""
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        name("C", "p_partkey").alias("chembl_id"), F.when(size % 2 == 0, "Protein").otherwise("Antibody").alias("molecule_type"), F.when(size % 3 == 0, name("C", k - 1)).alias("parent_id"), F.col("p_name").alias("pref_name"), F.lit(None).cast("string").alias("smiles"),
        F.when(size % 5 != 0, F.col("p_name")).alias("inchi_key"), F.array(F.col("p_type"), F.concat(F.lit(" "), "p_type", F.lit(" ")), F.upper("p_type"), F.col("p_name"), F.lit("")).alias("synonyms"),
    )
    out = ingest.large_chemicals(rows, {"Protein": "protein", "Antibody": "antibody"})
    return out.groupBy("modality", "material_form").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("inchi_key").isNull(), 1)).alias("missing_structures"), F.sum(F.size("aliases")).alias("n_aliases"))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def resume_fetch(spark, sf_dir):
    """Keys that an interrupted fetch has still to bring."""
    done = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return files.unfetched(table(spark, sf_dir, "orders"), done, "o_custkey")


# --- curation ------------------------------------------------------------------------------------


def curated(spark, sf_dir):
    """An example for each document; nine of ten have one fault."""
    k, c = F.col("doc_id") % 10, F.col
    span = name("text ", "doc_id")
    n = lambda *pairs: F.struct(*[v.alias(a) for a, v in pairs])
    none, one = F.lit(None).cast("string"), F.lit(1.0)
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.select(
        F.lit("1.0.0").alias("schema_version"), name("e", "doc_id").alias("example_id"), F.lit(False).alias("is_synthetic"),
        n(("publication_number", F.when(k == 1, "bad").otherwise(F.concat(F.lit("US-D"), (c("doc_id") % 50).cast("string"), F.lit("-S1")))), ("family_id", F.when(k != 2, name("f", c("doc_id") % 25)).otherwise(" ")), ("publication_date", F.when(k == 2, "2024-13-01").otherwise("2024-02-29")), ("title", F.lit("title"))).alias("patent"),
        n(("compound_id", name("c", c("doc_id") % 20)), ("preferred_name", F.lit("name")), ("active_moiety_id", name("m", c("doc_id") % 5)), ("active_moiety_name", F.lit("moiety")), ("material_form", F.lit("active_moiety")), ("inchi_key", none), ("connectivity_key", none)).alias("compound"),
        n(("route_id", name("r", F.floor(c("doc_id") / 2))), ("step_id", name("s", "doc_id")), ("step_order", F.lit(1).cast("bigint")), ("transformation_key", F.lit("t")), ("operation_summary", F.lit("o"))).alias("route"),
        n(("source_id", F.lit("src")), ("source_artifact_sha256", F.when(k == 3, "xyz").otherwise(F.sha2(F.lit("a"), 256))), ("paragraph_id", F.when(k == 9, "\t").otherwise("p")), ("section_type", F.lit("s")), ("char_start", F.lit(5).cast("bigint")), ("char_end", F.when(k == 5, 4).otherwise(9).cast("bigint")), ("text", span), ("span_sha256", F.sha2(F.when(k == 4, "other").otherwise(span), 256)), ("status", F.when(k == 6, "rumoured").otherwise("performed")), ("extraction_method", F.lit("m")), ("extractor_version", F.lit("1")), ("retrieved_at", F.when(c("doc_id") % 7 == 0, "2024").otherwise("2024-02-29T10:00:00Z")), ("license", F.lit("l")), ("redistribution_class", F.lit("r"))).alias("evidence"),
        F.array(n(("kind", F.when(c("doc_id") % 11 == 0, " ").otherwise("product_mass")), ("value", F.lit(5.0)), ("unit", F.lit("g")), ("confidence", one)), n(("kind", F.lit("input_mass")), ("value", F.lit(7.0)), ("unit", F.lit("kg")), ("confidence", one))).alias("quantities"),
        n(("yield_percent", F.when(k == 8, 120.0).otherwise(80.0)), ("purity_percent", F.lit(99.0)), ("outcome_type", F.lit("reported")), ("confidence", one)).alias("outcome"),
        n(("scale_band", F.when(k == 7, "kilo_lab").otherwise("laboratory")), ("development_stage", F.lit("unknown")), ("development_stage_basis", none), ("confidence", one)).alias("labels"),
        n(("match_type", F.lit("exact_structure")), ("confidence", one)).alias("linkage"),
        n(("status", F.lit("needs_review")), ("reviewer_id", F.lit("x")), ("reviewed_at", F.lit("2024-03-01")), ("rationale", F.lit("y"))).alias("review"),
    )


@query("""WITH d AS (SELECT doc_id, doc_id % 10 AS k FROM documents)
SELECT code, path, severity, count(*) AS n, min('e' || doc_id) AS first_example FROM (SELECT doc_id, 'error' AS severity, ['patent_number', 'date', 'sha256', 'span_hash_mismatch', 'offset', 'evidence_status', NULL, 'yield', 'required'][k] AS code, ['patent.publication_number', 'patent.publication_date', 'evidence.source_artifact_sha256', 'evidence.span_sha256', 'evidence.char_end', 'evidence.status', NULL, 'outcome.yield_percent', 'evidence.paragraph_id'][k] AS path FROM d WHERE k NOT IN (0, 7)
UNION ALL SELECT doc_id, 'error', 'required', 'patent.family_id' FROM d WHERE k = 2 UNION ALL SELECT doc_id, 'error', 'date', 'evidence.retrieved_at' FROM d WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id, 'error', 'required', 'quantities[0].kind' FROM d WHERE doc_id % 11 = 0
UNION ALL SELECT doc_id, 'error', 'scale_mismatch', 'labels.scale_band' FROM d WHERE (k = 7) <> (doc_id % 11 = 0)) GROUP BY ALL""")
def example_issues(spark, sf_dir):
    sources = spark.createDataFrame([("src",)], "source_id string")
    return curation.validation_issues(curated(spark, sf_dir), sources).groupBy("code", "path", "severity").agg(F.count(F.lit(1)).alias("n"), F.min("example_id").alias("first_example"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'bad' ELSE 'US-D' || (doc_id % 50) || '-S1' END AS pub, doc_id % 10 AS k FROM documents)
SELECT 'patent_document' AS table_name, count(*) AS n_rows FROM (SELECT DISTINCT pub, k = 2, k = 9 FROM d) UNION ALL SELECT 'patent_family_member', count(*) FROM (SELECT DISTINCT doc_id % 25, pub FROM d WHERE k <> 2) UNION ALL SELECT 'active_moiety', count(DISTINCT doc_id % 5) FROM d UNION ALL SELECT 'compound', count(DISTINCT doc_id % 20) FROM d
UNION ALL SELECT 'evidence_span', count(*) FILTER (k <> 4) + count(DISTINCT CASE WHEN k = 4 THEN pub END) FROM d UNION ALL SELECT 'process_route', count(*) FROM (SELECT DISTINCT doc_id // 2, doc_id % 5, doc_id % 20 FROM d) UNION ALL SELECT 'process_step', count(*) FROM d UNION ALL SELECT 'quantity_observation', 2 * count(*) FROM d UNION ALL SELECT 'outcome_observation', count(*) FROM d UNION ALL SELECT 'scale_label', count(*) FROM d UNION ALL SELECT 'curation_decision', count(*) FROM d
UNION ALL SELECT 'dataset_version', 1 UNION ALL SELECT 'source_release', count(DISTINCT 'src') FROM d UNION ALL SELECT 'artifact', count(DISTINCT k = 3) FROM d UNION ALL SELECT 'patent_family', count(DISTINCT doc_id % 25) FROM d WHERE k <> 2 UNION ALL SELECT 'dataset_example', count(DISTINCT doc_id) FROM d""")
def curation_tables(spark, sf_dir):
    """Rows of each table that the examples of all documents make."""
    return coverage.table_counts(curation.tables(curated(spark, sf_dir)))


@query("SELECT sum(n)::BIGINT AS examples, count(*) FILTER (n = 1 AND bad = 0) AS valid, sum(bad + n - 1)::BIGINT AS issues, count(*) FILTER (n > 1) AS duplicate_ids FROM (SELECT o_custkey, count(*) AS n, coalesce(max(b.bad), 0) AS bad FROM orders LEFT JOIN (SELECT c_custkey, 1 AS bad FROM customer WHERE c_acctbal < 0) b ON c_custkey = o_custkey GROUP BY o_custkey)")
def batch_report(spark, sf_dir):
    examples = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("example_id"))
    issues = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("example_id"))
    return coverage.batch_report(examples, issues)


@query("SELECT count(*) AS input, count(*) FILTER (p_size > 1 AND p_name <> '' AND p_retailprice > 950) AS annotated, count(*) FILTER (p_size = 1 OR p_name = '') AS missing_structure, count(*) FILTER (p_size > 1 AND p_name <> '' AND NOT p_retailprice > 950) AS invalid_structure FROM part")
def annotation_accounting(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("structure", F.when(F.col("p_size") > 1, F.col("p_name")))
    return coverage.annotation_accounting(p, "structure", F.col("p_retailprice") > 950)


_EXPORT = """WITH l AS (SELECT l_orderkey, bool_or(l_linenumber > 1) AND bool_or(l_linenumber = 1) AND bool_and(p_retailprice > 905) AS mapped FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
e AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'step_not_accepted' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'route_not_accepted' WHEN quality = 0 THEN 'evidence_not_accepted' WHEN o_orderkey % 7 = 0 THEN 'reaction_not_accepted' WHEN toxic = 1 THEN 'synthetic_reaction' WHEN NOT coalesce(mapped, false) THEN 'reaction_mapping_incomplete'
 WHEN o_totalprice < 20000 THEN 'missing_mass_basis' WHEN o_orderkey % 11 = 0 THEN 'missing_patent_family' WHEN o_orderdate < '1993-01-01' THEN 'missing_publication_date' WHEN o_orderkey % 13 = 0 THEN 'missing_validated_structure' END AS reason FROM orders LEFT JOIN l ON l_orderkey = o_orderkey LEFT JOIN labels ON doc_id = o_orderkey)"""


def exported(spark, sf_dir):
    c, k = F.col, F.col("o_orderkey")
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_partkey").alias("p_partkey")).join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_partkey")
    participants = line.select("o_orderkey", F.when(c("l_linenumber") == 1, "produced").otherwise("consumed").alias("role"), (c("p_retailprice") > 905).alias("has_structure"))
    o = table(spark, sf_dir, "orders").join(curation.mapped_reactions(participants, "o_orderkey"), "o_orderkey", "left").join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "o_orderkey"), "o_orderkey", "left")
    states = o.select(
        "o_orderkey", F.when(c("o_orderpriority") == "5-LOW", "rejected").otherwise("accepted").alias("step_status"), F.when(c("o_orderpriority") == "4-NOT SPECIFIED", "needs_review").otherwise("accepted").alias("route_status"), F.when(c("quality") == 0, "rejected").otherwise("accepted").alias("evidence_status"), F.when(k % 7 != 0, "accepted").alias("reaction_status"),
        (F.coalesce(c("toxic"), F.lit(0)) == 1).alias("is_synthetic"), c("mapped"), F.when(c("o_totalprice") >= 20000, c("o_totalprice")).alias("basis_g"), F.when(k % 11 != 0, name("f", F.floor(k / 8))).alias("family_id"), F.when(c("o_orderdate") >= "1993-01-01", c("o_orderdate")).alias("publication_date"), (k % 13 != 0).alias("structure"),
        F.when(k % 8 == 0, name("m", F.floor(k / 32))).alias("active_moiety_id"),
    )
    return states.withColumn("reason", curation.export_reason())


@query(_EXPORT + " SELECT coalesce(reason, 'eligible') AS outcome, count(*) AS n FROM e GROUP BY 1")
def training_export(spark, sf_dir):
    return exported(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("eligible")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(_EXPORT + """, g AS (SELECT o_orderkey, CASE WHEN bool_or(o_orderkey % 8 = 0) OVER (PARTITION BY o_orderkey // 8) THEN 'm' || (o_orderkey // 32) ELSE 'f' || (o_orderkey // 8) END AS g FROM e WHERE reason IS NULL),
n AS (SELECT g, 'component:' || substr(sha256(string_agg('reviewed:' || o_orderkey, '|' ORDER BY 'reviewed:' || o_orderkey)), 1, 24) AS leakage_group FROM g GROUP BY g)
SELECT 'reviewed:' || o_orderkey AS example_id, leakage_group, CASE WHEN v < 0.8 THEN 'train' WHEN v < 0.9 THEN 'validation' ELSE 'test' END AS split FROM (SELECT o_orderkey, leakage_group, ('0x' || substr(sha256('data-v1|' || leakage_group), 1, 13))::BIGINT / 4503599627370496.0 AS v FROM g JOIN n USING (g))""")
def training_assignments(spark, sf_dir):
    """Eligible steps with the group of all that share a family or a moiety, directly or in a chain, and its split."""
    ok = exported(spark, sf_dir).filter("reason is null").select(name("reviewed:", "o_orderkey").alias("example_id"), "family_id", "active_moiety_id")
    return curation.assign_splits(ok, "example_id", ["family_id", "active_moiety_id"], "data-v1")


@query(_EXPORT + """, g AS (SELECT o_orderkey, CASE WHEN bool_or(o_orderkey % 8 = 0) OVER (PARTITION BY o_orderkey // 8) THEN 'm' || (o_orderkey // 32) ELSE 'f' || (o_orderkey // 8) END AS g FROM e WHERE reason IS NULL),
n AS (SELECT count(*) AS m, 'component:' || substr(sha256(string_agg('reviewed:' || o_orderkey, '|' ORDER BY 'reviewed:' || o_orderkey)), 1, 24) AS leakage_group FROM g GROUP BY g), v AS (SELECT m, ('0x' || substr(sha256('data-v1|' || leakage_group), 1, 13))::BIGINT / 4503599627370496.0 AS v FROM n)
SELECT 'candidate_steps' AS part, '' AS name, count(*) AS n FROM e UNION ALL SELECT 'eligible_examples', '', count(*) FILTER (reason IS NULL) FROM e UNION ALL SELECT 'excluded', reason, count(*) FROM e WHERE reason IS NOT NULL GROUP BY reason
UNION ALL SELECT 'split', CASE WHEN v < 0.8 THEN 'train' WHEN v < 0.9 THEN 'validation' ELSE 'test' END, sum(m)::BIGINT FROM v GROUP BY 2""")
def training_report(spark, sf_dir):
    """The report of an export: candidates, eligible ones, reasons and splits."""
    steps = exported(spark, sf_dir).select("reason", name("reviewed:", "o_orderkey").alias("example_id"), "family_id", "active_moiety_id")
    report = curation.export_report(steps, curation.assign_splits(steps.filter("reason is null"), "example_id", ["family_id", "active_moiety_id"], "data-v1"))
    both = F.array(*[F.struct(F.lit(p).alias("part"), F.lit("").alias("name"), F.col(p).alias("n")) for p in ("candidate_steps", "eligible_examples")])
    entries = lambda col, p: F.transform(F.map_entries(col), lambda x: F.struct(F.lit(p).alias("part"), x["key"].alias("name"), x["value"].alias("n")))
    return report.select(F.explode(F.concat(both, entries("excluded", "excluded"), entries("split_counts", "split"))).alias("r")).select("r.*")


@query("SELECT doc_id, '{\"a\":{\"x\":null,\"y\":' || doc_id || '},\"b\":[{\"k\":\"' || lang || '\",\"z\":1}],\"c\":null}' AS payload FROM documents")
def canonical_payload(spark, sf_dir):
    """Records as JSON with keys in order on every level."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("string").alias("c"), F.array(F.struct(F.lit(1).alias("z"), F.col("lang").alias("k"))).alias("b"), F.struct(F.col("doc_id").alias("y"), F.lit(None).cast("string").alias("x")).alias("a"))
    return d.select("doc_id", S.canonical_json(d, "c", "b", "a").alias("payload"))


# --- routes and prices -----------------------------------------------------------------------------


@query("""WITH s AS (SELECT l_orderkey AS route, count(*) AS n_steps, CASE WHEN count(*) = count(CASE WHEN l_tax > 0 THEN 1 END) THEN product(1 - l_discount) ELSE 0 END AS y, avg(CASE WHEN l_returnflag <> 'N' AND l_linestatus <> 'O' THEN 1.0 ELSE 0.0 END) AS e, max(l_quantity) AS max_scale_g FROM lineitem GROUP BY 1),
h AS (SELECT l_orderkey AS route, avg(p_size / 50.0) AS h FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand NOT LIKE '%1' GROUP BY 1)
SELECT route, n_steps, round(y::DECIMAL(18, 9), 6) AS cumulative_yield, round(e::DECIMAL(18, 9), 6) AS evidence_share, max_scale_g, round(coalesce(h, 0)::DECIMAL(18, 9), 6) AS severity FROM s LEFT JOIN h USING (route)""")
def step_summaries(spark, sf_dir):
    """Product of yields, share of evidence, scale and average severity of the participations of each route."""
    c = F.col
    # a reaction for each line of an order and number: its participations are the lines
    line = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("route"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("reaction"), F.when(c("l_tax") > 0, 100 * (1 - c("l_discount"))).alias("yield_percent"), F.when(c("l_returnflag") != "N", "US-1-A1").alias("publication"), (c("l_linestatus") == "O").alias("is_synthetic"), c("l_quantity").alias("scale_g"), c("l_partkey").alias("compound"))
    hazards = table(spark, sf_dir, "part").select(c("p_partkey").alias("compound"), (c("p_size") / 50).alias("severity"), F.when(c("p_brand").endswith("1"), "rejected").otherwise("accepted").alias("status"))
    six = lambda n: F.round(c(n).cast("decimal(18,9)"), 6).alias(n)
    return costing.step_summary(line.drop("compound"), line.select("reaction", "compound"), hazards).select("route", "n_steps", six("cumulative_yield"), six("evidence_share"), "max_scale_g", six("severity"))


def requested(spark, sf_dir):
    """Two-step routes to a product for each supplier, priced and evaluated."""
    from attesta.plans.graph_queries import _leaf_tables

    c, k = F.col, F.col("s_suppkey")
    steps, inputs, target, weights = _leaf_tables(spark, sf_dir)
    s = table(spark, sf_dir, "supplier")
    needs = costing.leaf_requirements(steps, inputs, target, weights)
    offers = s.select(name("B", "s_suppkey").alias("compound"), name("q", "s_suppkey").alias("quote_id"), F.lit(1.0).alias("pack_value"), pick(k % 3, k0=F.lit("kg"), k1=F.lit("g"), k2=F.lit("mol")).alias("pack_unit"), (10.0 + k % 7).alias("price"), F.when(k % 2 == 0, "USD").otherwise("EUR").alias("currency"), F.when(k % 11 == 0, "needs_review").otherwise("accepted").alias("status"))
    common = spark.createDataFrame([("C", "q0", 100.0, "g", 2.5, "USD", "accepted"), ("C", "q1", 1.0, "kg", 99.0, "USD", "accepted"), ("C", "q2", 1.0, "kg", 0.1, "JPY", "accepted")], "compound string, quote_id string, pack_value double, pack_unit string, price double, currency string, status string")
    rates = spark.createDataFrame([("2024-01-01", "EUR", "USD", 1.25), ("2023-01-01", "EUR", "USD", 9.0), ("2024-06-01", "EUR", "USD", 7.0)], "rate_date string, base string, quote string, rate double")
    priced = costing.priced_requirements(needs, costing.convert_quotes(offers.unionByName(common), rates, "USD", "2024-05-01"))
    one = s.select(name("r", "s_suppkey").alias("route"), name("1-", "s_suppkey").alias("reaction"), F.lit(80.0).alias("yield_percent"), F.when(k % 4 != 0, "US-1-A1").alias("publication"), F.lit(False).alias("is_synthetic"), F.lit(500.0).alias("scale_g"))
    two = s.select(name("r", "s_suppkey").alias("route"), name("2-", "s_suppkey").alias("reaction"), F.lit(50.0).alias("yield_percent"), F.lit("US-2-A1").alias("publication"), F.lit(False).alias("is_synthetic"), F.lit(100.0).alias("scale_g"))
    takes = lambda p, reaction: s.select(name(reaction, "s_suppkey").alias("reaction"), (name(p, "s_suppkey") if p != "C" else F.lit("C")).alias("compound"))
    participants = takes("A", "1-").unionByName(takes("B", "2-")).unionByName(takes("C", "2-"))
    hazards = s.select(name("B", "s_suppkey").alias("compound"), ((k % 3) / 4).alias("severity"), F.when(k % 6 == 0, "rejected").otherwise("accepted").alias("status")).unionByName(spark.createDataFrame([("C", 0.25, "accepted")], "compound string, severity double, status string"))
    routes = costing.step_summary(one.unionByName(two), participants, hazards).join(priced, "route").withColumn("target_g", F.lit(1000.0))
    return costing.evaluate(routes).join(s.select(name("r", "s_suppkey").alias("route"), "s_nationkey"), "route")


_REQUEST = """WITH b AS (SELECT s_suppkey AS k, s_nationkey, 5.0 / 0.8 / 0.5 * 2 * (s_suppkey % 8 + 1) AS need, CASE s_suppkey % 3 WHEN 0 THEN 1000.0 WHEN 1 THEN 1.0 END AS pack, (10.0 + s_suppkey % 7) * CASE WHEN s_suppkey % 2 = 0 THEN 1.0 ELSE 1.25 END AS price, s_suppkey % 11 <> 0 AS ok FROM supplier),
p AS (SELECT *, 5.0 / 0.8 / 0.5 * 16 AS need_c, CASE WHEN ok AND pack IS NOT NULL THEN round((ceil(need / pack) * price)::DECIMAL(20, 6), 4)::DOUBLE END AS cost_b, CASE WHEN k % 4 = 0 THEN 0.5 ELSE 1.0 END AS ev, CASE WHEN k % 6 = 0 THEN 0.25 ELSE (k % 3 / 4.0 + 0.25) / 2 END AS sev FROM b),
t AS (SELECT *, (need_c + CASE WHEN cost_b IS NOT NULL THEN need ELSE 0 END) / (need + need_c) AS coverage, 5.0 + coalesce(cost_b, 0) AS cost, 100 * (0.25 * 0.4 + 0.15 * (1 - 2 / 12.0) + 0.20 * (1 - sev) + 0.15 + 0.15 * 0.5 + 0.10 * ev) AS f FROM p),
e AS (SELECT *, CASE WHEN coverage >= 0.8 THEN cost END AS actual FROM t), w AS (SELECT *, min(actual) OVER (PARTITION BY s_nationkey) AS lo, max(actual) OVER (PARTITION BY s_nationkey) AS hi FROM e)
SELECT 'r' || k AS route, s_nationkey, CASE WHEN actual IS NULL THEN 'cost_incomplete' ELSE 'cost_complete' END AS tier, round(coverage::DECIMAL(18, 9), 4) AS coverage, round(actual::DECIMAL(18, 6), 4) AS actual_cost, round(CASE WHEN actual IS NULL THEN 100 - f ELSE 0.5 * CASE WHEN hi > lo THEN 100 * (actual - lo) / (hi - lo) ELSE 0 END + 0.5 * (100 - f) END::DECIMAL(18, 9), 4) AS rank_score FROM w"""


@query(_REQUEST)
def route_request(spark, sf_dir):
    """Needs, quotes in one currency as of a day, hazards and yields of routes, evaluated and scored within each nation."""
    out = costing.rank(requested(spark, sf_dir), ["s_nationkey"])
    four = lambda n, kind: F.round(F.col(n).cast(kind), 4).alias(n)
    return out.select("route", "s_nationkey", "tier", four("coverage", "decimal(18,9)"), four("actual_cost", "decimal(18,6)"), four("rank_score", "decimal(18,9)"))


_SIDE = "SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS m, avg(l_tax) AS h, sum(l_extendedprice) / sum(l_quantity) AS c, CASE WHEN count(*) = count(CASE WHEN l_discount > 0 THEN 1 END) THEN product(l_discount) END AS y, min(l_tax) AS t FROM lineitem WHERE l_returnflag = '{}' GROUP BY 1"
_DELTA = "round(({})::DECIMAL(28, 10), 8)"


@query(f"""WITH d AS (SELECT a.t AS t, [{_DELTA.format('b.n - a.n')}, {_DELTA.format('b.m - a.m')}, {_DELTA.format('b.h - a.h')}, {_DELTA.format('b.c - a.c')}, {_DELTA.format('a.y - b.y')}] AS d FROM ({_SIDE.format('A')}) a JOIN ({_SIDE.format('R')}) b USING (l_orderkey)),
v AS (SELECT CASE WHEN t = 0 THEN 'rejected' WHEN t < 0.02 THEN 'needs_validation' ELSE 'eligible' END AS gate, list_sort(list_filter([CASE WHEN d[1] > 0 THEN 'step_count' END, CASE WHEN d[2] > 0 THEN 'process_mass_intensity' END, CASE WHEN d[3] > 0 THEN 'hazard_score' END, CASE WHEN d[4] > 0 THEN 'material_cost_per_kg' END, CASE WHEN d[5] > 0 THEN 'cumulative_yield' END], lambda x: x IS NOT NULL)) AS better,
 list_sort(list_filter([CASE WHEN d[1] < 0 THEN 'step_count' END, CASE WHEN d[2] < 0 THEN 'process_mass_intensity' END, CASE WHEN d[3] < 0 THEN 'hazard_score' END, CASE WHEN d[4] < 0 THEN 'material_cost_per_kg' END, CASE WHEN d[5] < 0 THEN 'cumulative_yield' END], lambda x: x IS NOT NULL)) AS worse FROM d)
SELECT gate, CASE WHEN gate <> 'eligible' THEN 'blocked_validation' WHEN len(better) > 0 AND len(worse) = 0 THEN 'improved' WHEN len(worse) > 0 AND len(better) = 0 THEN 'not_improved' ELSE 'mixed' END AS verdict, array_to_string(better, ',') AS improved_metrics, array_to_string(worse, ',') AS worsened_metrics, count(*) AS n FROM v GROUP BY ALL""")
def route_benchmark(spark, sf_dir):
    """Hypotheses against baselines in all five metrics, with the names of those that are better and worse."""
    line, c = table(spark, sf_dir, "lineitem"), F.col
    whole = F.count(F.lit(1)) == F.count(F.when(c("l_discount") > 0, 1))

    def side(flag, p):
        aggs = {"step_count": F.count(F.lit(1)), "process_mass_intensity": F.sum("l_quantity"), "hazard_score": F.avg("l_tax"), "material_cost_per_kg": F.sum("l_extendedprice") / F.sum("l_quantity"), "yield": F.when(whole, F.product("l_discount")), "t": F.min("l_tax")}
        return line.filter(c("l_returnflag") == flag).groupBy("l_orderkey").agg(*[v.alias(f"{p}_{n}") for n, v in aggs.items()])

    pairs = side("A", "hyp").join(side("R", "base"), "l_orderkey").withColumns({"checks": F.array(c("hyp_t") > 0, F.when(c("hyp_t") >= 0.02, True)), "unsupported": F.lit(0)})
    names = [F.array_join(n, ",").alias(n) for n in ("improved_metrics", "worsened_metrics")]
    return costing.compare(pairs).groupBy("gate", "verdict", *names).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT s_suppkey AS k, s_nationkey AS drug, s_suppkey % 7 AS q, s_acctbal FROM supplier), m AS (SELECT DISTINCT drug, q FROM s)
SELECT n_nationkey AS drug, 'level' AS kind, '0' AS name, 1 AS n FROM nation
UNION ALL SELECT drug, 'level', '1', count(*) + count(DISTINCT q) FROM s GROUP BY drug UNION ALL SELECT drug, 'level', '2', count(*) FROM m WHERE q < 5 GROUP BY drug
UNION ALL SELECT n_nationkey, 'edge', 'active_moiety', 1 FROM nation UNION ALL SELECT drug, 'edge', 'produced', sum(n) FROM (SELECT drug, count(*) AS n FROM s GROUP BY 1 UNION ALL SELECT drug, count(*) FROM m WHERE q < 5 GROUP BY 1) GROUP BY drug
UNION ALL SELECT drug, 'edge', 'consumed', sum(n) FROM (SELECT drug, count(*) AS n FROM s GROUP BY 1 UNION ALL SELECT drug, count(*) FROM m WHERE q < 5 GROUP BY 1) GROUP BY drug UNION ALL SELECT drug, 'edge', 'reagent', count(*) FROM s GROUP BY drug UNION ALL SELECT drug, 'edge', 'supports', count(*) FROM s GROUP BY drug
UNION ALL SELECT drug, 'gap', 'missing_compound_record', count(*) FROM m WHERE q < 5 GROUP BY drug UNION ALL SELECT drug, 'gap', 'structure_or_atom_counts_unavailable', count(*) FROM s WHERE s_acctbal <= 0 GROUP BY drug
UNION ALL SELECT drug, 'gap', 'no_evidence_backed_producing_reaction', sum(n) FROM (SELECT drug, count(*) AS n FROM s GROUP BY 1 UNION ALL SELECT drug, count(*) FROM m WHERE q >= 5 GROUP BY 1 UNION ALL SELECT n_nationkey, 1 FROM nation WHERE n_nationkey NOT IN (SELECT drug FROM s)) GROUP BY drug""")
def evidence_backtrack(spark, sf_dir):
    """Levels, edges and gaps of the making of every nation's product, back to three reactions."""
    c, k = F.col, F.col("s_suppkey")
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    q = spark.range(5).withColumnRenamed("id", "j")
    targets = n.select(c("n_nationkey").alias("drug"), name("M", "n_nationkey").alias("compound"))
    produced = s.select(name("x", "s_suppkey").alias("reaction"), name("M", "s_nationkey").alias("compound")).unionByName(q.select(name("y", "j").alias("reaction"), name("Q", "j").alias("compound")))
    uses = lambda d, r, m, role: d.select(r.alias("reaction"), m.alias("compound"), F.lit(role).alias("role"))
    inputs = uses(s, name("x", "s_suppkey"), name("S", "s_suppkey"), "consumed").unionByName(uses(s, name("x", "s_suppkey"), name("Q", k % 7), "reagent")).unionByName(uses(q, name("y", "j"), name("B", "j"), "consumed"))
    evidence = s.select(name("x", "s_suppkey").alias("reaction"), name("US", k % 11).alias("publication"), F.lit("supports").alias("relationship"))
    compounds = targets.select("compound", F.lit(True).alias("has_structure")).unionByName(s.select(name("S", "s_suppkey").alias("compound"), (c("s_acctbal") > 0).alias("has_structure"))).unionByName(spark.range(7).select(name("Q", "id").alias("compound"), F.lit(True).alias("has_structure")))
    out = graph.evidence_backtrack(targets, produced, inputs, evidence, compounds, 3)
    count = lambda d, kind, col: d.groupBy("drug", F.lit(kind).alias("kind"), text(col).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return count(out["levels"], "level", "level").unionByName(count(out["edges"], "edge", "edge_type")).unionByName(count(out["gaps"], "gap", "reason"))


@query("SELECT DISTINCT o_custkey AS drug, l_orderkey AS reaction, CASE WHEN toxic = 1 THEN 'contradicts' ELSE 'supports' END AS relationship_type, doc_id AS evidence_span, source AS publication FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN documents ON doc_id = l_orderkey LEFT JOIN labels USING (doc_id) WHERE l_linenumber = 1")
def evidence_chain(spark, sf_dir):
    """From each drug by the compounds that a reaction produces to the spans that speak of it."""
    c = F.col
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("compound"), c("o_custkey").alias("drug"))
    participants = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("reaction"), c("l_orderkey").alias("compound"), F.when(c("l_linenumber") == 1, "produced").otherwise("consumed").alias("role"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    links = d.select(c("doc_id").alias("reaction"), F.when(c("toxic") == 1, "contradicts").otherwise("supports").alias("relationship_type"), c("doc_id").alias("evidence_span"))
    spans = d.select(c("doc_id").alias("evidence_span"), c("source").alias("publication"))
    return review.evidence_chain(o, participants, links, spans).select("drug", "reaction", "relationship_type", "evidence_span", "publication")


# --- reports -------------------------------------------------------------------------------------


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def table_counts(spark, sf_dir):
    return coverage.table_counts({t: table(spark, sf_dir, t) for t in TABLES})


@query("SELECT event_id, user_id, event_type, coalesce(CASE WHEN event_type = 'purchase' THEN ts + INTERVAL 36 HOUR END, ts) AS latest FROM events ORDER BY 4 DESC, event_id LIMIT 25")
def recent_jobs(spark, sf_dir):
    """The latest jobs by the time at which they ended, or else began: a page of the status report."""
    e = table(spark, sf_dir, "events").withColumn("ended", F.when(F.col("event_type") == "purchase", F.col("ts") + F.expr("INTERVAL 36 HOURS")))
    return top.recent(e, ["ended", "ts"], "event_id").select("event_id", "user_id", "event_type", "latest")


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END, o_orderkey) AS n FROM orders) WHERE n = 1")
def ranked_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return top.top1(o, ["o_custkey"], [top.ranked("o_orderpriority", "5-LOW", "1-URGENT"), F.col("o_orderkey").asc()])


@query("""WITH s AS (SELECT p_brand AS entity, p_size AS family, p_partkey AS publication, trim(regexp_replace(lower('Process for ' || CASE p_partkey % 3 WHEN 0 THEN 'preparing ' || p_name WHEN 1 THEN p_type || 's' ELSE 'a ' || p_type || '-tablet' END), '[^a-z0-9]+', ' ', 'g')) AS t, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS a, lower(p_type) AS b, p_partkey % 5 AS f, p_partkey % 4 AS c FROM part),
m AS (SELECT *, ((length(a) >= 5 AND contains(' ' || t || ' ', ' ' || a || ' ')) OR (length(b) >= 5 AND contains(' ' || t || ' ', ' ' || b || ' ')))::INT AS tm, contains(t, 'tablet')::INT AS neg, contains(t, 'process')::INT + contains(t, 'prepar')::INT AS rt, CASE f WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS fp, CASE c WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 0 END AS cp FROM s),
o AS (SELECT *, tm * contains(t, 'prepar')::INT AS direct FROM m),
x AS (SELECT *, row_number() OVER (PARTITION BY entity, family ORDER BY tm DESC, direct DESC, neg, rt DESC, fp DESC, cp DESC, publication DESC) AS n FROM o), y AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY tm DESC, direct DESC, neg, rt DESC, fp DESC, cp DESC, publication DESC) AS k FROM x WHERE n = 1)
SELECT entity, family, publication, tm AS title_match, direct, -neg AS negative_hits, rt AS route_hits, fp AS field_priority, cp AS country_priority FROM y WHERE k = 1""")
def pilot_scores(spark, sf_dir):
    """The best candidate of each entity by all parts of the score, aliases as a set."""
    c, k = F.col, F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    title = S.normalize_name(F.concat(F.lit("Process for "), pick(k % 3, k0=F.concat(F.lit("preparing "), "p_name"), k1=F.concat("p_type", F.lit("s")), k2=F.concat(F.lit("a "), "p_type", F.lit("-tablet")))))
    aliases = F.array(S.normalize_name(c("p_name")), S.normalize_name(c("p_type")))
    field = F.coalesce(*[F.when(k % 5 == i, F.lit(v)) for i, v in enumerate(("clms", "description", "ABST", "ttl", "other"))])
    country = F.coalesce(*[F.when(k % 4 == i, F.lit(v)) for i, v in enumerate(("WO", "EP", "US", "JP"))])
    scores = review.queue_scores(title, aliases, ("tablet",), ("process", "prepar"), ("synth", "prepar")) | {"field_priority": review.priority(S.normalize_name(field), review.FIELD_PRIORITY), "country_priority": review.priority(country, review.COUNTRY_PRIORITY)}
    rows = p.select(c("p_brand").alias("entity"), c("p_size").alias("family"), k.alias("publication"), *[v.alias(n) for n, v in scores.items()])
    return review.pilot_queue(rows, "entity", "family", [c(n).desc() for n in (*scores, "publication")]).select("entity", "family", "publication", *scores)


@query("SELECT user_id, status, attempts FROM (SELECT user_id, max_by(event_type, struct_pack(ts := ts, event_id := event_id)) AS status, count(*) FILTER (event_type = 'click') AS attempts FROM events GROUP BY user_id) WHERE status IN ('signup', 'error')")
def job_exception_list(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return review.exceptions(review.job_state(e, ["user_id"], ["ts", "event_id"], "event_type", "click"), ["user_id"], ("signup", "error"))


@query("SELECT o_custkey AS user_id FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT user_id FROM (SELECT user_id, max_by(event_type, struct_pack(ts := ts, event_id := event_id)) AS status FROM events GROUP BY user_id) WHERE status IN ('view', 'click'))")
def jobs_due(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return review.due(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id")), review.job_state(e, ["user_id"], ["ts", "event_id"], "event_type", "click"), ["user_id"], ("view", "click"))


@query("""WITH o AS (SELECT * FROM orders), l AS (SELECT * FROM lineitem JOIN orders ON o_orderkey = l_orderkey), x AS (SELECT c_custkey, 'publications' AS list, (SELECT count(*) FROM o WHERE o_custkey = c_custkey) AS n FROM customer
UNION ALL SELECT c_custkey, 'priorities', (SELECT count(DISTINCT o_orderpriority) FROM o WHERE o_custkey = c_custkey) FROM customer UNION ALL SELECT c_custkey, 'compounds', coalesce(n, 0) FROM customer LEFT JOIN (SELECT o_custkey, count(DISTINCT l_partkey) AS n FROM l GROUP BY 1) ON o_custkey = c_custkey
UNION ALL SELECT c_custkey, 'suppliers', coalesce(n, 0) FROM customer LEFT JOIN (SELECT o_custkey, count(DISTINCT l_suppkey) AS n FROM l GROUP BY 1) ON o_custkey = c_custkey UNION ALL SELECT c_custkey, 'routes', coalesce(n, 0) FROM customer LEFT JOIN (SELECT o_custkey, count(DISTINCT l_returnflag) AS n FROM l GROUP BY 1) ON o_custkey = c_custkey
UNION ALL SELECT c_custkey, 'evidence', coalesce(n, 0) FROM customer LEFT JOIN (SELECT o_custkey, count(DISTINCT doc_id) AS n FROM orders JOIN documents ON doc_id = o_orderkey GROUP BY 1) ON o_custkey = c_custkey) SELECT * FROM x""")
def drug_children(spark, sf_dir):
    """How many members each of the six lists of an entity's page has."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority")
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey", "l_returnflag").join(o.select("o_orderkey", "c_custkey"), "o_orderkey")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("o_orderkey"), "doc_id").join(o, "o_orderkey")
    lists = {"publications": (o, "o_orderkey"), "priorities": (o, "o_orderpriority"), "compounds": (line, "l_partkey"), "suppliers": (line, "l_suppkey"), "routes": (line, "l_returnflag"), "evidence": (docs, "doc_id")}
    return review.child_counts(table(spark, sf_dir, "customer"), "c_custkey", lists)


@query("""WITH o AS (SELECT o_custkey AS c_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_orderkey) AS place FROM orders), l AS (SELECT o_custkey AS c_custkey, l_partkey, l_linenumber, l_returnflag, l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
p AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY l_returnflag, l_orderkey, l_linenumber, l_partkey) AS place FROM l)
SELECT c_custkey, 'patents' AS list, place::INT AS place, '{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}' AS item FROM o JOIN customer USING (c_custkey) WHERE place <= 10 UNION ALL SELECT c_custkey, 'products', place::INT, '{"l_linenumber":' || l_linenumber || ',"l_orderkey":' || l_orderkey || ',"l_partkey":' || l_partkey || ',"l_returnflag":"' || l_returnflag || '"}' FROM p JOIN customer USING (c_custkey) WHERE place <= 50
UNION ALL SELECT c_custkey, 'aliases', row_number() OVER (PARTITION BY c_custkey ORDER BY k, alias)::INT, '{"alias":"' || alias || '","alias_type":"' || k || '"}' FROM (SELECT c_custkey, c_name AS alias, 'preferred_name' AS k FROM customer UNION ALL SELECT c_custkey, c_mktsegment, 'synonym' FROM customer) UNION ALL SELECT c_custkey, 'identifiers', 1, '{"c_nationkey":' || c_nationkey || '}' FROM customer
UNION ALL SELECT c_custkey, 'compounds', row_number() OVER (PARTITION BY c_custkey ORDER BY l_partkey)::INT, '{"l_partkey":' || l_partkey || '}' FROM (SELECT DISTINCT c_custkey, l_partkey FROM l JOIN customer USING (c_custkey)) UNION ALL SELECT o_custkey, 'evidence', row_number() OVER (PARTITION BY o_custkey ORDER BY doc_id)::INT, '{"doc_id":' || doc_id || ',"lang":"' || lang || '"}' FROM orders JOIN documents ON doc_id = o_orderkey JOIN customer ON c_custkey = o_custkey""")
def drug_lists(spark, sf_dir):
    """The six lists of every entity's page, each in its own order, two of them limited."""
    c = F.col
    parents, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    o = orders.select("c_custkey", "o_orderkey", "o_orderpriority")
    line = table(spark, sf_dir, "lineitem").select(c("l_orderkey"), "l_partkey", "l_linenumber", "l_returnflag").join(o.select("c_custkey", c("o_orderkey").alias("l_orderkey")), "l_orderkey")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(o.select("c_custkey", c("o_orderkey").alias("doc_id")), "doc_id")
    kinds = parents.select("c_custkey", c("c_name").alias("alias"), F.lit("preferred_name").alias("alias_type")).unionByName(parents.select("c_custkey", c("c_mktsegment").alias("alias"), F.lit("synonym").alias("alias_type")))
    lists = {
        "patents": (o, [c("o_orderpriority").desc(), c("o_orderkey").asc()], 10), "products": (line, [c("l_returnflag").asc(), c("l_orderkey").asc(), c("l_linenumber").asc(), c("l_partkey").asc()], 50), "aliases": (kinds, [c("alias_type").asc(), c("alias").asc()], None),
        "identifiers": (parents.select("c_custkey", "c_nationkey"), [c("c_nationkey").asc()], None), "compounds": (line.select("c_custkey", "l_partkey").distinct(), [c("l_partkey").asc()], None), "evidence": (docs, [c("doc_id").asc()], None),
    }
    return review.child_lists(parents, "c_custkey", lists)


@query("""WITH d AS (SELECT doc_id, doc_id % 40 AS pub, doc_id // 2 AS route, doc_id % 40 < 10 AS ok FROM documents), r AS (SELECT route, bool_or(ok) AS ok FROM d GROUP BY 1)
SELECT 'evidence_span' AS table_name, CASE WHEN ok THEN 'accepted' ELSE 'unreviewed' END AS state, count(*) AS n FROM d GROUP BY 2 UNION ALL SELECT 'process_step', CASE WHEN ok THEN 'accepted' ELSE 'unreviewed' END, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'reaction_instance', CASE WHEN ok THEN 'accepted' ELSE 'unreviewed' END, count(*) FROM d GROUP BY 2
UNION ALL SELECT 'process_route', CASE WHEN ok THEN 'accepted' ELSE 'unreviewed' END, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'patent_candidate', CASE WHEN pub < 10 THEN 'accepted' ELSE 'needs_review' END, count(*) FROM (SELECT DISTINCT pub FROM d) GROUP BY 2
UNION ALL SELECT 'reaction_participant', 'rows', 2 * count(*) FROM d UNION ALL SELECT 'reaction_condition', 'rows', count(*) FROM d UNION ALL SELECT 'link_candidate', 'rows', count(*) FROM r WHERE ok UNION ALL SELECT 'curation_decision', 'rows', count(*) FROM r WHERE ok""")
def extracted_examples(spark, sf_dir):
    """An example from each document, two of them to a route; ten of forty publications are approved."""
    c = F.col
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    fields = {"example_id": name("e", "doc_id"), "publication_number": name("US", c("doc_id") % 40), "target_compound_id": F.lit("T"), "active_moiety_id": F.lit("m"), "route_id": name("r", F.floor(c("doc_id") / 2)), "step_id": name("s", "doc_id"), "reaction_id": name("x", "doc_id"), "name": F.lit("n"), "paragraph_id": F.lit("p"), "source_url": F.lit("u"), "transformation_key": F.lit("k")}
    part = lambda compound, role: F.struct(F.lit(compound).alias("compound_id"), F.lit(role).alias("role"), F.lit(1.0).alias("stoichiometry"))
    examples = d.select(c("doc_id").alias("seq"), "text", *[v.alias(n) for n, v in fields.items()], F.lit(80.0).alias("yield_percent"), F.lit(100.0).alias("scale_g"), F.lit(0.95).alias("confidence"), F.array(part("a", "consumed"), part("T", "produced")).alias("participants"), F.array(F.struct(F.lit("temperature").alias("condition_type"), F.lit(20.0).alias("numeric_value"), F.lit("degC").alias("unit"))).alias("conditions"))
    first = curation.ingest_extracted(examples)
    stored = curation.ingest_extracted(examples, first) | {"patent_candidate": examples.select("publication_number", F.lit("drug").alias("drug_id"), F.lit("needs_review").alias("review_status")).distinct()}  # a second time nothing is added
    approvals = spark.range(20).select(name("US", "id").alias("publication_number"), F.when(c("id") < 10, "drug").otherwise("other").alias("drug_id"), F.lit("w").alias("reviewer_id"), F.lit("ok").alias("rationale"), F.lit("2024-05-01T00:00:00").alias("decided_at"))
    out = None
    for n, t in curation.approve_publications(stored, approvals).items():
        own = t.groupBy((c("review_status") if "review_status" in t.columns else F.lit("rows")).alias("state")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "state", "n")
        out = own if out is None else out.unionByName(own)
    return out


@query("""WITH f AS (SELECT c_custkey AS drug_id, c_name AS preferred_name FROM customer WHERE (lower(c_name) LIKE '%1_%' OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND lower(o_orderpriority) LIKE '%1_%')) AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) ORDER BY 2, 1 LIMIT 100 OFFSET 10),
o AS (SELECT o_custkey AS drug_id, count(*) AS n, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS s FROM orders GROUP BY 1), l AS (SELECT o_custkey AS drug_id, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
SELECT drug_id, preferred_name, coalesce(l.n, 0) AS compound_count, coalesce(o.n, 0) AS product_count, coalesce(o.s, '') AS marketing_statuses FROM f LEFT JOIN o USING (drug_id) LEFT JOIN l USING (drug_id)""")
def catalogue_request(spark, sf_dir):
    """A page of customers as drugs that have patents, by name or alias."""
    drugs, coverage, aliases, compounds, products = _browsable(spark, sf_dir)
    page = review.catalogue_page(drugs, coverage, aliases, compounds, products, " 1_ ", "patents_found", 100, 10)["items"]
    return page.select("drug_id", "preferred_name", "compound_count", "product_count", F.array_join("marketing_statuses", ",").alias("marketing_statuses"))


def _browsable(spark, sf_dir):
    c = F.col
    o = table(spark, sf_dir, "orders").select(c("o_custkey").alias("drug_id"), "o_orderkey", "o_orderpriority", "o_orderstatus")
    drugs = table(spark, sf_dir, "customer").select(c("c_custkey").alias("drug_id"), c("c_name").alias("preferred_name"))
    found = drugs.select("drug_id").join(o.select("drug_id", F.lit(1).alias("n")).distinct(), "drug_id", "left")
    flags = {s: F.lit(0) for s in review.STEPS} | {"identified": F.lit(1), "patents_found": F.coalesce("n", F.lit(0))}
    coverage = found.select("drug_id", F.when(c("n") == 1, "patents_found").otherwise("identified").alias("status"), *[v.alias(s) for s, v in flags.items()])
    line = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("o_orderkey"), c("l_partkey").alias("compound_id")).join(o.select("o_orderkey", "drug_id"), "o_orderkey").select("drug_id", "compound_id")
    return drugs, coverage, o.select("drug_id", c("o_orderpriority").alias("alias")), line, o.select("drug_id", c("o_orderkey").alias("regulatory_product_id"), c("o_orderstatus").alias("marketing_status"))


@query("""SELECT 'total' AS name, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT 'identified', count(*) FROM customer UNION ALL SELECT 'patents_found', count(*) FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def catalogue_counts(spark, sf_dir):
    """How many fit a filter, and how many of the whole catalogue are on each step."""
    out = review.catalogue_page(*_browsable(spark, sf_dir), status="patents_found")
    steps = out["status_counts"].select(F.explode(F.create_map(*[x for s in review.STEPS for x in (F.lit(s), F.col(s))])).alias("name", "n")).filter("n > 0")
    return out["total"].select(F.lit("total").alias("name"), F.col("total").alias("n")).unionByName(steps)


@query("""WITH p AS (SELECT p_partkey, 'p' || p_partkey AS id, p_name || ' ' || p_partkey AS name, lower(p_type) || ' x' AS alias, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS other FROM part),
q AS (SELECT s_suppkey AS request, s_suppkey % 5 AS k, s_suppkey AS v FROM supplier),
h AS (SELECT request, 1 AS stage, id AS compound_id, 0 AS r FROM q JOIN p ON p_partkey = v WHERE k IN (0, 1) UNION ALL SELECT request, 2, id, other FROM q JOIN p ON alias = 'large x' WHERE k = 2 UNION ALL SELECT request, 3, id, length(name) FROM q JOIN p ON contains(lower(name), 't ' || (v % 10)) WHERE k = 3),
b AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY stage, r, compound_id) AS n FROM h), m AS (SELECT 'p' || l_partkey AS compound_id, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT request, CASE k WHEN 4 THEN 'structure' ELSE 'name' END AS kind, stage, b.compound_id, CASE WHEN b.compound_id IS NOT NULL THEN coalesce(m.n, 0) END AS reviewed_producing_reactions FROM q LEFT JOIN (SELECT * FROM b WHERE n = 1) b USING (request) LEFT JOIN m ON m.compound_id = b.compound_id""")
def target_lookup(spark, sf_dir):
    """Requests of all suppliers: by id, by name, by alias, by a part of a name, and structures that nothing has."""
    c, k = F.col, F.col("s_suppkey")
    p = table(spark, sf_dir, "part").select("p_partkey", name("p", "p_partkey").alias("compound_id"), F.concat("p_name", F.lit(" "), text("p_partkey")).alias("preferred_name"), "p_type")
    by_name = table(spark, sf_dir, "supplier").filter(k % 5 == 1).join(p.select(c("p_partkey").alias("s_suppkey"), F.concat(F.lit(" "), F.upper("preferred_name")).alias("text")), "s_suppkey", "left").select(k.alias("request"), F.coalesce("text", F.lit("zz zz")).alias("text"))
    others = table(spark, sf_dir, "supplier").filter(k % 5 != 1).select(k.alias("request"), pick(k % 5, k0=F.concat(F.lit("P"), text("s_suppkey")), k2=F.lit("Large-X"), k3=F.concat(F.lit("T  "), (k % 10).cast("string")), k4=F.lit("CC(=O)O")).alias("text"))
    aliases = p.select(name("d", "p_partkey").alias("drug_id"), F.concat(F.lower("p_type"), F.lit(" x")).alias("normalized_alias"))
    links = p.select(name("d", "p_partkey").alias("drug_id"), "compound_id", F.when(c("p_partkey") % 3 == 0, "salt").otherwise("active_moiety").alias("relationship_type"))
    produced = table(spark, sf_dir, "lineitem").select(name("p", "l_partkey").alias("compound_id"), F.when(c("l_returnflag") == "R", "rejected").otherwise("accepted").alias("review_status"))
    return matching.resolve(by_name.unionByName(others), p.withColumn("standardized_smiles", F.lit("C")), aliases, links, produced)


@query("""WITH j AS (SELECT doc_id, text, doc_id % 6 AS k, text[1:20] AS quote FROM documents WHERE text IS NOT NULL)
SELECT doc_id AS extraction_job_id, sha256(text) AS input_sha256, CASE k WHEN 0 THEN 'queued' WHEN 1 THEN 'needs_review' ELSE 'failed' END AS status, CASE k WHEN 1 THEN 'needs_review' ELSE 'unreviewed' END AS review_status,
 CASE k WHEN 2 THEN 'timeout' WHEN 3 THEN 'provider output does not match the extraction schema' WHEN 4 THEN 'provider returned an evidence quote absent from the source text' WHEN 5 THEN 'provider output does not match the extraction schema' END AS error FROM j""")
def extraction_log(spark, sf_dir):
    """Extractions from all documents: one in six without an answer, one fine, the others failed in four ways, one of them after a fine first answer."""
    c, k = F.col, F.col("doc_id") % 6
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")
    requests = d.select(c("doc_id").alias("extraction_job_id"), F.lit("p").alias("provider"), F.lit("m").alias("model"), F.lit("prompt").alias("prompt"), c("text").alias("source_text"), F.lit(None).cast("string").alias("source_url"), F.lit(1).alias("created_at"))
    answer = lambda quote: F.to_json(F.struct(F.array(F.lit("c")).alias("compounds"), F.array(F.struct(quote.alias("evidence_quote")), F.struct(F.lit("").alias("evidence_quote"))).alias("reactions")))
    good = answer(F.substring("text", 1, 20))
    content = pick(k, k1=good, k3=F.lit('{"compounds": {}, "reactions": []}'), k4=answer(F.concat(F.lit("\u0001"), F.substring("text", 1, 20))), k5=F.lit("no JSON"))
    row = lambda body, error, at: d.filter(k > 0).select(c("doc_id").alias("extraction_job_id"), body.alias("content"), error.alias("error"), F.lit("{}").alias("usage"), F.lit(at).alias("completed_at"), k.alias("k"))
    none = F.lit(None).cast("string")
    responses = row(content, F.when(k == 2, "timeout"), 9).unionByName(row(good, none, 5).filter("k = 4")).drop("k")
    return review.extraction_jobs(requests, responses).select("extraction_job_id", "input_sha256", "status", "review_status", "error")


@query("""WITH t AS (SELECT p_partkey, unnest(regexp_extract_all(f, '[A-Z][a-z]?[0-9]*')) AS t FROM (SELECT p_partkey, 'C' || p_size || 'H' || (p_size * 2 + 2) || CASE WHEN p_partkey % 3 = 0 THEN 'Cl' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN 'O2' ELSE 'OH' END AS f FROM part WHERE p_partkey % 7 > 0)),
s AS (SELECT p_partkey, regexp_extract(t, '^([A-Z][a-z]?)', 1) AS symbol, coalesce(nullif(regexp_extract(t, '([0-9]+)$', 1), ''), '1')::BIGINT AS n FROM t)
SELECT p_partkey, CASE symbol WHEN 'H' THEN 1 WHEN 'C' THEN 6 WHEN 'O' THEN 8 ELSE 17 END AS element_id, symbol, sum(n)::BIGINT AS atom_count FROM s GROUP BY 1, 3 UNION ALL SELECT p_partkey, unnest([6, 7, 1]), unnest(['C', 'N', 'H']), unnest([4, 1, 1]) FROM part WHERE p_partkey % 7 = 0""")
def compound_elements(spark, sf_dir):
    """Atom counts of made-up formulas of all parts; every seventh has none that can be read, but the SMILES of pyrrole."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    formula = F.concat(F.lit("C"), size, F.lit("H"), (F.col("p_size") * 2 + 2).cast("string"), F.when(k % 3 == 0, "Cl").otherwise(""), F.when(k % 2 == 0, "O2").otherwise("OH"), F.when(k % 5 == 0, "+").otherwise(""))
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 7 > 0, formula).otherwise("(C4)").alias("f"), F.lit("c1cc[nH]c1").alias("s"))
    return structures.compound_elements(p, "p_partkey", "f", "s")


_KINDS = """SELECT 'region:' || r_regionkey AS node_id, 'region' AS node_type, r_name AS label FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name FROM supplier UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name FROM customer
UNION ALL SELECT 'order:' || o_orderkey, 'order', o_orderpriority FROM orders UNION ALL SELECT 'part:' || p_partkey, 'part', p_name FROM part UNION ALL SELECT 'document:' || doc_id, 'document', source FROM documents"""
_LINKS = """SELECT 'nation:' || n_nationkey AS source_id, 'region:' || n_regionkey AS target_id, 'within' AS edge_type FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'based_in' FROM supplier UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'resident_in' FROM customer
UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'placed_by' FROM orders UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'order:' || l_orderkey, 'consumed' FROM lineitem WHERE l_returnflag <> 'R' UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'order:' || l_orderkey, 'returned' FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'supplies' FROM lineitem UNION ALL SELECT 'document:' || doc_id, 'order:' || o_orderkey, 'supports' FROM documents JOIN orders ON o_orderkey = doc_id"""


def whole_graph(spark, sf_dir, distinct=lambda rows, *keys: rows.distinct()):
    """Nodes, and the edges by the kinds of their ends. ``distinct`` gives the distinct rows of links and may deal them by the keys it is given."""
    t = lambda n: table(spark, sf_dir, n)
    nodes = graph.nodes((t("region"), "region", "r_regionkey", "r_name"), (t("nation"), "nation", "n_nationkey", "n_name"), (t("supplier"), "supplier", "s_suppkey", "s_name"), (t("customer"), "customer", "c_custkey", "c_name"), (t("orders"), "order", "o_orderkey", "o_orderpriority"), (t("part"), "part", "p_partkey", "p_name"), (t("documents"), "document", "doc_id", "source"))
    line = t("lineitem")
    supplied = distinct(line.select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey")
    part_of = lambda condition: distinct(line.filter(condition).select("l_partkey", "l_orderkey"), "l_orderkey")
    spoken = t("documents").select("doc_id").join(t("orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderkey"), "doc_id")
    edges = graph.edges_by_kind(
        (t("nation"), "nation", "n_nationkey", "region", "n_regionkey", "within"), (t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "based_in"), (t("customer"), "customer", "c_custkey", "nation", "c_nationkey", "resident_in"), (t("orders"), "order", "o_orderkey", "customer", "o_custkey", "placed_by"),
        (part_of("l_returnflag <> 'R'"), "part", "l_partkey", "order", "l_orderkey", "consumed"), (part_of("l_returnflag = 'R'"), "part", "l_partkey", "order", "l_orderkey", "returned"), (supplied, "supplier", "l_suppkey", "part", "l_partkey", "supplies"), (spoken, "document", "doc_id", "order", "o_orderkey", "supports"),
    )
    return nodes.select("node_id", "node_type", "label"), edges


@query(f"SELECT node_type AS kind, count(*) AS n, count(DISTINCT label) AS n_labels FROM ({_KINDS}) GROUP BY 1 UNION ALL SELECT edge_type, count(*), count(DISTINCT target_id) FROM ({_LINKS}) GROUP BY 1")
def graph_kinds(spark, sf_dir):
    """The seven kinds of nodes and eight of edges of the whole graph."""
    nodes, edges = whole_graph(spark, sf_dir, graph.distinct_by)
    edges = reduce(DataFrame.unionByName, [e for _, _, e in edges])
    kinds = lambda d, kind, of: d.groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(of).alias("n_labels"))
    return kinds(nodes, "node_type", "label").unionByName(kinds(edges, "edge_type", "target_id"))


@query(f"""WITH RECURSIVE e AS ({_LINKS}), n AS ({_KINDS}), b AS (SELECT source_id AS x, target_id AS y FROM e UNION ALL SELECT target_id, source_id FROM e), w(node_id, level) AS (SELECT 'document:7', 1 UNION SELECT b.y, w.level + 1 FROM w JOIN b ON b.x = w.node_id WHERE w.level < 3), m AS (SELECT node_id, min(level)::INT AS level FROM w GROUP BY 1)
SELECT source_id, target_id, edge_type, m.node_id AS traversed_from, level, s.label AS source_label, t.label AS target_label FROM m JOIN e ON m.node_id IN (source_id, target_id) LEFT JOIN n s ON s.node_id = source_id LEFT JOIN n t ON t.node_id = target_id""")
def graph_traversal(spark, sf_dir):
    """Edges up to three steps from a document, each with the node from which it was met."""
    nodes, edges = whole_graph(spark, sf_dir)
    return graph.traverse(edges, nodes, spark.createDataFrame([("document:7",)], "node_id string"), 3)


@query("""WITH q AS (SELECT l_partkey, l_suppkey, 'Supplier  ' || l_suppkey AS s FROM lineitem), ok AS (SELECT * FROM q JOIN part ON p_partkey = l_partkey AND p_size > 10)
SELECT 'supplier' AS table_name, count(*) AS n_rows FROM (SELECT DISTINCT l_suppkey FROM ok UNION SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) UNION ALL SELECT 'material_quote', count(*) FROM ok UNION ALL SELECT 'rejected', (SELECT count(*) FROM q) - (SELECT count(*) FROM ok)""")
def import_quotes(spark, sf_dir):
    """Price lists: quotes of known compounds with their suppliers, new ones added, and the others rejected."""
    quotes = table(spark, sf_dir, "lineitem").select(text("l_partkey").alias("compound_id"), name("Supplier  ", "l_suppkey").alias("supplier_name"), "l_orderkey")
    compounds = table(spark, sf_dir, "part").filter("p_size > 10").select(text("p_partkey").alias("compound_id"))
    known = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(S.stable_id("supplier", name("supplier ", "s_suppkey")).alias("supplier_id"), name("SUPPLIER ", "s_suppkey").alias("supplier_name"))
    return coverage.table_counts(curation.import_quotes(quotes, compounds, known, "l_orderkey"))


@query("""WITH s AS (SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'needs_review' ELSE 'rejected' END AS st FROM orders), r AS (SELECT o_custkey, CASE WHEN bool_and(st = 'accepted') THEN 'accepted' ELSE 'needs_review' END AS st FROM s GROUP BY 1)
SELECT 'process_step' AS table_name, st AS review_status, count(*) AS n FROM s GROUP BY 2 UNION ALL SELECT 'evidence_span', st, count(*) FROM s GROUP BY 2 UNION ALL SELECT 'process_route', st, count(*) FROM r GROUP BY 2""")
def approval_states(spark, sf_dir):
    """Decisions on steps go to their spans, and to routes of which all steps are accepted."""
    c = F.col
    o = table(spark, sf_dir, "orders")
    steps = o.select(c("o_orderkey").alias("step_id"), c("o_custkey").alias("route_id"), name("span", "o_orderkey").alias("evidence_span_id"), F.lit("needs_review").alias("review_status"))
    spans = steps.select("evidence_span_id", "review_status")
    routes = steps.select("route_id", "review_status").distinct()
    decisions = o.filter("o_orderstatus <> 'O'").select(c("o_orderkey").alias("step_id"), F.when(c("o_orderstatus") == "F", "accepted").otherwise("rejected").alias("decision"))
    out = None
    for n, t in curation.approve(steps, spans, routes, decisions).items():
        own = t.groupBy(F.lit(n).alias("table_name"), "review_status").agg(F.count(F.lit(1)).alias("n"))
        out = own if out is None else out.unionByName(own)
    return out


_REGISTRY = "SELECT CASE WHEN s_suppkey = 6 THEN 'wipo_patentscope_public' ELSE 'source-' || s_suppkey END AS source_id, s_suppkey AS k FROM supplier"


def registered(spark, sf_dir):
    """Suppliers as a registry of sources, and (source_id, k)."""
    c, k, word = F.col, F.col("s_suppkey"), F.lit("x")
    fields = {n: word for n in ("name", "authority", "role", "collection_mode")} | {"redistribution": F.when(k % 2 == 0, "restricted").otherwise("open"), "license_code": F.when(k % 5 != 0, word)}
    fields |= {"runtime_dependency": F.when(k % 7 == 1, True).when(k % 7 > 1, False), "automated_acquisition_allowed": F.when(k % 3 == 1, True).when(k % 3 == 2, False)}
    return table(spark, sf_dir, "supplier").select(F.when(k == 6, curation.CLOSED_SITE).otherwise(F.concat(F.lit("source-"), k)).alias("source_id"), *[v.alias(n) for n, v in fields.items()]), c


@query(f"""WITH r AS ({_REGISTRY}) SELECT source_id, code, CASE code WHEN 'restricted_acquisition' THEN 'warning' ELSE 'error' END AS severity FROM (
SELECT source_id, unnest(list_filter([CASE WHEN k % 5 = 0 THEN 'required_license_code' END, CASE WHEN k % 7 <= 1 THEN 'runtime_dependency' END, CASE WHEN k = 6 THEN 'wipo_terms' END, CASE WHEN k % 2 = 0 AND k % 3 = 1 THEN 'restricted_acquisition' END], lambda x: x IS NOT NULL)) AS code FROM r
UNION ALL SELECT source_id, 'duplicate_source' FROM r WHERE k % 11 = 3)""")
def source_issues(spark, sf_dir):
    """What is wrong with a registry of sources, some of them without a word on what is forbidden; every eleventh is there twice, the second time without a fault."""
    rows, _ = registered(spark, sf_dir)
    again = table(spark, sf_dir, "supplier").filter("s_suppkey % 11 = 3").select(F.concat(F.lit("source-"), "s_suppkey").alias("source_id"))
    sound = {n: F.lit("x") for n in ("name", "authority", "role", "collection_mode", "redistribution", "license_code")} | {n: F.lit(False) for n in ("runtime_dependency", "automated_acquisition_allowed")}
    return curation.registry_issues(rows.unionByName(again.withColumns(sound)))


@query(f"WITH r AS ({_REGISTRY}) SELECT source_id, CASE WHEN k % 5 > 0 AND k % 7 > 1 AND k <> 6 THEN 'x' ELSE 'before' END AS name FROM r WHERE k % 4 > 0 OR (k % 5 > 0 AND k % 7 > 1 AND k <> 6)")
def registered_sources(spark, sf_dir):
    """Three of four sources are stored under another name; those of the registry that are sound are merged in."""
    rows, c = registered(spark, sf_dir)
    key = F.when(c("source_id") == curation.CLOSED_SITE, F.lit(6)).otherwise(F.substr("source_id", F.lit(8)).cast("bigint"))
    stored = rows.filter(key % 4 > 0).withColumn("name", F.lit("before"))
    sound = rows.join(curation.registry_issues(rows).filter("severity = 'error'").select("source_id"), "source_id", "left_anti")
    return curation.register_sources(stored, sound).select("source_id", "name")


@query("SELECT doc_id, lang, n_chars FROM documents")
def json_round_trip(spark, sf_dir):
    """Documents' ids written as JSON lines and read back."""
    from pyspark.sql import types as T

    path = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    files.write_json(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), path)
    return files.json_lines(spark, path, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType())]))


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def published_table(spark, sf_dir):
    """A table sorted by its key, checked and written in one commit, and read back."""
    from attesta.operators import merge

    base = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    files.write_sorted(line, f"{base}/sorted", "l_orderkey")
    own = spark.read.parquet(f"{base}/sorted")
    merge.publish(own, f"{base}/published", own.filter("l_quantity < 0"))
    return spark.read.parquet(f"{base}/published")
