"""Queries of the evidence model over the star-schema tables: coverage, matching, quality, review.

Customers stand for catalogue entities, orders for publications, parts for
compounds, lineitems for candidates and quotes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import scalars as S
from attesta.operators import coverage, matching, top


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def status(flag: str = "l_returnflag"):
    return F.when(F.col(flag) == "R", "rejected").when(F.col(flag) == "A", "accepted").otherwise("needs_review")


def dec(c, scale: int = 4):
    return F.col(c).cast(f"decimal(18,{scale})") if isinstance(c, str) else c.cast(f"decimal(18,{scale})")


QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_COVERAGE = """
WITH cand AS (SELECT o_custkey AS k, l_orderkey AS pub, CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'accepted' ELSE 'needs_review' END AS status, l_partkey, l_suppkey, l_discount
              FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
ev AS (SELECT doc_id AS pub, sha256(text) AS span FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0),
p AS (SELECT k, count(DISTINCT pub) AS patent_count FROM cand WHERE status <> 'rejected' GROUP BY k),
e AS (SELECT k, count(DISTINCT span) AS example_count FROM cand JOIN ev USING (pub) GROUP BY k),
r AS (SELECT k, count(DISTINCT CASE WHEN status = 'accepted' THEN l_partkey END) AS reviewed_count, count(DISTINCT CASE WHEN status = 'needs_review' THEN l_partkey END) AS review_count FROM cand GROUP BY k),
q AS (SELECT k, count(DISTINCT l_suppkey) AS priced_count, max(l_discount * 10) AS max_coverage FROM cand WHERE l_discount > 0 AND status <> 'rejected' GROUP BY k),
j AS (SELECT c_custkey, coalesce(patent_count, 0) AS patent_count, coalesce(example_count, 0) AS example_count, coalesce(reviewed_count, 0) AS reviewed_count, coalesce(review_count, 0) AS review_count,
             coalesce(priced_count, 0) AS priced_count, coalesce(max_coverage, 0) AS max_coverage, CASE WHEN c_acctbal < -900 THEN 1 ELSE 0 END AS unavailable
      FROM customer LEFT JOIN p ON p.k = c_custkey LEFT JOIN e ON e.k = c_custkey LEFT JOIN r ON r.k = c_custkey LEFT JOIN q ON q.k = c_custkey),
f AS (SELECT *, 1 AS identified, (patent_count > 0)::INT AS patents_found, (example_count > 0)::INT AS examples_extracted, (review_count > 0)::INT AS routes_under_review, (reviewed_count > 0)::INT AS complete_reviewed_route,
             (reviewed_count > 0 AND max_coverage >= 0.8)::INT AS price_complete, (reviewed_count > 0 AND priced_count >= 2)::INT AS cost_comparison_ready FROM j),
cov AS (SELECT *, CASE WHEN unavailable = 1 THEN 'public_evidence_unavailable' WHEN cost_comparison_ready = 1 THEN 'cost_comparison_ready' WHEN price_complete = 1 THEN 'price_complete' WHEN complete_reviewed_route = 1 THEN 'complete_reviewed_route'
             WHEN routes_under_review = 1 THEN 'routes_under_review' WHEN examples_extracted = 1 THEN 'examples_extracted' WHEN patents_found = 1 THEN 'patents_found' ELSE 'identified' END AS status FROM f)
"""


def covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    cand = line.select("l_orderkey", "l_returnflag", "l_partkey", "l_suppkey", "l_discount").join(orders.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("c_custkey"), F.col("l_orderkey").alias("publication"), status().alias("status"), "l_partkey", "l_suppkey", "l_discount")
    evidence = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id", "left").select(F.col("doc_id").alias("publication"), F.sha2("text", 256).alias("span"), F.when(F.col("toxic") == 1, "rejected").otherwise("accepted").alias("status"))
    prices = cand.filter((F.col("l_discount") > 0) & (F.col("status") != "rejected")).select("c_custkey", F.col("l_suppkey").alias("priced"), (F.col("l_discount") * 10).alias("coverage"))
    customer = table(spark, sf_dir, "customer")
    return coverage.refresh(customer, "c_custkey", cand, evidence, cand.select("c_custkey", F.col("l_partkey").alias("route"), "status"), prices, customer.filter("c_acctbal < -900"))


@query(_COVERAGE + "SELECT c_custkey, patent_count, example_count, reviewed_count, review_count, priced_count, max_coverage, unavailable, identified, patents_found, examples_extracted, routes_under_review, complete_reviewed_route, price_complete, cost_comparison_ready, status FROM cov")
def coverage_refresh(spark, sf_dir):
    return covered(spark, sf_dir)


@query(_COVERAGE + "SELECT status, count(*) AS n, sum(identified)::BIGINT AS identified, sum(patents_found)::BIGINT AS patents_found, sum(examples_extracted)::BIGINT AS examples_extracted, sum(routes_under_review)::BIGINT AS routes_under_review, sum(complete_reviewed_route)::BIGINT AS complete_reviewed_route, sum(price_complete)::BIGINT AS price_complete, sum(cost_comparison_ready)::BIGINT AS cost_comparison_ready FROM cov GROUP BY status")
def coverage_summary(spark, sf_dir):
    return coverage.summary(covered(spark, sf_dir))


@query("""
WITH s AS (SELECT doc_id, source, lang, CASE WHEN v < 0.8 THEN 'train' WHEN v < 0.9 THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, source, lang, ('0x' || substr(sha256('s1|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS v FROM documents))
SELECT check_name, severity, affected_count, CASE WHEN affected_count = 0 THEN 'pass' ELSE 'fail' END AS status FROM (
SELECT 'orphan_family_members' AS check_name, 'critical' AS severity, count(*) AS affected_count FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
UNION ALL SELECT 'orphan_process_evidence', 'critical', count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL SELECT 'negative_quantities', 'critical', count(*) FROM lineitem WHERE l_quantity < 0
UNION ALL SELECT 'scale_labels_without_mass_basis', 'critical', count(*) FROM part WHERE p_size > 0 AND p_retailprice IS NULL
UNION ALL SELECT 'stage_derived_from_scale', 'critical', count(*) FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'
UNION ALL SELECT 'synthetic_examples_in_released_dataset', 'critical', count(*) FROM labels WHERE quality = 0 AND toxic = 1
UNION ALL SELECT 'family_split_leakage', 'critical', count(*) FROM (SELECT source FROM s GROUP BY source HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'active_moiety_split_leakage', 'high', count(*) FROM (SELECT lang FROM s GROUP BY lang HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'catalogue_drugs_without_coverage', 'high', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT 'exact_patent_matches_without_local_inchi_key', 'critical', count(*) FROM part WHERE p_name IS NULL)""")
def quality_checks(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    docs = t("documents").select("doc_id", "source", "lang")
    split = docs.withColumn("split", S.split_name(S.bucket(F.col("doc_id").cast("string"), "s1")))
    checks = [
        ("orphan_family_members", "critical", coverage.orphans(t("lineitem").select("l_orderkey"), t("orders"), "l_orderkey", "o_orderkey")),
        ("orphan_process_evidence", "critical", coverage.orphans(docs, t("labels"), "doc_id", "doc_id")),
        ("negative_quantities", "critical", t("lineitem").filter("l_quantity < 0")),
        ("scale_labels_without_mass_basis", "critical", t("part").filter("p_size > 0 and p_retailprice is null")),
        ("stage_derived_from_scale", "critical", t("orders").filter("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'")),
        ("synthetic_examples_in_released_dataset", "critical", t("labels").filter("quality = 0 and toxic = 1")),
        ("family_split_leakage", "critical", coverage.leaking_groups(split, "source", "split")),
        ("active_moiety_split_leakage", "high", coverage.leaking_groups(split, "lang", "split")),
        ("catalogue_drugs_without_coverage", "high", coverage.orphans(t("customer"), t("orders"), "c_custkey", "o_custkey")),
        ("exact_patent_matches_without_local_inchi_key", "critical", t("part").filter("p_name is null")),
    ]
    out = None
    for c in checks:
        row = coverage.check(*c)
        out = row if out is None else out.unionByName(row)
    return out


_MATCH = """
WITH p AS (SELECT p_partkey, p_brand || ':' || p_size || ':' || p_type AS c, p_brand || ':' || p_size || ':' || p_type || '-' || nullif(p_name, '') AS k FROM part),
m AS (SELECT a.p_partkey AS seed_id, b.p_partkey AS source_id, CASE WHEN a.k = b.k THEN 'exact_structure' ELSE 'same_connectivity' END AS match_type FROM p a JOIN p b ON a.k = b.k OR a.c = b.c)
"""


def keyed_parts(spark, sf_dir):
    """All parts with the whole key and what it begins with."""
    start = F.concat(F.col("p_brand"), F.lit(":"), F.col("p_size").cast("string"), F.lit(":"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(start, F.lit("-"), F.nullif(F.col("p_name"), F.lit(""))).alias("k"), start.alias("c"))


@query(_MATCH + """SELECT seed_id, source_id, match_type, CASE match_type WHEN 'exact_structure' THEN 0.98 ELSE 0.85 END::DOUBLE AS confidence, l_orderkey AS publication, o_orderdate AS publication_date
FROM m JOIN (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) ON l_partkey = source_id JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'""")
def candidate_match_or_join(spark, sf_dir):
    """As candidate_match_all_seeds, held against SQL with an OR of both keys."""
    return candidate_match_all_seeds(spark, sf_dir)


@query("""WITH p AS (SELECT p_partkey, p_brand || ':' || p_size || ':' || p_type AS c, p_brand || ':' || p_size || ':' || p_type || '-' || nullif(p_name, '') AS k FROM part), seed AS (SELECT p_partkey AS seed_id, k, c FROM p),
m AS (SELECT seed_id, p_partkey AS source_id, 'exact_structure' AS match_type, 0.98::DOUBLE AS confidence FROM seed JOIN p ON seed.k = p.k
      UNION ALL SELECT seed_id, p_partkey, 'same_connectivity', 0.85::DOUBLE FROM seed JOIN p ON seed.c = p.c WHERE coalesce(seed.k <> p.k, true))
SELECT seed_id, source_id, match_type, confidence, l_orderkey AS publication, o_orderdate AS publication_date
FROM m JOIN (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) ON l_partkey = source_id JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'""")
def candidate_match_all_seeds(spark, sf_dir):
    """Every part against the publications of every other: these come to the parts before the match, so that no pair is shuffled."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    line = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source_id"), F.col("l_orderkey").alias("publication")).repartition(n, "publication").distinct()
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("publication"), F.col("o_orderdate").alias("publication_date"))
    part = keyed_parts(spark, sf_dir)
    sold = line.join(orders, "publication").repartition(n, "source_id").join(part.withColumnRenamed("p_partkey", "source_id").hint("merge"), "source_id")
    pairs = matching.match_either(part.withColumnRenamed("p_partkey", "seed_id"), sold, "k", "c", part)
    return pairs.select("seed_id", F.col("s_source_id").alias("source_id"), "match_type", "confidence", F.col("s_publication").alias("publication"), F.col("s_publication_date").alias("publication_date"))


@query(_MATCH + "SELECT match_type, count(*) AS n, count(DISTINCT seed_id) AS n_seeds, count(DISTINCT source_id) AS n_sources FROM m GROUP BY match_type")
def candidate_summary(spark, sf_dir):
    part = keyed_parts(spark, sf_dir)
    return matching.match_counts(part, part, "k", "c", "p_partkey", "p_partkey")


@query("SELECT n_name AS country, count(*) AS n, count(DISTINCT o_custkey) AS n_entities FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def candidates_by_country(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, sf_dir, "orders").select("o_custkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("n_name").alias("country")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("n_entities"))


@query("SELECT count(*) FILTER (f IS NULL OR f = -1) AS missing, count(*) AS total FROM (SELECT CASE WHEN p_size = 1 THEN -1 ELSE nullif(p_size, 2) END AS f FROM part)")
def missing_family(spark, sf_dir):
    f = F.when(F.col("p_size") == 1, -1).otherwise(F.nullif(F.col("p_size"), F.lit(2)))
    return table(spark, sf_dir, "part").select(f.alias("f")).agg(F.count(F.when(F.col("f").isNull() | (F.col("f") == -1), 1)).alias("missing"), F.count(F.lit(1)).alias("total"))


@query("SELECT l_suppkey, p_name, min(p_partkey) AS p_partkey FROM lineitem JOIN (SELECT p_partkey, nullif(p_name, '') AS p_name FROM part) ON p_partkey = l_partkey WHERE p_name IS NOT NULL GROUP BY l_suppkey, p_name")
def seed_export(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.nullif(F.col("p_name"), F.lit("")).alias("p_name"))
    pairs = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("p_partkey")).join(part, "p_partkey")
    return matching.seeds(pairs, "l_suppkey", ["p_name"], "p_partkey")


@query("SELECT c_custkey, 'drug:' || substr(sha256(c_name || '|' || coalesce(nullif(c_mktsegment, 'BUILDING'), '') || '|' || c_nationkey), 1, 24) AS id, substr(sha256(c_mktsegment || chr(0) || c_name), 1, 24) AS job FROM customer")
def stable_ids(spark, sf_dir):
    seg = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return table(spark, sf_dir, "customer").select("c_custkey", S.stable_id("drug", F.col("c_name"), seg, F.col("c_nationkey")).alias("id"), S.job_id(F.col("c_mktsegment"), F.col("c_name")).alias("job"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_type || ' -- ' || p_name), '[^a-z0-9]+', ' ', 'g')) AS name, upper(regexp_replace(p_brand, '[^A-Za-z0-9]+', '_', 'g')) AS namespace FROM part")
def normalize_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.normalize_name(F.concat_ws(" -- ", "p_type", "p_name")).alias("name"), S.namespace(F.col("p_brand")).alias("namespace"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE 'US-' || o_orderkey || '-A1' END AS dashed, upper(regexp_replace(CASE o_orderkey % 3 WHEN 0 THEN 'us' || o_orderkey || ' a1' WHEN 1 THEN 'US-' || o_orderkey || '-A1' ELSE 'x ' || o_orderkey END, '\\s+', '', 'g')) AS compact,
CASE WHEN o_orderkey % 5 = 0 THEN 'surechembl-publication:' || o_orderkey ELSE 'surechembl:' || o_custkey END AS family FROM orders""")
def publication_normalize(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("us"), k, F.lit(" a1"))).when(k % 3 == 1, F.concat(F.lit("US-"), k, F.lit("-A1"))).otherwise(F.concat(F.lit("x "), k))
    fam = F.when(k % 10 == 0, F.lit("-1")).when(k % 5 == 0, F.lit("")).otherwise(F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.publication_dashed(raw).alias("dashed"), S.publication_compact(raw).alias("compact"), S.family_id(fam, k.cast("string")).alias("family"))


@query("SELECT c_custkey, nullif(regexp_replace(c, '^\\s+|\\s+$', '', 'g'), '') AS cleaned, CASE WHEN length(k) < 6 THEN lpad(k, 6, '0') ELSE k END AS padded FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '  ' || c_name || chr(9) WHEN 1 THEN '   ' WHEN 2 THEN c_name ELSE NULL END AS c, c_custkey::VARCHAR AS k FROM customer)")
def clean_text(spark, sf_dir):
    k = F.col("c_custkey")
    c = F.when(k % 4 == 0, F.concat(F.lit("  "), "c_name", F.lit("\t"))).when(k % 4 == 1, F.lit("   ")).when(k % 4 == 2, F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", S.clean(c).alias("cleaned"), S.zfill(k.cast("string"), 6).alias("padded"))


@query("""SELECT o_orderkey, CASE WHEN t LIKE '%withdraw%' THEN 'withdrawn' WHEN t LIKE '%discont%' OR t = 'discn' THEN 'discontinued' WHEN t LIKE '%tentative%' THEN 'tentative' WHEN t IN ('rx', 'otc') OR t LIKE '%prescription%' OR t LIKE '%over the counter%' THEN 'active' ELSE 'unknown' END AS status
FROM (SELECT o_orderkey, lower(CASE o_orderkey % 7 WHEN 0 THEN 'Prescription' WHEN 1 THEN 'RX' WHEN 2 THEN 'DISCN' WHEN 3 THEN 'Federal Register: Withdrawn, discontinued' WHEN 4 THEN 'None (Tentative Approval)' WHEN 5 THEN 'Over the counter' ELSE o_orderpriority END) AS t FROM orders)""")
def marketing_status(spark, sf_dir):
    k = F.col("o_orderkey") % 7
    t = F.when(k == 0, "Prescription").when(k == 1, "RX").when(k == 2, "DISCN").when(k == 3, "Federal Register: Withdrawn, discontinued").when(k == 4, "None (Tentative Approval)").when(k == 5, "Over the counter").otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.marketing_status(t).alias("status"))


@query("SELECT p_partkey, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS ingredient FROM (SELECT p_partkey, unnest(string_split(replace(p_type, ' ', chr(9) || '; ') || ' ;' || chr(10) || ' ; ', ';')) AS x FROM part) WHERE NOT regexp_full_match(x, '\\s*')")
def split_ingredients(spark, sf_dir):
    t = F.concat(F.replace(F.col("p_type"), F.lit(" "), F.lit("\t; ")), F.lit(" ;\n ; "))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(S.split_list(t)).alias("ingredient"))


def routed(spark, sf_dir):
    app = F.when(F.col("l_orderkey") % 11 != 0, F.col("l_orderkey"))
    prod = F.when(F.col("l_linenumber") != 7, F.col("l_linenumber"))
    missing = F.concat_ws("_and_", F.when(app.isNull(), "application_number"), F.when(prod.isNull(), "product_number"))
    outcome = F.when(missing != "", "rejected").when(F.col("l_returnflag") == "R", "excluded").otherwise("accepted")
    return table(spark, sf_dir, "lineitem").select(outcome.alias("outcome"), F.when(missing != "", F.concat(F.lit("missing_"), missing)).when(F.col("l_returnflag") == "R", "not_approved").alias("reason"))


_ROUTED = """WITH r AS (SELECT CASE WHEN m <> '' THEN 'rejected' WHEN l_returnflag = 'R' THEN 'excluded' ELSE 'accepted' END AS outcome, CASE WHEN m <> '' THEN 'missing_' || m WHEN l_returnflag = 'R' THEN 'not_approved' END AS reason
FROM (SELECT l_returnflag, concat_ws('_and_', CASE WHEN l_orderkey % 11 = 0 THEN 'application_number' END, CASE WHEN l_linenumber = 7 THEN 'product_number' END) AS m FROM lineitem))"""


@query(_ROUTED + " SELECT outcome, reason, count(*) AS n FROM r GROUP BY ALL")
def reject_reasons(spark, sf_dir):
    return coverage.histogram(routed(spark, sf_dir), "outcome", "reason")


@query(_ROUTED + " SELECT count(*) AS input_rows, count(*) FILTER (outcome = 'accepted') AS accepted_rows, count(*) FILTER (outcome = 'excluded') AS excluded_rows, count(*) FILTER (outcome = 'rejected') AS rejected_rows, true AS balanced FROM r")
def ingestion_accounting(spark, sf_dir):
    return coverage.reconcile(routed(spark, sf_dir), "outcome")


@query("""WITH q AS (SELECT l_orderkey, CASE l_linenumber % 4 WHEN 0 THEN 3 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE NULL END AS r, l_quantity * CASE l_linestatus WHEN 'O' THEN 1000.0 ELSE 1.0 END * CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 1 END AS g FROM lineitem),
b AS (SELECT l_orderkey, r, max(g) AS g FROM q WHERE r IS NOT NULL AND g IS NOT NULL GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY r) AS n FROM b)
SELECT o_orderkey, g AS basis_g, CASE WHEN g >= 100000 THEN 'manufacturing' WHEN g >= 10000 THEN 'pilot' WHEN g >= 100 THEN 'kilo_lab' WHEN g >= 1 THEN 'laboratory' WHEN g >= 0 THEN 'sub_gram' ELSE 'unknown' END AS band FROM orders LEFT JOIN t ON l_orderkey = o_orderkey AND n = 1""")
def scale_bands(spark, sf_dir):
    n = F.col("l_linenumber")
    kind = F.when(n % 4 == 0, "input_mass").when(n % 4 == 1, "product_mass").when(n % 4 == 2, "batch_mass").otherwise("yield")
    unit = F.when(n % 3 == 0, "mol").when(F.col("l_linestatus") == "O", "kg").otherwise("g")
    q = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), S.basis_rank(kind).alias("r"), S.grams(F.col("l_quantity"), unit).alias("g")).filter("r is not null and g is not null")
    best = q.groupBy("o_orderkey").agg(F.max_by("g", F.struct(-F.col("r"), "g")).alias("basis_g"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(best, "o_orderkey", "left").select("o_orderkey", "basis_g", S.scale_band(F.col("basis_g")).alias("band"))


@query("""SELECT doc_id, unnest(list_filter([CASE WHEN n_chars < 200 THEN 'required' END, CASE WHEN NOT regexp_matches(upper(substr(sha256(text), 1, 14)), '^[A-Z]{14}$') THEN 'connectivity_key' END, CASE WHEN quality IS NULL THEN 'evidence_status' END,
CASE WHEN quality = 0 AND toxic = 1 THEN 'training_evidence_status' END, CASE WHEN length(sha256(text)) <> 64 THEN 'sha256' END, CASE WHEN n_chars <> length(text) THEN 'offset' END], lambda x: x IS NOT NULL)) AS code FROM documents LEFT JOIN labels USING (doc_id)""")
def validation_issues(spark, sf_dir):
    h = F.sha2("text", 256)
    rules = (
        ("required", F.col("n_chars") < 200),
        ("connectivity_key", ~F.upper(F.substring(h, 1, 14)).rlike(S.CONNECTIVITY_PATTERN)),
        ("evidence_status", F.col("quality").isNull()),
        ("training_evidence_status", (F.col("quality") == 0) & (F.col("toxic") == 1)),
        ("sha256", ~h.rlike(S.HASH_PATTERN)),
        ("offset", F.col("n_chars") != F.length("text")),
    )
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in rules]))).alias("code"))


_SPLIT = "SELECT doc_id, source, CASE WHEN v < 0.8 THEN 'train' WHEN v < 0.9 THEN 'validation' ELSE 'test' END AS split_name, v FROM (SELECT doc_id, source, ('0x' || substr(sha256('data-v1|' || source), 1, 13))::BIGINT / 4503599627370496.0 AS v FROM documents)"


@query(_SPLIT)
def deterministic_split(spark, sf_dir):
    v = S.bucket(F.col("source"), "data-v1")
    return table(spark, sf_dir, "documents").select("doc_id", "source", S.split_name(v).alias("split_name"), v.alias("v"))


@query(f"SELECT count(*) AS leaking FROM (SELECT source FROM ({_SPLIT}) GROUP BY source HAVING count(DISTINCT split_name) > 1)")
def split_leakage(spark, sf_dir):
    return coverage.leaking_groups(deterministic_split(spark, sf_dir), "source", "split_name").agg(F.count(F.lit(1)).alias("leaking"))


@query("SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_decision(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return top.top1(e, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()])


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def preferred_row(spark, sf_dir):
    return top.top1(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], [(F.col("o_orderstatus") == "F").desc(), F.col("o_orderkey").asc()])


@query("SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) ON o_custkey = c_custkey AND n = 1")
def top1_left_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return top.left_join_top1(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), o, ["c_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()])


_ELIGIBLE = """WITH d AS (SELECT l_orderkey, bool_and(p_retailprice > 950) AS mapped, max(p_size) AS basis FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey),
e AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'step_not_accepted' WHEN o_orderpriority = '5-LOW' THEN 'route_not_accepted' WHEN coalesce(quality, 1) = 0 THEN 'evidence_not_accepted' WHEN toxic = 1 THEN 'reaction_not_accepted' WHEN NOT coalesce(mapped, false) THEN 'reaction_mapping_incomplete'
 WHEN basis IS NULL OR basis < 10 THEN 'missing_mass_basis' WHEN o_custkey IS NULL THEN 'missing_patent_family' WHEN o_orderdate IS NULL THEN 'missing_publication_date' END AS exclusion FROM orders LEFT JOIN d ON l_orderkey = o_orderkey LEFT JOIN labels ON doc_id = o_orderkey)"""


@query(_ELIGIBLE + " SELECT coalesce(exclusion, 'eligible') AS outcome, count(*) AS n, min(o_orderkey) AS first_step FROM e GROUP BY 1")
def training_eligibility(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice", "p_size"), "l_partkey")
    d = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_and(F.col("p_retailprice") > 950).alias("mapped"), F.max("p_size").alias("basis"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey", "o_orderdate").join(d, "o_orderkey", "left").join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "o_orderkey"), "o_orderkey", "left")
    c = F.col
    why = S.first_reason(
        ("step_not_accepted", c("o_orderstatus") == "O"),
        ("route_not_accepted", c("o_orderpriority") == "5-LOW"),
        ("evidence_not_accepted", c("quality") == 0),
        ("reaction_not_accepted", c("toxic") == 1),
        ("reaction_mapping_incomplete", ~F.coalesce(c("mapped"), F.lit(False))),
        ("missing_mass_basis", c("basis").isNull() | (c("basis") < 10)),
        ("missing_patent_family", c("o_custkey").isNull()),
        ("missing_publication_date", c("o_orderdate").isNull()),
    )
    return o.select("o_orderkey", F.coalesce(why, F.lit("eligible")).alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_step"))
