"""Review queues, page offsets, job states and converters of released records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions.scalars import any_phrase, canonical_json, strip, term_hits
from attesta.operators.top import top1

#: Priority of the field in which a candidate was found and of its country, fixed values; others have 0.
FIELD_PRIORITY = {"clms": 4, "claims": 4, "desc": 3, "description": 3, "abst": 2, "abstract": 2, "ttl": 1, "title": 1}
COUNTRY_PRIORITY = {"WO": 4, "EP": 3, "US": 2}


def priority(col: Column, table: dict[str, int]) -> Column:
    return F.coalesce(*[F.when(col == k, F.lit(v)) for k, v in table.items()], F.lit(0))


def queue_scores(title: Column, names: Column, negatives: tuple[str, ...], route_terms: tuple[str, ...], making: tuple[str, ...]) -> dict[str, Column]:
    """The parts of a candidate's score that its title decides, each the higher the better; names is an array of normalised aliases."""
    hit = any_phrase(title, names)
    makes = term_hits(title, making) > 0
    return {"title_match": hit.cast("int"), "direct": (hit & makes).cast("int"), "negative_hits": -term_hits(title, negatives), "route_hits": term_hits(title, route_terms)}


def pilot_queue(candidates: DataFrame, entity: str, family: str, score: list[Column]) -> DataFrame:
    """The best candidate of each family of an entity, then of each entity; ``score`` ends with something unique."""
    per_family = top1(candidates, [entity, family], score)
    return top1(per_family, [entity], score)


def batch(fixed: DataFrame, automatic: DataFrame, size: int, key: str, order: list[Column]) -> DataFrame:
    """The fixed rows and the best automatic ones, ``size`` in all; an error if there are too few."""
    n = fixed.count()
    rest = automatic.join(fixed.select(key), key, "left_anti").orderBy(*order).limit(size - n)
    if n > size or rest.count() < size - n:
        raise ValueError(f"a batch of {size} rows can't be filled")
    return fixed.unionByName(rest)


def page_offsets(pages: DataFrame, doc: str, page: str, text: str, separator: int = 2) -> DataFrame:
    """char_start and char_end of each page in its document's text, pages being joined by a separator.

    Offsets are sums over what precedes in the same document; a document is as
    large as its pages, so the window holds lengths and no texts.
    """
    lengths = pages.select(doc, page, F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"))
    before = W.partitionBy(doc).orderBy(page).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("n") + separator).over(before), F.lit(0))
    return lengths.select(doc, page, start.alias("char_start"), (start + F.col("n")).alias("char_end"))


def pdf_routing(pages: DataFrame, doc: str, text: str, documents: DataFrame | None = None) -> DataFrame:
    """Per document: text_extraction if its pages have enough text besides white space, else ocr.

    With ``documents`` (the same id column) one that has no page is an error that names it.
    """
    n = F.length(strip(F.coalesce(F.col(text), F.lit(""))))
    if documents is not None:
        bare = documents.select(doc).distinct().join(pages.select(doc), doc, "left_anti").select(doc, F.lit(None).cast("string").alias(text), F.lit(True).alias("__bare"))
        pages = pages.select(doc, text, F.lit(False).alias("__bare")).unionByName(bare)
        n = F.when(F.col("__bare"), F.raise_error(F.concat(F.lit("no pages: "), F.col(doc).cast("string"))).cast("int")).otherwise(n)
    out = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("n_pages"), F.sum(n).alias("n_text"), F.count(F.when(n > 0, 1)).alias("n_with_text"))
    enough = (F.col("n_text") >= F.greatest(F.lit(1000), 100 * F.col("n_pages"))) & (F.col("n_with_text") * 10 >= 8 * F.col("n_pages"))
    return out.withColumn("route", F.when(enough, "text_extraction").otherwise("ocr"))


def job_state(events: DataFrame, job: list[str], at: list[str], state: str, running: str = "running") -> DataFrame:
    """Latest state and number of attempts of each job, from its log, by aggregation."""
    attempts = F.count(F.when(F.col(state) == running, 1))
    return events.groupBy(*job).agg(F.max_by(state, F.struct(*at)).alias("status"), attempts.alias("attempts"), F.count(F.lit(1)).alias("n_events"))


def exceptions(states: DataFrame, job: list[str], bad: tuple[str, ...], at: str | None = None, limit: int = 100) -> DataFrame:
    """The jobs (of job_state) that need someone: those whose latest state is one of ``bad``. With ``at`` a page of the report: the ``limit`` that ended last, in that order."""
    found = states.filter(F.col("status").isin(*bad))
    if at is None:
        return found.select(*job, "status", "attempts")
    return found.select(*job, "status", "attempts", at).orderBy(F.col(at).desc_nulls_last(), *job).limit(limit)


def due(wanted: DataFrame, states: DataFrame, job: list[str], finished: tuple[str, ...]) -> DataFrame:
    """Wanted jobs that have to run: those without a finished latest state."""
    return wanted.select(*job).distinct().join(states.filter(F.col("status").isin(*finished)), job, "left_anti")


def extraction_jobs(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """The log of extraction requests after their responses: what came back, whether it may be reviewed, and why not.

    requests (extraction_job_id, provider, model, prompt, source_text,
    source_url, created_at), responses (extraction_job_id, content, error,
    usage, completed_at): the last of a job counts.  A job without a response is
    queued.  A response needs review if it is an object with lists of compounds
    and reactions and every quotation of a reaction stands in the source, word
    for word; else the job has failed, with an error.  Nothing is accepted by it.
    """
    c, digest = F.col, lambda x: F.sha2(x, 256)
    last = responses.groupBy("extraction_job_id").agg(F.max_by(F.struct("content", "error", "usage", "completed_at"), "completed_at").alias("r")).select("extraction_job_id", "r.*")
    listed = lambda name: F.get_json_object("content", f"$.{name}").startswith("[")
    quotes = F.from_json(F.get_json_object("content", "$.reactions"), "array<struct<evidence_quote: string>>")
    absent = F.exists(quotes, lambda q: (F.coalesce(q["evidence_quote"], F.lit("")) != "") & ~c("source_text").contains(q["evidence_quote"]))
    why = F.coalesce(
        c("error"),
        F.when(~F.coalesce(listed("compounds") & listed("reactions"), F.lit(False)), "provider output does not match the extraction schema"),
        F.when(F.coalesce(absent, F.lit(False)), "provider returned an evidence quote absent from the source text"),
    )
    joined = requests.join(last.withColumn("__there", F.lit(True)), "extraction_job_id", "left").withColumn("error", F.when(c("__there"), why))
    fine = c("__there") & c("error").isNull()
    return joined.select(
        "extraction_job_id", "provider", "model", digest(c("prompt")).alias("prompt_sha256"), digest(c("source_text")).alias("input_sha256"), F.when(fine, digest(c("content"))).alias("response_sha256"), "source_url",
        F.when(c("__there").isNull(), "queued").when(fine, "needs_review").otherwise("failed").alias("status"), F.when(fine, "needs_review").otherwise("unreviewed").alias("review_status"), "error", F.when(fine, c("usage")).alias("token_cost_json"), "created_at", "completed_at",
    )


#: Steps of the coverage ladder by which a page may be filtered, fixed values.
STEPS = ("identified", "patents_found", "examples_extracted", "routes_under_review", "complete_reviewed_route", "price_complete", "cost_comparison_ready", "public_evidence_unavailable")


def all_of(rows: DataFrame, *conditions: Column | None) -> DataFrame:
    """Rows that fit all of the conditions that are given."""
    for condition in conditions:
        rows = rows if condition is None else rows.filter(condition)
    return rows


def catalogue_page(drugs: DataFrame, coverage: DataFrame, aliases: DataFrame, compounds: DataFrame, products: DataFrame, query: str = "", status: str | None = None, limit: int = 50, offset: int = 0) -> dict[str, DataFrame]:
    """A page of the catalogue: ``items`` in the order of name and id, ``total`` of all that fit, and ``status_counts`` of the whole catalogue.

    drugs (drug_id, preferred_name, ...), coverage (drug_id, status and the
    flags of STEPS), aliases (drug_id, alias), compounds (drug_id, compound_id),
    products (drug_id, regulatory_product_id, marketing_status).  ``query`` is
    looked for in names and aliases in any case, ``%`` and ``_`` being
    wildcards; ``status`` is one of STEPS.  An item has its numbers of compounds
    and products and its different marketing states in order, which are counted
    for the page alone.
    """
    if status is not None and status not in STEPS:
        raise ValueError(f"unknown coverage status: {status}")
    if not 1 <= limit <= 250 or offset < 0:
        raise ValueError("a page has 1 to 250 items and begins at 0 or later")
    pattern = f"%{query.strip().lower()}%"
    whole = drugs.join(coverage, "drug_id")
    if query.strip():
        named = aliases.filter(F.lower("alias").like(pattern)).select("drug_id", F.lit(True).alias("__named")).distinct()
        whole = whole.join(named, "drug_id", "left")
    fits = all_of(whole, F.col("status") == status if status else None, (F.lower("preferred_name").like(pattern) | F.col("__named").isNotNull()) if query.strip() else None).drop("__named")
    page = fits.orderBy("preferred_name", "drug_id").offset(offset).limit(limit)
    keys = F.broadcast(page.select("drug_id"))  # 250 at most
    n_compounds = compounds.join(keys, "drug_id", "left_semi").groupBy("drug_id").agg(F.count(F.lit(1)).alias("compound_count"))
    sold = products.join(keys, "drug_id", "left_semi").groupBy("drug_id").agg(F.count(F.lit(1)).alias("product_count"), F.array_sort(F.collect_set("marketing_status")).alias("marketing_statuses"))
    items = page.join(n_compounds, "drug_id", "left").join(sold, "drug_id", "left").withColumn("marketing_statuses", F.coalesce("marketing_statuses", F.array().cast("array<string>"))).na.fill(0, ["compound_count", "product_count"]).orderBy("preferred_name", "drug_id")
    counts = coverage.agg(*[F.coalesce(F.sum(F.col(s).cast("bigint")), F.lit(0)).alias(s) for s in STEPS])
    return {"items": items, "total": fits.agg(F.count(F.lit(1)).alias("total")), "status_counts": counts}


def status_report(tables: dict[str, DataFrame], jobs: DataFrame, stamps: list[str], tie: str, limit: int = 25) -> dict[str, DataFrame]:
    """The state of an installation: rows of each table, jobs (with ``status``) by state, the latest jobs, and those that need someone."""
    counts = None
    for name, t in tables.items():
        own = t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        counts = own if counts is None else counts.unionByName(own)
    latest = jobs.withColumn("latest", F.coalesce(*stamps)).orderBy(F.col("latest").desc_nulls_last(), F.col(tie)).limit(limit)
    return {"tables": counts, "job_statuses": jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "recent": latest, "exceptions": exceptions(jobs, [tie], ("failed", "blocked"), stamps[0])}


def child_counts(parents: DataFrame, key: str, lists: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(key, list, n): of each parent and list (table with the key, column) its different values; 0 where it has none."""
    counts = None
    for name, (child, value) in lists.items():
        own = child.groupBy(key).agg(F.countDistinct(value).alias("n"))
        part = parents.select(key).join(own, key, "left").select(key, F.lit(name).alias("list"), F.coalesce("n", F.lit(0)).alias("n"))
        counts = part if counts is None else counts.unionByName(part)
    return counts


def child_lists(parents: DataFrame, key: str, lists: dict[str, tuple[DataFrame, list[Column], int | None]]) -> DataFrame:
    """(key, list, place, item): the members of each parent's lists in order, from 1 on, as JSON objects.

    A list is a table with the key, the order of its rows and how many of them
    a page shows (None: all).  Members stay rows, so that a parent with very
    many is nobody's array; where a list is limited, Spark limits a parent's
    rows in every partition before it shuffles them.
    """
    out = None
    for name, (child, order, limit) in lists.items():
        fields = [c for c in child.columns if c != key]
        own = child.join(parents.select(key).distinct(), key, "left_semi").withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order)))
        own = own if limit is None else own.filter(F.col("place") <= limit)
        part = own.select(key, F.lit(name).alias("list"), "place", canonical_json(own, *fields).alias("item"))
        out = part if out is None else out.unionByName(part)
    return out


def evidence_chain(drugs: DataFrame, participants: DataFrame, links: DataFrame, spans: DataFrame) -> DataFrame:
    """Distinct evidence of each drug: drugs (drug, compound), participants (reaction, compound, role) of which the produced ones count, links (reaction, relationship_type, evidence_span), spans (evidence_span, ...)."""
    made = participants.filter("role = 'produced'").select("reaction", "compound").distinct()
    reactions = drugs.join(made, "compound").select("drug", "reaction").distinct()
    return reactions.join(links, "reaction").distinct().join(spans, "evidence_span")


def convert(rows: DataFrame, rules: list[tuple[str, str, Column]], out: list[Column]) -> DataFrame:
    """Rows with outcome and reason: rules are (outcome, reason, condition), the first that holds counts; others are accepted and get the ``out`` columns."""
    why = F.coalesce(*[F.when(c, F.struct(F.lit(o).alias("outcome"), F.lit(r).alias("reason"))) for o, r, c in rules], F.struct(F.lit("accepted").alias("outcome"), F.lit(None).cast("string").alias("reason")))
    return rows.withColumn("__why", why).select(F.col("__why.outcome").alias("outcome"), F.col("__why.reason").alias("reason"), *out)
