"""Whole catalogues against one record after the other."""

import hashlib
import random
import re

import pytest

from attesta.operators import ingest

KEYS = ("AAAAAAAAAAAAAA-BBBBBBBBBB-C", "AAAAAAAAAAAAAA-CCCCCCCCCC-D", "AAAAAAAAAAAAAA-DDDDDDDDDD-E", "EEEEEEEEEEEEEE-BBBBBBBBBB-C")


def stable(prefix, *parts):
    return f"{prefix}:" + hashlib.sha256("|".join(p or "" for p in parts).encode()).hexdigest()[:24]


def normal(text):
    return re.sub("[^a-z0-9]+", " ", (text or "").lower()).strip()


def record(seq, name, flag=False, ids=None, aliases=(), key=None, compound=None, products=(), modality=None, form=None):
    c = None if key is None and compound is None else (compound, None, None, key, form, None)
    return (seq, name, modality, flag, None, ids or {}, [(a, None) for a in aliases], c, [(None, j, a, p, *[None] * 7) for j, a, p in products])


def frame(spark, rows):
    return spark.createDataFrame(rows, ingest.RECORD)


def one_by_one(rows, source, db=None):
    """drug ids, aliases, identifiers, structures and routes; an error as (seq, kind)."""
    db = db or {"alias": set(), "ids": {}, "structures": {}, "links": set(), "routes": {}}
    for seq, name, _, flag, _, ids, aliases, compound, _ in rows:
        key = compound[3] if compound else None
        pairs = [(n, v) for n, values in ids.items() for v in values]
        hits = {d for p in pairs for d in db["ids"].get((*p, source), set()) | {x for (a, b, s), own in db["ids"].items() if (a, b) == p for x in own}} | (db["structures"].get(key, set()) if key else set())
        if len(hits) > 1:
            return seq, "several drugs"
        of_name = {d for d, n in db["alias"] if n == normal(name)}
        if not hits and key and "CHEMBL" not in ids and any(d in own for own in db["structures"].values() for d in of_name):
            return seq, "another structure"
        if flag and not hits:
            reason = ("unmatched_existing_drug", "name_only_match_requires_review", "ambiguous_name_match")[min(2, len(of_name))]
            db["links"] |= {("source_record", normal(name), d) for d in of_name}
            db["routes"][seq] = (None, "excluded", reason)
            continue
        drug = hits.pop() if hits else stable("drug", source, f"CHEMBL:{ids['CHEMBL'][0]}" if "CHEMBL" in ids else normal(name))
        db["routes"][seq] = (drug, "accepted", None)
        db["alias"] |= {(drug, normal(a)) for a in (name, *(a for a, _ in aliases))}
        for p in pairs:
            db["ids"].setdefault((*p, source), {drug})
        if key:
            db["structures"].setdefault(key, set()).add(drug)
    return db


def random_rows(seed, n=60):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        ids = {"K": [f"k{r.randrange(40)}"] for _ in range(r.random() < 0.6)} | {"L": [f"l{r.randrange(40)}", f"l{r.randrange(40)}"] for _ in range(r.random() < 0.2)}
        rows.append(record(i * 3, f"Name-{r.randrange(25)}", r.random() < 0.4, ids, [f"name {r.randrange(30)}"] if r.random() < 0.3 else []))
    return rows


@pytest.mark.parametrize("seed", [2, 8])
def test_equals_one_by_one(spark, seed):
    rows = random_rows(seed)
    end = next(i for i in range(len(rows), 0, -1) if isinstance(one_by_one(rows[:i], "s"), dict))
    if end < len(rows):  # the first record that cannot be taken is named
        with pytest.raises(ValueError, match=f"record {one_by_one(rows, 's')[0]}: "):
            ingest.ingest_catalogue(frame(spark, rows), {}, "s", "1")
    want = one_by_one(rows[:end], "s")
    out = ingest.ingest_catalogue(frame(spark, rows[:end]).repartition(3), {}, "s", "1")
    assert {r.seq: (r.drug_id, r.outcome, r.reason) for r in out["routes"].collect()} == want["routes"]
    assert {(r.drug_id, r.normalized_alias) for r in out["drug_alias"].collect()} == want["alias"]
    assert {(r.namespace, r.identifier_value, r.drug_id) for r in out["drug_identifier"].collect()} == {(n, v, d) for (n, v, _), own in want["ids"].items() for d in own}
    sent = {(stable("source-record", "s", "1", n), d) for _, n, d in want["links"]}
    assert {(r.subject_id, r.object_id) for r in out["link_candidate"].collect() if r.subject_type == "source_record"} == sent
    assert {d.drug_id for d in out["drug_entity"].collect()} == {d for d, _, _ in want["routes"].values() if d}


def test_a_chain_of_records_is_one_drug(spark):
    rows = [record(i, f"Form {i}", i > 0, {"K": [f"k{i}", f"k{i + 1}"]}) for i in range(12)]
    out = ingest.ingest_catalogue(frame(spark, rows), {}, "s", "1")
    assert {r.drug_id for r in out["routes"].collect()} == {stable("drug", "s", "form 0")}
    # the other way round every record but the last needs what comes after it
    back = [record(11 - i, f"Form {i}", i > 0, {"K": [f"k{i}", f"k{i + 1}"]}) for i in range(12)]
    assert [r.outcome for r in ingest.ingest_catalogue(frame(spark, back), {}, "s", "1")["routes"].orderBy("seq").collect()] == ["excluded"] * 11 + ["accepted"]


def test_forms_of_one_drug_keep_their_structures(spark):
    rows = [record(i, n, ids={"TEST_DRUG": ["1"]}, key=KEYS[i], compound=f"example:{f}", form=f) for i, (n, f) in enumerate((("Example drug", "active_moiety"), ("Example drug hydrochloride", "salt"), ("Example drug stereoisomer", "stereoisomer")))]
    out = ingest.ingest_catalogue(frame(spark, rows), {}, "pubchem", "1")
    assert out["drug_entity"].count() == 1
    assert {r.compound_id: (r.material_form, r.inchi_key, r.connectivity_key) for r in out["compound"].collect()} == {f"example:{f}": (f, KEYS[i], "A" * 14) for i, f in enumerate(("active_moiety", "salt", "stereoisomer"))}
    again = ingest.ingest_catalogue(frame(spark, rows), out, "pubchem", "1")  # a second time nothing changes
    for table in ingest.CATALOGUE:
        assert sorted(map(str, again[table].collect())) == sorted(map(str, out[table].select(again[table].columns).collect())), table


def test_medicines_wait_for_their_drug(spark):
    medicine = [record(1, "Paracetamol", True, products=[("EU", None, "EMEA/1")])]
    out = ingest.ingest_catalogue(frame(spark, medicine), {}, "ema", "1")
    assert out["routes"].first().reason == "unmatched_existing_drug" and out["drug_entity"].count() == 0 and out["link_candidate"].count() == 0
    stored = ingest.ingest_catalogue(frame(spark, [record(1, "PARACETAMOL", ids={"CHEMBL": ["CHEMBL112"]}, key=KEYS[0])]), {}, "chembl", "37")
    out = ingest.ingest_catalogue(frame(spark, medicine), stored, "ema", "1")
    assert out["routes"].first().reason == "name_only_match_requires_review" and out["regulatory_product"].count() == 0
    assert [(r.subject_type, r.object_id, r.relationship_type) for r in out["link_candidate"].collect()] == [("source_record", stable("drug", "chembl", "CHEMBL:CHEMBL112"), "possible_drug_identity")]
    by_structure = [record(1, "Paracetamol", True, key=KEYS[0], products=[("EU", None, "EMEA/1"), ("EU", " 7 ", None)])]
    out = ingest.ingest_catalogue(frame(spark, by_structure), stored, "ema", "1")
    assert out["regulatory_product_drug"].count() == 2 and {r.drug_id for r in out["regulatory_product_drug"].collect()} == {stable("drug", "chembl", "CHEMBL:CHEMBL112")}
    assert {(r.application_number, r.product_number, r.marketing_status) for r in out["regulatory_product"].collect()} == {(None, "EMEA/1", "unknown"), ("7", None, "unknown")}


@pytest.mark.parametrize(("rows", "error"), [
    ([record(1, "A", key=KEYS[0]), record(4, "a", key=KEYS[3])], "record 4: its name is known with another structure"),
    ([record(1, "A", ids={"K": ["1"]}), record(2, "B", ids={"K": ["2"]}), record(3, "C", ids={"K": ["1", "2"]})], "record 3: its identifiers and structure match several drugs"),
    ([record(1, " - ")], "record 1: preferred_name"), ([record(1, "A", modality="biologic")], "unsupported chemical modality"), ([record(1, "A", key="AAA")], "27 characters"),
    ([record(1, "A", key=KEYS[0], form="crystal")], "unsupported material_form"), ([record(1, "A", products=[("EU", None, " ")])], "regulatory product requires"), ([], "no records"),
])
def test_a_fault_fails_the_whole_file(spark, rows, error):
    with pytest.raises(ValueError, match=error):
        ingest.ingest_catalogue(frame(spark, rows), {}, "s", "1")
