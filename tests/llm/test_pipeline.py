import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from attesta.llm import toxicity
from tests.llm import test_line_dedup, test_near_dedup, test_packing

D = "/root/testdata/sf0.001"


def blank(t):
    return not (t or "").strip("\t\n\x0b\x0c\r ")


def lines(rows):
    """Texts without repeated lines, by brute force."""
    seen, out = [], {}
    for k, t in sorted(rows):
        kept = []
        for x in (t or "").split("\n"):
            w = tuple(test_near_dedup.re.findall(r"[^\x20\x09-\x0D]+", test_near_dedup.re.sub("[A-Z]", lambda m: m[0].lower(), x)))
            again = bool(w) and any(w == v or (min(len(w), len(v)) >= 5 and abs(len(w) - len(v)) < 2 and test_line_dedup.apart(w, v)) for v in seen)
            if w:
                seen.append(w)
            if not again:
                kept.append(x)
        out[k] = "\n".join(kept)
    return {k: out[k] for k, t in rows if not blank(out[k]) or blank(t)}


def passages(rows, length=100):
    seen, out = set(), {}
    for k, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(b[i : i + length])
        out[k] = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
    return {k: out[k] for k, t in rows if not blank(out[k]) or blank(t)}


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{D}/labels.parquet").select("doc_id", F.col("toxic").alias("label")))
    left = {}
    for r in docs.collect():
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        f, c, d, _ = toxicity.features(raw, np.array([0, len(raw)]))
        if model.score(f, c, d, 1)[0][0] < 0.5:
            left[r.doc_id] = r.text
    left = lines(list(left.items()))
    kept = test_near_dedup.brute(list(left.items()), 5, (80, 100))
    left = {k: t for k, t in left.items() if kept[k][2]}
    left = passages(list(left.items()))
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {}
    for k, x in left.items():
        n = len(t.encode(x, add_special_tokens=False).ids) + 1
        want |= {(k, i): min(2048, n - at) for i, at in enumerate(range(0, n, 2048))}
    rows = cp.run(spark, D).collect()
    assert {(r.doc_id, r.piece): r.length for r in rows} == want and len(rows) == len(want)
    assert test_packing.check(rows, 2048) <= -(-sum(want.values()) // 2048) + 2


def test_stages_keep_columns_and_bear_odd_rows(spark):
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (3, "é" * 500, "x", "s", 9), (4, "é" * 500, "x", "s", 9), (5, " \n", "x", "s", 2), (None, "one two three four five six", "x", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, table, D)
            assert out.columns == cp.COLUMNS
            assert {r.doc_id for r in out.collect()} >= ({1, 2, 3, 5, None} if table is docs else set())
        assert cp.STAGES[-1][1](spark, table, D).count() == (0 if table is not docs else 6)
