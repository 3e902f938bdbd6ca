import hashlib
import random
import re

import numpy as np
import pytest

from attesta.llm import common
from attesta.llm import line_dedup as ld
from attesta.llm.queries import op10_line_dedup


def apart(a, b, edits=1):
    """Word-level Levenshtein distance of at most ``edits``: by the whole table, or for one by trying every edit."""
    if edits == 1:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        if len(a) < len(b):
            a, b = b, a
        return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] <= edits


def brute(rows, all_pairs=True, edits=1, least=5):
    lines = []
    for k, t in sorted(rows):
        for i, x in enumerate((t or "").split("\n")):
            w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x))
            if w:
                lines.append((k, i, tuple(w)))
    gone, seen, by_part = set(), {}, {}
    for k, i, w in lines:
        near = False
        if w not in seen and len(w) >= least and edits:
            pool = seen if all_pairs else {v for x in shorter(w) for v in by_part.get(x, ())}
            near = any(len(v) >= least and apart(w, v, edits) for v in pool if abs(len(v) - len(w)) <= edits)
        if w in seen or near:
            gone.add((k, i))
        if w not in seen and not all_pairs:
            for x in shorter(w):
                by_part.setdefault(x, []).append(w)
        seen.setdefault(w, 1)
    out = {}
    for k, t in rows:
        own = (t or "").split("\n") if t is not None else []
        kept = [x for i, x in enumerate(own) if (k, i) not in gone]
        out[k] = (len(own), len(own) - len(kept), None if t is None else hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def shorter(w):
    """The line and what is left of it without one of its words (of long ones the line alone): lines one word apart have one of these in common."""
    return {w} | {w[:i] + w[i + 1 :] for i in range(len(w)) if len(w) < 1000}


def got(df):
    return {r.doc_id: (r.n_lines, r.n_removed, None if r.text is None else hashlib.sha256(r.text.encode()).hexdigest()) for r in df.collect()}


def test_within():
    r = random.Random(0)
    for _ in range(20_000):
        a, b = ([r.randrange(2) for _ in range(r.randrange(0, 7))] for _ in range(2))
        for edits in range(4):
            assert ld.within(a, b, edits) == apart(a, b, edits), (a, b, edits)


def test_variants_equal_runs():
    words = np.random.default_rng(0).integers(0, common.PRIME, 50, dtype=np.uint64)
    sums = common.Runs(words)
    for cut in ([10], [29], [15], [10, 11], [12, 28], [11, 20, 29]):
        short = common.Runs(np.delete(words[10:30], [c - 10 for c in cut]))
        assert sums.without(np.array([10]), np.array([cut]), np.array([30])) == short.hash(np.array([0]), np.array([20 - len(cut)]))


def test_edges(spark):
    r = random.Random(1)
    vocab = ["a", "b", "c", "the", "of", "éa", "x" * 40]
    rows = []
    for k in range(120):
        own = []
        for _ in range(r.randrange(0, 9)):
            w = [r.choice(vocab) for _ in range(r.randrange(0, 9))]
            own.append("  ".join(w) if r.random() < 0.3 else " ".join(w).upper())
        rows.append((k * 7 % 120, "\n".join(own)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "w " * 30_000), (204, "w " * 29_999), (205, "solo line here\r\nsolo line here"), (1 << 40, rows[0][1])]
    df = spark.createDataFrame([(k, t, "key", 5) for k, t in rows], "doc_id long, text string, h string, n_chars int").repartition(5)
    out = ld.line_dedup(df)
    assert out.columns == ["doc_id", "text", "h", "n_chars", "n_lines", "n_removed"]
    want, have = brute(rows), got(out)
    assert have == want, [(k, dict(rows)[k], want[k], have[k]) for k in want if want[k] != have[k]][:3]


def test_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "one two"), (3, "one two"), (3, "one two")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in ld.line_dedup(df).collect()) == [(0, ""), (3, "one two"), (3, "one two")]
    assert ld.line_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize(("edits", "least"), [(0, 1), (1, 1), (1, 3), (2, 4), (3, 6)])
def test_every_bound(spark, edits, least):
    r = random.Random(edits * 10 + least)
    vocab = ["a", "b", "c", "of", "éa"]
    rows = [(k, "\n".join(" ".join(r.choice(vocab) for _ in range(r.randrange(0, 12))) for _ in range(r.randrange(0, 6)))) for k in range(90)]
    rows.append((500, "w " * 40))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, have = brute(rows, edits=edits, least=least), got(ld.line_dedup(df, edits=edits, least_words=least))
    assert have == want, [(k, dict(rows)[k], want[k], have[k]) for k in want if want[k] != have[k]][:3]


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    """A line's place is that in its own text: what another text of the id has there does not count."""
    rows = [(1, "x y z one two three\nfirst"), (3, "q w e r t y\nx y z one two four"), (3, "second\nx y z one two three"), (None, "q w e r t z"), (None, "second"), (None, "second"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = [(r.doc_id, r.text) for r in ld.line_dedup(df).collect()]
    assert sorted(out, key=str) == sorted([(1, "x y z one two three\nfirst"), (3, "q w e r t y"), (3, "second"), (None, ""), (None, ""), (None, ""), (None, None)], key=str)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, 6, 7, 8), (2, "A  b", 5, 6, 7, 8)], "doc_id long, text string, N_lines int, n_removed int, __key int, __drop int")
    out = ld.line_dedup(df)
    assert out.columns == ["doc_id", "text", "__key", "__drop", "n_lines", "n_removed"]
    assert sorted(map(tuple, out.collect())) == [(1, "a b", 7, 8, 1, 0), (2, "", 7, 8, 1, 1)]


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    out = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in op10_line_dedup(spark, d).collect()}
    assert out == brute(rows, all_pairs=False)


def test_orders_of_two_words_are_told_apart(spark):
    # sums of powers modulo 2^64 cancel out for these
    for n in (1024, 4096):
        order = [bin(i).count("1") % 2 for i in range(n)]
        rows = [(0, " ".join("ab"[x] for x in order)), (1, " ".join("ba"[x] for x in order)), (2, " ".join("ab"[x] for x in order))]
        assert {k: v[1] for k, v in got(ld.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"))).items()} == {0: 0, 1: 0, 2: 1}
