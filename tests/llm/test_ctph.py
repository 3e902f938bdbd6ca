import hashlib
import random

from attesta.llm import ctph
from attesta.llm.queries import op7_fingerprints


def levenshtein(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_edit_distances():
    r = random.Random(1)
    pairs = [("".join(r.choice("abc") for _ in range(r.randrange(0, 20))), "".join(r.choice("abc") for _ in range(r.randrange(0, 90)))) for _ in range(2500)]
    assert ctph.edit_distances(pairs).tolist() == [levenshtein(a, b) for a, b in pairs]


def plain(data: bytes) -> str:
    """The fingerprint byte by byte; chunk characters come from the chunk's own text."""
    n = len(data)
    if not n:
        return "2::"
    zeros = []
    for i in range(n):
        w = [data[i - k] if i >= k else 0 for k in range(7)]
        h = (sum(w) + sum(x * (7 - k) for k, x in enumerate(w))) & 0xFFFFFFFF
        s = 0
        for k, x in enumerate(w):
            s ^= (x << (5 * k)) & 0xFFFFFFFF
        h = (h + s) & 0xFFFFFFFF
        h ^= h >> 16
        h = h * 0x7FEB352D & 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x846CA68B & 0xFFFFFFFF
        h ^= h >> 16
        zeros.append(32 if h == 0 else (h & -h).bit_length() - 1)
    k = max(2, (max(n - 1, 1) // 64).bit_length())
    while k > 2 and sum(z >= k for z in zeros) < 16:
        k -= 1
    parts = []
    for j in (k, k + 1):
        cuts = [i + 1 for i, z in enumerate(zeros) if z >= j]
        cuts = cuts if cuts and cuts[-1] == n else [*cuts, n]
        parts.append([data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)])
    return k, parts


def test_chunks_equal_the_plain_form():
    r = random.Random(2)
    words = [bytes(r.randrange(97, 123) for _ in range(r.randrange(1, 9))) for _ in range(300)]
    texts = [b"", b"a", b"ab " * 400, *(b" ".join(r.choice(words) for _ in range(r.randrange(1, 700))) for _ in range(40))]
    char = {}
    for t, fp in zip(texts, ctph.fingerprints(texts), strict=True):
        if not t:
            assert fp == plain(t)
            continue
        k, (one, two) = plain(t)
        level, s1, s2 = fp.split(":")
        assert int(level) == k and len(s1) == len(one) and len(s2) == len(two)
        for c, chunk in zip(s1 + s2, one + two, strict=True):
            assert char.setdefault(chunk, c) == c
    assert ctph.fingerprints(texts[::-1]) == ctph.fingerprints(texts)[::-1]


def test_likeness():
    r = random.Random(4)
    mk = lambda n: bytes(r.randrange(97, 123) for _ in range(n))
    a, b = mk(5000), mk(5000)
    fa, fb, fe, fh = ctph.fingerprints([a, b, a[:2000] + b"XX" + a[2001:], a * 2])
    same, near, other, _ = ctph.likeness([(fa, fa), (fa, fe), (fa, fb), (fa, fh)])
    assert same == 1 and near > 0.9 and other < 0.3


def brute(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (k, t) in enumerate(rows):
        u = rows[(i + 1) % len(rows)][1] or ""
        t = t or ""
        m = len(t) // 3
        e = t[: len(t) - m] + u[:m]
        f, g, h = ctph.fingerprints([t.encode(), e.encode(), u.encode()])
        out[k] = (len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, *ctph.likeness([(f, g), (f, h)]))
    return out


def test_edges(spark):
    rows = [(1, "é" * 10), (2, None), (3, ""), (4, "x y z " * 3000), (-5, "abc"), (1 << 60, "abc")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, p string").repartition(3)
    assert {r.doc_id: tuple(r)[1:] for r in ctph.with_edits(df).collect()} == brute(rows)
    assert ctph.with_edits(df.limit(0)).count() == 0
    one = ctph.with_edits(df.filter("doc_id = 4")).collect()[0]
    assert one.near_next == 1
    assert ctph.with_edits(spark.createDataFrame([(None, "a"), (2, "b"), (2, "c")], "doc_id long, text string")).count() == 3


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in op7_fingerprints(spark, d).collect()}
    assert got == brute(rows)
    own, nxt = sorted(v[4] for v in got.values()), sorted(v[5] for v in got.values())
    assert own[len(own) // 2] > 0.5 > nxt[len(nxt) // 2]
