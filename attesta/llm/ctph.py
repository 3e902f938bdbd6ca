"""Context-triggered piecewise hashing.

A rolling hash over the last seven bytes ends a chunk where its mixed value has
at least k trailing zero bits, so boundaries depend on content alone and those
of block size 2^(k+1) are among those of 2^k.  Each chunk gives one character
(six bits of its hash).  A fingerprint ``k:signature:signature of k+1`` holds
two block sizes; two fingerprints compare where they share one, by edit
distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import Spans, column, range_bounds, range_key, ranges, sha256_hex, tidy

#: Bytes that the rolling hash sees.
WINDOW = 7
#: Smallest block size is 2^LEAST; about SIGNATURE chunks at most are aimed at, and at least a quarter of that.
LEAST, SIGNATURE = 2, 64
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: Bytes of text of a range of ids, which is a task's work.
RANGE_BYTES = 8_000_000
#: Code points of text that are fingerprinted together: the more, the fuller the tables of edit distances.
RUN_CHARS = 2 << 20
#: Pairs whose edit distances are computed side by side.
PAIRS = 1000


def rolling(data: np.ndarray) -> np.ndarray:
    """Sum, weighted sum and shift-xor of the last WINDOW bytes at each byte."""
    d = np.concatenate((np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32)))
    n = len(data)
    total, weighted, shifted = np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for k in range(WINDOW):
        x = d[WINDOW - 1 - k : WINDOW - 1 - k + n]
        total += x
        weighted += x * np.uint32(WINDOW - k)
        shifted ^= x << np.uint32(5 * k)
    return total + weighted + shifted


def fingerprints(texts: list[bytes]) -> list[str]:
    """The fingerprint of each text; an empty text has empty signatures."""
    gap = b"\0" * WINDOW
    data = np.frombuffer(gap.join([b"", *texts]), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths + WINDOW) - lengths
    h = rolling(data)
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    h ^= h >> np.uint32(16)
    spots = np.flatnonzero((h & np.uint32((1 << LEAST) - 1)) == 0)
    low = h[spots]
    zeros = np.where(low == 0, 32, np.bitwise_count((low & -low) - np.uint32(1))).astype(np.int8)
    spans = Spans(data)
    lo, hi = np.searchsorted(spots, starts), np.searchsorted(spots, starts + lengths)

    bounds, owners = [], []
    levels = []
    for i, n in enumerate(lengths.tolist()):
        if not n:
            levels.append(LEAST)
            continue
        at, z = spots[lo[i] : hi[i]], zeros[lo[i] : hi[i]]
        k = max(LEAST, (max(n - 1, 1) // SIGNATURE).bit_length())
        while k > LEAST and np.count_nonzero(z >= k) < SIGNATURE // 4:
            k -= 1
        levels.append(k)
        for j in (k, k + 1):
            ends = at[z >= j] + 1
            last = starts[i] + n
            if not len(ends) or ends[-1] != last:
                ends = np.append(ends, last)
            bounds.append(ends)
            owners.append((i, starts[i]))
    sizes = [len(b) for b in bounds]
    cuts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    ends = np.concatenate(bounds) if bounds else np.zeros(0, np.int64)
    begins = np.empty_like(ends)
    begins[1:] = ends[:-1]
    begins[cuts[:-1]] = [s for _, s in owners]
    chars = _ALPHABET[(spans.hash(begins, ends) >> np.uint64(58)).astype(np.int64)].tobytes().decode()
    out = [f"{LEAST}::"] * len(texts)
    for j in range(0, len(owners), 2):
        i = owners[j][0]
        out[i] = f"{levels[i]}:{chars[cuts[j] : cuts[j + 1]]}:{chars[cuts[j + 1] : cuts[j + 2]]}"
    return out


def edit_distances(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Levenshtein distances, many pairs at a time, row by row of the table."""
    out = np.zeros(len(pairs), np.int64)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))
    for at in range(0, len(order), PAIRS):
        some = order[at : at + PAIRS]
        la, lb = (np.array([len(pairs[i][j]) for i in some]) for j in (0, 1))
        a, b = (np.zeros((len(some), max(1, n.max())), np.uint8) for n in (la, lb))
        for r, i in enumerate(some):
            a[r, : la[r]] = np.frombuffer(pairs[i][0].encode(), np.uint8)
            b[r, : lb[r]] = np.frombuffer(pairs[i][1].encode(), np.uint8)
        steps = np.arange(b.shape[1] + 1, dtype=np.int32)
        prev = np.tile(steps, (len(some), 1))
        dist = np.where(la == 0, lb, 0)
        for i in range(int(la.max())):
            cur = np.empty_like(prev)
            cur[:, 0] = i + 1
            np.minimum(prev[:, 1:] + 1, prev[:, :-1] + (b != a[:, i : i + 1]), out=cur[:, 1:])
            cur -= steps
            np.minimum.accumulate(cur, axis=1, out=cur)
            cur += steps
            done = np.flatnonzero(la == i + 1)
            dist[done] = cur[done, lb[done]]
            prev = cur
        out[some] = dist
    return out


def likeness(pairs: list[tuple[str, str]]) -> list[float]:
    """0 to 1 for pairs of fingerprints: 1 less the edit distance over the longer signature, best of the block sizes that both hold; 0 if they share none."""
    out, todo, where = [0.0] * len(pairs), [], []
    for i, (x, y) in enumerate(pairs):
        if x == y:
            out[i] = 1.0
            continue
        (kx, x1, x2), (ky, y1, y2) = x.split(":"), y.split(":")
        step = int(kx) - int(ky)
        for p in {0: [(x1, y1), (x2, y2)], 1: [(x1, y2)], -1: [(x2, y1)]}.get(step, []):
            if p[0] and p[1]:
                todo.append(p)
                where.append(i)
    for i, p, d in zip(where, todo, edit_distances(todo).tolist(), strict=True):
        out[i] = max(out[i], 1 - d / max(len(p[0]), len(p[1])))
    return out


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(p, look, ord, id, text): rows dealt by ranges of ids, a range to a partition, and sorted downwards in each; the first row of the next range, or of all, follows with look = 1.

    Ranges hold about equal bytes of text, RANGE_BYTES or so while there are no
    more than RANGES of them for a shuffle partition, but for a longer text and
    for rows that share an id (null too); a few numbers for each range go
    through the driver.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bounds = range_bounds(rows, "id", F.octet_length("text") + 64, ranges(docs.sparkSession, total, RANGE_BYTES))
    ord_ = F.coalesce("id", F.lit(-(1 << 63)))
    ranged = rows.select(range_key(ord_, bounds).alias("p"), ord_.alias("ord"), "id", "text")
    tops = sorted(ranged.groupBy("p").agg(F.max("ord").alias("top")).collect())
    ahead = [(tops[i].top, tops[(i + 1) % len(tops)].p) for i in range(len(tops))]
    ahead = F.broadcast(docs.sparkSession.createDataFrame(ahead, "ord bigint, dest int"))
    both = ranged.join(ahead, "ord", "left").withColumn("to", F.explode(F.when(F.col("dest").isNull(), F.array(F.struct("p", F.lit(0).alias("look")))).otherwise(F.array(F.struct("p", F.lit(0).alias("look")), F.struct(F.col("dest").alias("p"), F.lit(1).alias("look"))))))
    return both.select("to.p", "to.look", "ord", "id", "text").repartitionById(len(bounds) + 1, F.col("p")).sortWithinPartitions("p", "look", F.col("ord").desc(), "text")


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of an edited form of it, and their likeness to each other and to the next text.

    The edited form has the last third replaced by the beginning of the next
    document in descending order of ids (after the last: the first).  Null
    texts are empty; null ids come last; rows that repeat an id follow each
    other in the order of their texts.  An empty table gives an empty result;
    other columns are left behind and may have any name, but the id column must
    not have that of a result.
    """
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def measure(rows):
        texts = [t for _, _, _, t in rows]
        edited = [t[: len(t) - len(t) // 3] + u[: len(t) // 3] for t, u in zip(texts, texts[1:], strict=False)]
        raw = [t.encode() for t in edited]
        own, other = fingerprints([t.encode() for t in texts]), fingerprints(raw)
        m = len(edited)
        near = likeness([*zip(own, other, strict=False), *zip(own, own[1:], strict=False)])
        full = [(r[2], len(r[3]), sha256_hex(raw[i]), own[i], other[i], near[i], near[m + i]) for i, r in enumerate(rows[:-1]) if not r[1] and r[0] == rows[i + 1][0]]
        if full:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*full, strict=True), kinds, strict=True)], names=names)

    @tidy
    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(column(batch, c).to_pylist() for c in ("p", "look", "id", "text")), strict=True):
                rows.append(row)
                size += len(row[3])
                if size > RUN_CHARS:
                    yield from measure(rows)
                    rows, size = rows[-1:], 0
        if len(rows) > 1:
            yield from measure(rows)

    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], f"{id_col} bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return in_order(docs, id_col, text_col).mapInArrow(run, f"{id_col} bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
