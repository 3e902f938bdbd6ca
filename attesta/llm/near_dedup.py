"""Near-duplicate documents by MinHash with odd sketches.

Every document gives the set of its word shingles, k MinHash values of it, a
key for each band of r values, and an odd sketch: the k samples folded into a
bitmap by parity, so that the population count of two sketches' XOR tells how
many samples differ, and from it the similarity, sharpest where it is high.

Equal sets collapse to one representative first.  Documents of a band bucket
are compared with the bucket's first; the sketches sort out unlikely pairs and
full shingle sets confirm the others.  Buckets that then hold more than one
component are compared in blocks, member by member across components; so a
bucket of near copies costs as many comparisons as it has members, no link is
lost, and no list of pairs is ever made.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import blocks, column, long_lists, longs, mix, small, stage, tidy, word_hashes, word_spans
from attesta.llm.components import components

#: Values in a band.
ROWS = 5
#: Chance that a pair at the threshold shares no band.
MISS = 1e-6
#: Bits of an odd sketch.
BITS = 512
#: Members of a block when a bucket's components are compared with each other.
BLOCK = 512
#: Partners of a document whose sets one part of the confirmation compares with its own.
PARTNERS = 64
#: Shingles of such a block, on an average.
BLOCK_SHINGLES = 1_000_000
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def bands(threshold: float) -> int:
    """Bands of ROWS values so that a pair at the threshold is missed with probability MISS at most."""
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the word shingles of each row, and n+1 offsets. Fewer words than ``width`` make one shingle, no words none."""
    starts, ends, words = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    total = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        total = mix(total * _K1 + h[k : k + len(total)] + _K2)
    parts, sizes = [], []
    for a, b in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.unique(total[a : b - width + 1])
        elif b > a:
            x = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                x = mix(x * _K3 + h[k : k + 1] + _K2)
            own = x
        else:
            own = total[:0]
        parts.append(own)
        sizes.append(len(own))
    return np.concatenate(parts) if parts else total[:0], np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def _multipliers(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77)
    return rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(1, 1 << 63, k, dtype=np.uint64)


def minhashes(sets: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """k MinHash values (32 bits) of each set; those of an empty set are all the largest value."""
    a, b = _multipliers(k)
    out = np.full((len(offsets) - 1, k), 0xFFFFFFFF, np.uint64)
    for i in range(len(offsets) - 1):
        own = sets[offsets[i] : offsets[i + 1]]
        for j in range(0, len(own), 1024):
            part = a[:, None] * own[None, j : j + 1024] + b[:, None]
            np.minimum(out[i], part.min(axis=1) >> np.uint64(32), out=out[i])
    return out


def sketches(samples: np.ndarray) -> np.ndarray:
    """Odd sketches, BITS/64 words each: bit parity of the samples that fall on it."""
    n, k = samples.shape
    spot = (mix(samples + np.arange(1, k + 1, dtype=np.uint64) * _K3) >> np.uint64(32)) % np.uint64(BITS)
    count = np.bincount((np.arange(n)[:, None] * BITS + spot.astype(np.int64)).ravel(), minlength=n * BITS).reshape(n, BITS)
    return np.packbits(count & 1 == 1, axis=1, bitorder="little").view(np.uint64)


def most_bits(threshold: float, k: int) -> int:
    """XOR bits up to which a pair may still reach the threshold (six standard deviations): half the bits at most, where a sketch says nothing."""
    differ = 2 * (k * (1 - threshold) + 6 * math.sqrt(k * threshold * (1 - threshold)))
    p = (1 - (1 - 2 / BITS) ** differ) / 2
    return math.ceil(BITS * p + 6 * math.sqrt(BITS * p * (1 - p)))


def _signatures(docs: DataFrame, id_col: str, text_col: str, width: int, n_bands: int) -> DataFrame:
    @tidy
    def run(batches):
        k = n_bands * ROWS
        for batch in batches:
            for part, data, offsets in blocks(batch, text_col):
                sets, cuts = shingles(data, offsets, width)
                n = part.num_rows
                sample = minhashes(sets, cuts, k)
                keys = np.zeros((n, n_bands), np.uint64)
                for r in range(ROWS):
                    keys = mix(keys * _K1 + sample[:, r::ROWS] + np.arange(n_bands, dtype=np.uint64) * _K2)
                one, two = np.zeros(len(sets) + 1, np.uint64), np.zeros(len(sets) + 1, np.uint64)
                np.cumsum(mix(sets + _K1), out=one[1:])
                np.cumsum(mix(sets ^ _K2), out=two[1:])
                flat = np.arange(n + 1)
                yield pa.RecordBatch.from_arrays(
                    [column(part, id_col).cast(pa.int64()), pa.array(np.diff(cuts)), longs(one[cuts[1:]] - one[cuts[:-1]]), longs(two[cuts[1:]] - two[cuts[:-1]]), long_lists(keys.ravel(), flat * n_bands), long_lists(sketches(sample).ravel(), flat * (BITS // 64))],
                    names=["id", "n_shingles", "s1", "s2", "keys", "sketch"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, "id bigint, n_shingles bigint, s1 bigint, s2 bigint, keys array<bigint>, sketch array<bigint>")


def _sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    @tidy
    def run(batches):
        for batch in batches:
            for part, data, offsets in blocks(batch, text_col):
                sets, cuts = shingles(data, offsets, width)
                yield pa.RecordBatch.from_arrays([column(part, "id"), long_lists(sets, cuts)], names=["id", "shingles"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), text_col).mapInArrow(run, "id bigint, shingles array<bigint>")


def _confirm(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, share: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) of ids whose full shingle sets are similar enough."""
    pairs = stage(pairs)
    ends = pairs.select(F.col("u").alias(id_col)).unionByName(pairs.select(F.col("v").alias(id_col))).distinct()
    ends = small(stage(ends))
    sets = stage(_sets(docs.select(F.col(id_col).cast("bigint").alias(id_col), text_col).join(ends, id_col, "left_semi"), id_col, text_col, width))
    # partners of a document are dealt to parts; its set goes once to each of them
    parts = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("parts"))
    dealt = stage(pairs.join(parts, "u").select("u", F.pmod(F.xxhash64("v"), F.col("parts")).alias("part"), "v"))
    heads = dealt.select("u", "part").distinct().select("u", "part", F.lit(None).cast("bigint").alias("v"), F.col("u").alias("id"))
    rows = heads.unionByName(dealt.withColumn("id", F.col("v"))).join(sets, "id").drop("id")

    @tidy
    def run(batches):
        head = None
        for batch in batches:
            out = []
            lists = column(batch, "shingles")
            flat, cuts = lists.values.to_numpy(), lists.offsets.to_numpy()
            for r, (u, v) in enumerate(zip(column(batch, "u").to_pylist(), column(batch, "v").to_pylist(), strict=True)):
                own = flat[cuts[r] : cuts[r + 1]]
                if v is None:
                    head = own.copy()
                    continue
                common = len(np.intersect1d(head, own, assume_unique=True))
                if share[1] * common >= share[0] * (len(head) + len(own) - common):
                    out.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["u", "v"])

    ordered = rows.repartition("u", "part").sortWithinPartitions("u", "part", F.col("v").asc_nulls_first())
    return stage(ordered.mapInArrow(run, "u bigint, v bigint"))


def _differ(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)


def _near(group: pa.Table, limit: int) -> np.ndarray:
    """Which members of a bucket (or of two blocks of it) may be linked by their sketches, as a symmetric matrix: those of different components.

    A pair that shares an earlier band is left to that band's bucket.
    """
    ids, comp, block = (group.column(c).to_numpy() for c in ("id", "component", "own"))
    i, j, band = (group.column(c)[0].as_py() for c in ("i", "j", "band"))
    flat = lambda c: np.ascontiguousarray(group.column(c).combine_chunks().flatten().to_numpy()).view(np.uint64)
    n = len(ids)
    sketch, keys = flat("sketch").reshape(n, -1), flat("keys").reshape(n, -1)[:, :band]
    near = np.zeros((n, n), bool)
    for r in np.flatnonzero(block == i):
        c = np.flatnonzero((block == j) & (comp != comp[r]) & ((ids > ids[r]) | (i != j)))
        c = c[np.bitwise_count(sketch[c] ^ sketch[r]).sum(axis=1) <= limit]
        near[r, c[~(keys[c] == keys[r]).any(axis=1)]] = True
    return near | near.T


def _links(group: pa.Table, limit: int, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Links between near members of a bucket (or of two blocks of it), confirmed on full sets: enough of them to hold together what they link."""
    ids, near = group.column("id").to_numpy(), _near(group, limit)
    some = np.flatnonzero(near.any(axis=1))
    if not len(some):
        return ids[:0], ids[:0]
    lists = group.column("shingles").combine_chunks().take(pa.array(some))
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    _, at, often = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    met = often > 1  # shingles of one document alone are in no intersection
    col, row = (np.cumsum(met) - 1)[at][met[at]], np.repeat(np.arange(len(some)), sizes)[met[at]]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    common = np.zeros((len(some), len(some)), np.float32)  # counts below 2^24 are exact
    for k in range(0, int(met.sum()), 4096):
        a, b = np.searchsorted(col, (k, k + 4096))
        x = np.zeros((len(some), 4096), np.float32)
        x[row[a:b], col[a:b] - k] = 1
        common += x @ x.T
    common = common.astype(np.int64)
    linked = near[np.ix_(some, some)] & (share[1] * common >= share[0] * (sizes[:, None] + sizes[None, :] - common))
    us, vs, left = [], [], np.ones(len(some), bool)
    while left.any():  # a tree for each component of the links
        reach = [int(np.argmax(left))]
        left[reach[0]] = False
        for x in reach:
            new = np.flatnonzero(linked[x] & left)
            left[new] = False
            reach.extend(new.tolist())
            us.extend([ids[some[x]]] * len(new))
            vs.extend(ids[some[new]].tolist())
    return np.array(us, np.int64), np.array(vs, np.int64)


def near_dedup(docs: DataFrame, width: int = 5, share: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) per row: documents are linked where share[1] * |A and B| >= share[0] * |A or B|.

    Null texts are empty; without words a document is linked with nothing.
    ``component_id`` is the smallest id reachable, and that row stays.  Rows
    with a null id link with nothing and stay; rows that repeat an id are one
    document, of the largest of their texts.  An empty table gives an empty
    result; other columns are left behind and may have any name.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias(id_col), text_col)
    docs = rows
    if rows.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").limit(1).count():
        docs = rows.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(text_col).alias(text_col)).unionByName(rows.filter(F.col(id_col).isNull()))
    threshold = share[0] / share[1]
    n_bands = bands(threshold)
    limit = most_bits(threshold, n_bands * ROWS)
    every = stage(_signatures(docs, id_col, text_col, width, n_bands))
    signed = every.filter("id is not null and n_shingles > 0")
    classes = stage(signed.groupBy("n_shingles", "s1", "s2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    # by id, of which each has one row: a class with very many copies is no hot key
    own = stage(signed.select("id", "n_shingles", "keys", "sketch").join(classes.select(F.col("rep").alias("id")), "id", "left_semi"))

    keyed = own.select("id", "n_shingles", F.posexplode("keys").alias("band", "key"))
    buckets = keyed.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    crowded = stage(keyed.join(buckets, "key"))
    candidates = crowded.filter("id <> first").select(F.col("first").alias("u"), F.col("id").alias("v")).distinct()
    left = own.select(F.col("id").alias("u"), F.col("sketch").alias("a"))
    right = own.select(F.col("id").alias("v"), F.col("sketch").alias("b"))
    likely = candidates.join(left, "u").join(right, "v").select("u", "v", _differ("a", "b").alias("d")).filter(F.col("d") <= limit)
    # the likeliest partner of each document is confirmed now; what this leaves apart is compared below
    first = likely.groupBy("v").agg(F.min(F.struct("d", "u")).getField("u").alias("u")).select("u", "v")
    edges = _confirm(first, docs, id_col, text_col, width, share)

    label = components(edges)
    member = crowded.join(label, "id", "left").select("key", "band", "id", "n_shingles", F.coalesce("component", "id").alias("component"))
    split = member.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("size")).filter("low < high")
    n_blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("size") / BLOCK_SHINGLES)).cast("int")
    apart = stage(member.join(split.select("key", "m", "size"), "key").withColumn("blocks", n_blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    dealt = apart.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "band", "id", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def screen(group: pa.Table) -> pa.Table:
        return group.select(["key", "band", "id", "component", "own", "i", "j"]).take(pa.array(np.flatnonzero(_near(group, limit).any(axis=1))))

    # sketches go to every bucket of a document, full sets only to those where they may link it
    sketched = own.select("id", "keys", "sketch")
    close = stage(dealt.join(sketched, "id").groupBy("key", "i", "j").applyInArrow(screen, dealt.schema))
    sets = _sets(docs.select(F.col(id_col).cast("bigint").alias(id_col), text_col).join(small(stage(close.select(F.col("id").alias(id_col)).distinct())), id_col, "left_semi"), id_col, text_col, width)
    full = stage(sketched.join(sets, "id"))

    def across(group: pa.Table) -> pa.Table:
        u, v = _links(group, limit, share)
        return pa.table({"u": u, "v": v})

    more = close.join(full, "id").groupBy("key", "i", "j").applyInArrow(across, "u bigint, v bigint")
    edges = edges.unionByName(stage(more))

    label = components(edges)
    # labels of representatives go to their copies
    copies = signed.select("id", "n_shingles", "s1", "s2").join(small(stage(classes.filter("copies > 1").drop("copies")), 250_000), ["n_shingles", "s1", "s2"]).select("id", F.col("rep")).filter("id <> rep")
    copies = copies.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    # a representative that is alone is its own component
    final = label.select("id", "component").unionByName(copies)
    known = every if docs is rows else rows.select(F.col(id_col).alias("id")).join(every.filter("id is not null").select("id", "n_shingles"), "id").unionByName(every.filter("id is null").select("id", "n_shingles"))
    out = known.select("id", "n_shingles").join(final, "id", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id").isNull() | (F.col("id") == F.col("component_id"))).alias("kept"))
