"""Removal of repeated and nearly repeated lines by deletion neighbourhoods.

Lines are sequences of words, compared without regard to case and spacing.  A
line goes if an earlier one, by document and line number, is the same or at
most ``edits`` words away (words more, less or other).  For the latter every
line emits its variants with up to ``edits`` words deleted as hashed keys: two
lines within the bound share one.  Where the words were deleted, told as gaps
between those that are left, decides how far apart two lines with a common
variant are: gap by gap the greater number of deleted words.  Lines with equal
key and gaps are reduced to their earliest, and so are gaps with a common
part: no key makes pairs.  The edit distance to the earliest line is verified.

Lines one word apart also share their first or last half.  With ``edits`` = 1
only lines that share a half with a different line emit variants; nothing is
lost by that.
"""

from __future__ import annotations

from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.common import Runs, blocks, column, free_name, long_lists, longs, one_text_a_key, small_lists, stage, tidy, word_hashes, word_spans

#: Variants that one numpy step makes.
STEP = 1 << 19


class Lines:
    """Lines with words of a block: word hashes, n+1 offsets into them, row and number of each line."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, _ = word_spans(data, offsets)
        self.words = word_hashes(data, starts, ends)
        breaks = np.concatenate(([0], np.cumsum(data == 10, dtype=np.int64)))
        row = np.searchsorted(offsets, starts, "right") - 1
        number = breaks[starts] - breaks[offsets[row]] if len(starts) else starts
        new = np.ones(len(starts), bool)
        new[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
        first = np.flatnonzero(new)
        self.cuts = np.append(first, len(starts))
        self.row, self.number = row[first], number[first]


def _occurrences(docs: DataFrame) -> DataFrame:
    """Every line with words: its hash, of two independent numbers, and its place.  The first of its document also has how often it occurs there, its number of words and the hashes of its halves (two lengths of each)."""
    names = ["h", "g", "doc", "line", "often", "n", "p0", "p1", "s0", "s1"]

    @tidy
    def run(batches):
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                own = Lines(data, offsets)
                sums = Runs(own.words)
                a, b = own.cuts[:-1], own.cuts[1:]
                n, h, g = b - a, sums.hash(a, b), Runs(own.words, 1).hash(a, b)
                order = np.lexsort((np.arange(len(h)), g, h, own.row))
                new = np.ones(len(h), bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1]) | (own.row[order][1:] != own.row[order][:-1])
                often = np.zeros(len(h), np.int64)
                often[order[new]] = np.diff(np.append(np.flatnonzero(new), len(h)))
                lo, hi = (n - 1) // 2, (n + 1) // 2
                ids = column(part, "doc").to_numpy(zero_copy_only=False)
                # of n-1, n and n+1 words two lengths of a half differ; which half it is and its length are part of the key
                cols = [h, g, ids[own.row], own.number, often, n, sums.hash(a, a + lo), sums.hash(a, a + hi), ~sums.hash(b - lo, b), ~sums.hash(b - hi, b)]
                yield pa.RecordBatch.from_arrays([longs(c) if c.dtype == np.uint64 else pa.array(c.astype(np.int64)) for c in cols], names=names)

    return docs.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def _words_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(seq, h, g, words) of the wanted (doc, lines), numbered in the order of documents and lines."""

    @tidy
    def run(batches):
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                own = Lines(data, offsets)
                sums = Runs(own.words)
                ids, lists = column(part, "doc").to_numpy(zero_copy_only=False), column(part, "lines").to_pylist()
                at = np.searchsorted(own.row, np.arange(part.num_rows + 1))
                pick = [at[r] + np.flatnonzero(np.isin(own.number[at[r] : at[r + 1]], lists[r])) for r in range(part.num_rows)]
                pick = np.concatenate(pick) if pick else np.zeros(0, np.int64)
                a, b = own.cuts[:-1][pick], own.cuts[1:][pick]
                cuts = np.concatenate(([0], np.cumsum(b - a)))
                flat = np.arange(cuts[-1]) - np.repeat(cuts[:-1] - a, b - a)
                yield pa.RecordBatch.from_arrays([longs(sums.hash(a, b)), longs(Runs(own.words, 1).hash(a, b)), pa.array(ids[own.row[pick]]), pa.array(own.number[pick]), long_lists(own.words[flat], cuts)], names=["h", "g", "doc", "line", "words"])

    found = stage(docs.join(wanted, "doc").mapInArrow(run, "h bigint, g bigint, doc bigint, line bigint, words array<bigint>"))
    # rows that repeat id and text are one document
    return found.repartitionByRange("doc", "line").dropDuplicates(["doc", "line"]).sortWithinPartitions("doc", "line").withColumn("seq", F.monotonically_increasing_id()).select("seq", "h", "g", "words")


def _cuts(n: np.ndarray, edits: int):
    """(lines, places) by and by: for every line of n words each choice of 1 to ``edits`` words that leaves one at least, places counted in the line."""
    for i in range(0, len(n), max(1, STEP // max(1, int(n.max(initial=1))))):
        some = np.arange(i, min(len(n), i + max(1, STEP // max(1, int(n.max(initial=1))))))
        owner = np.repeat(some, n[some])
        yield owner, (np.arange(len(owner)) - np.repeat(np.cumsum(n[some]) - n[some], n[some]))[:, None]
    for j in range(2, edits + 1):
        for m in np.unique(n[n >= j]).tolist():
            own, choices = np.flatnonzero(n == m), combinations(range(m), j)
            while some := list(islice(choices, STEP)):
                places = np.array(some)
                for i in range(0, len(own), max(1, STEP // len(places))):
                    lines = own[i : i + max(1, STEP // len(places))]
                    yield np.repeat(lines, len(places)), np.tile(places, (len(lines), 1))


def _variants(lines: DataFrame, edits: int) -> DataFrame:
    """(key, gaps, seq): each line's hash without gaps, and its variants with up to ``edits`` words deleted: a gap is named by the number of words left before it, once for each word deleted there."""
    names = ["key", "gaps", "seq"]

    @tidy
    def run(batches):
        for batch in batches:
            step = max(1, STEP * batch.num_rows // max(1, len(column(batch, "words").flatten())))
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                lists = column(part, "words")
                words = np.ascontiguousarray(lists.flatten().to_numpy()).view(np.uint64)
                cuts = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).astype(np.int64)
                sums, n = Runs(words), np.diff(cuts)
                seq = column(part, "seq")
                yield pa.RecordBatch.from_arrays([longs(sums.hash(cuts[:-1], cuts[1:])), pa.array([[]] * len(n), pa.list_(pa.int32())), seq], names=names)
                for owner, places in _cuts(n, edits):
                    j = places.shape[1]
                    keys = sums.without(cuts[:-1][owner], cuts[:-1][owner][:, None] + places, cuts[1:][owner])
                    gaps = pa.ListArray.from_arrays(pa.array(np.arange(len(owner) + 1, dtype=np.int32) * j), pa.array((places - np.arange(j)).astype(np.int32).ravel()))
                    yield pa.RecordBatch.from_arrays([longs(keys), gaps, seq.take(pa.array(owner))], names=names)

    return lines.mapInArrow(run, "key bigint, gaps array<int>, seq bigint")


def within(a: list[int], b: list[int], edits: int) -> bool:
    """Whether the edit distance of two word sequences is at most ``edits``."""
    if abs(len(a) - len(b)) > edits:
        return False
    head, n = 0, min(len(a), len(b))
    while head < n and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < n - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b or edits < 2:
        return max(len(a), len(b)) <= edits
    far = edits + 1
    row = {j: j for j in range(edits + 1)}
    for i, x in enumerate(a, 1):  # cells further than ``edits`` from the diagonal cannot matter
        new = {}
        for j in range(max(0, i - edits), min(len(b), i + edits) + 1):
            new[j] = i if not j else min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (x != b[j - 1]))
        row = new
    return row.get(len(b), far) <= edits


def _verified(pairs: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    @tidy
    def run(batches):
        for batch in batches:
            ok = pa.array([within(x, y, edits) for x, y in zip(column(batch, "a").to_pylist(), column(batch, "b").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([column(batch, c).filter(ok) for c in ("h", "g")], names=["h", "g"])

    a = lines.select("seq", "h", "g", F.col("words").alias("a"))
    b = lines.select(F.col("seq").alias("e"), F.col("words").alias("b"))
    return pairs.join(a, "seq").join(b, "e").select("h", "g", "a", "b").mapInArrow(run, "h bigint, g bigint")


def near_lines(docs: DataFrame, firsts: DataFrame, edits: int, least_words: int) -> DataFrame:
    """(h, g) of the distinct lines of ``least_words`` words or more that are at most ``edits`` words away from an earlier one of them."""
    firsts = firsts.filter(F.col("n") >= least_words)
    if edits == 1:
        halves = firsts.select("h", "g", F.explode(F.array_distinct(F.array("p0", "p1", "s0", "s1"))).alias("half"))
        shared = stage(halves.groupBy("half").agg(F.min("h").alias("x"), F.max("h").alias("y")).filter("x < y").select("half"))
        near = halves.join(shared.hint("merge"), "half").select("h", "g").distinct()
        firsts = firsts.join(near, ["h", "g"], "left_semi")
    wanted = stage(firsts.groupBy("doc").agg(F.collect_list("line").alias("lines")))  # of one text: no more than its lines
    lines = stage(_words_of(docs, small_lists(wanted, 8 * F.size("lines"))))

    every = stage(_variants(lines, edits))
    keys = stage(every.groupBy("key").agg(F.min("seq").alias("x"), F.max("seq").alias("y")).filter("x < y").select("key"))
    met = stage(every.join(keys.hint("merge"), "key"))
    first = stage(met.groupBy("key", "gaps").agg(F.min("seq").alias("e")))
    # two gaps lie within the bound if their sizes less what they have in common do: of each key, common part and size only the earliest line counts
    subsets = F.array_distinct(F.aggregate("gaps", F.array(F.array().cast("array<int>")), lambda t, x: F.concat(t, F.transform(t, lambda y: F.concat(y, F.array(x))))))
    parts = first.withColumn("common", F.explode(subsets))
    best = parts.groupBy("key", "common", F.size("gaps").alias("s")).agg(F.min("e").alias("e"))
    reach = parts.select("key", "gaps", "common").join(best, ["key", "common"]).filter(F.size("gaps") + F.col("s") - F.size("common") <= edits).groupBy("key", "gaps").agg(F.min("e").alias("e"))
    pairs = met.join(stage(reach).hint("merge"), ["key", "gaps"]).filter("e < seq").groupBy("seq").agg(F.min("e").alias("e"))
    return _verified(pairs, lines, edits).distinct()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 1, least_words: int = 5) -> DataFrame:
    """The rows of ``docs`` with repeated lines taken out of the text, and ``n_lines`` and ``n_removed``.

    A line goes if it is the same as an earlier one, or, where both have
    ``least_words`` words or more, at most ``edits`` words away from it: one
    word of a shorter line is much of what it says.  Removed lines count as
    earlier ones too.  Variants of a line of n words number n to the power of
    ``edits``; 0 leaves only the same lines out.

    Lines end at line feeds.  Lines without words are no repetitions and stay.
    A null text stays null and has no lines.  Documents come in the order of
    their ids, null ids last; texts that share an id, or have none, come in the
    order of a hash, and rows that repeat id and text are one document: a line
    that is the first at its place stays in each of them.  All other columns
    pass through, but for two of the new names, which are replaced; an empty
    table gives an empty result.
    """
    docs = docs.drop("n_lines", "n_removed")
    key, drop_col = free_name(docs.columns, "__key"), free_name(docs.columns, "__drop")
    keyed = one_text_a_key(docs, id_col, text_col, key)
    texts = keyed.select(F.col(key).alias("doc"), F.col(text_col).alias("text"))
    found = stage(_occurrences(texts))
    # a document has one first line for each hash, so that the least document tells its line
    firsts = found.filter("often > 0").groupBy("h", "g").agg(F.min("doc").alias("doc"), F.min_by("line", "doc").alias("line"), F.sum("often").alias("m"), *[F.max(c).alias(c) for c in ("n", "p0", "p1", "s0", "s1")])
    firsts = stage(firsts)
    gone = firsts.select("h", "g", F.col("doc").alias("d"), F.col("line").alias("l"), "m")
    if edits:
        near = stage(near_lines(texts, firsts, edits, least_words))
        gone = gone.join(near.withColumn("near", F.lit(True)), ["h", "g"], "left")
    else:
        gone = gone.withColumn("near", F.lit(None).cast("boolean"))
    gone = stage(gone.filter("m > 1 or near"))
    out = found.select("h", "g", "doc", "line").join(gone.hint("merge"), ["h", "g"]).filter(F.col("near").isNotNull() | (F.col("doc") != F.col("d")) | (F.col("line") != F.col("l")))
    drop = stage(out.groupBy("doc").agg(F.collect_set("line").alias(drop_col))).withColumnRenamed("doc", key)

    joined = keyed.join(small_lists(drop, 8 * F.size(drop_col)), key, "left").drop(key)
    names = [*docs.columns, "n_lines", "n_removed"]
    at = docs.columns.index(text_col)

    @tidy
    def run(batches):
        for batch in batches:
            for part, _, _ in blocks(batch, text_col):
                texts, total, removed = [], [], []
                for t, gone in zip(part.column(at).to_pylist(), column(part, drop_col).to_pylist(), strict=True):
                    own = t.split("\n") if t is not None else []
                    gone = set(gone or ()) if own else ()
                    texts.append("\n".join(x for i, x in enumerate(own) if i not in gone) if gone else t)
                    total.append(len(own))
                    removed.append(len(gone))
                cols = part.columns[:-1]
                cols[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=names)

    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.select(*docs.columns, drop_col).mapInArrow(run, schema)
