"""Removal of repeated substrings with suffix arrays.

A byte goes if it lies in a string of LENGTH bytes that also starts earlier
(smaller document id, or the same document further left).

1. Candidates are found by hashing, not by sorting: every string of LENGTH
   bytes picks one anchor in it, its GRAM-byte gram of least hash, so equal
   strings pick equal grams at the same place.  Only the hashes of anchors are
   compared; those met once cannot belong to a repeat, and their strings are
   never sorted.
2. The strings of the other anchors, as one context for each anchor, are dealt
   to shards by the anchor's hash: equal strings meet in one shard.
3. A shard's contexts are sorted by Larsson-Sadakane refinement, common
   prefixes follow by Kasai's recurrence, and in each run of suffixes with
   LENGTH common bytes all but the earliest are repeats.
4. A shard of more than SHARD_BYTES (an anchor found everywhere makes one) is
   cut into parts of about that size; each is sorted by itself, and the parts'
   first occurrences are merged by binary search in each other's sorted lists.
   There a string stands for itself by two independent 64-bit hashes.

Contexts that are byte for byte the same as an earlier one of the same block of
documents are repeats already and are not sent at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.common import Spans, blocks, column, free_name, longs, mix, one_text_a_key, partitions, small_lists, stage, text_buffers, tidy

#: Bytes of a repeat, and of the grams that anchor it.
LENGTH, GRAM = 100, 32
#: Bytes of contexts that a suffix array is built over; shards are meant to hold half as many.
SHARD_BYTES = 2_000_000
#: Bytes of text whose anchors meet in one group.
RANGE_BYTES = 4_000_000
#: Bytes of contexts that leave a task together.
BATCH_BYTES = 32_000_000
_CHARS = 7  # of 9 bits in a word


# --- anchors -------------------------------------------------------------------------------


class Anchors:
    """Anchors of a block: gram hash, document row, first and last start of the strings that pick it, and its number in its document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        n, w = len(data), length - gram + 1
        empty = np.zeros(0, np.int64)
        self.hash, self.row, self.first, self.last, self.number = np.zeros(0, np.uint64), empty, empty, empty, empty
        if n < length:
            return
        at = np.arange(n - gram + 1)
        h = Spans(data).hash(at, at + gram)
        shift = np.uint64(max(int(n).bit_length(), 22))
        key = (h >> shift << shift) | at.astype(np.uint64)
        m = -(-len(key) // w) * w
        padded = np.full(m, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(key)] = key
        grid = padded.reshape(-1, w)
        head = np.minimum.accumulate(grid, axis=1).ravel()
        tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = n - length + 1
        best = (np.minimum(tail[:starts], head[w - 1 : w - 1 + starts]) & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
        sizes = np.maximum(np.diff(offsets) - length + 1, 0)
        row = np.repeat(np.arange(len(sizes)), sizes)
        valid = np.arange(len(row)) + np.repeat(offsets[:-1] - (np.cumsum(sizes) - sizes), sizes)
        best = best[valid]
        new = np.ones(len(best), bool)
        new[1:] = (best[1:] != best[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        # the least of many hashes is small: mixed again, anchors fall evenly into ranges
        self.hash, self.row, self.first = mix(h[best[begin]]), row[begin], valid[begin]
        self.last = valid[np.append(begin[1:], len(best)) - 1] if len(begin) else empty
        lead = np.searchsorted(self.row, np.arange(len(sizes)))
        self.number = np.arange(len(begin)) - lead[self.row]


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by key and the starts of the groups in it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    return order, np.flatnonzero(new)


def _first_of_each(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether each span is the first of its bytes, in the given order of the spans."""
    seen, first = set(), np.zeros(len(order), bool)
    raw, starts, ends = data.tobytes(), starts.tolist(), ends.tolist()
    for i in order.tolist():
        own = raw[starts[i] : ends[i]]
        if own not in seen:
            seen.add(own)
            first[i] = True
    return first


def _shared_anchors(texts: DataFrame, length: int, gram: int, ranges: int) -> DataFrame:
    """(doc, numbers): packed numbers of the anchors of each document whose hash is met elsewhere; several rows for a document."""

    @tidy
    def scan(batches):
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                a = Anchors(data, offsets, length, gram)
                ids = column(part, "doc").to_numpy(zero_copy_only=False)
                order, begin = _groups(a.hash)
                sizes = np.diff(np.append(begin, len(order)))
                here = np.zeros(len(order), bool)
                here[order] = np.repeat(sizes > 1, sizes)
                out = {"p": [], "doc": [], "hashes": [], "docs": [], "numbers": []}
                cuts = np.searchsorted(a.row, np.arange(part.num_rows + 1))
                for r in range(part.num_rows):  # met twice in this block: known at once
                    own = a.number[cuts[r] : cuts[r + 1]][here[cuts[r] : cuts[r + 1]]]
                    if len(own):
                        for name, x in (("p", -1), ("doc", int(ids[r])), ("hashes", b""), ("docs", b""), ("numbers", own.astype("<u4").tobytes())):
                            out[name].append(x)
                one = order[begin]  # each hash once; already in order of the hashes
                p = (a.hash[one] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
                edge = np.searchsorted(p, np.arange(ranges + 1))
                for k in np.flatnonzero(np.diff(edge)):
                    s = one[edge[k] : edge[k + 1]]
                    # 32 bits more within a range; a chance hit costs work only
                    for name, x in (("p", int(k)), ("doc", None), ("hashes", (a.hash[s] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()), ("docs", ids[a.row[s]].astype("<i8").tobytes()), ("numbers", a.number[s].astype("<u4").tobytes())):
                        out[name].append(x)
                yield pa.RecordBatch.from_pydict(out, schema)

    schema = pa.schema([("p", pa.int32()), ("doc", pa.int64()), ("hashes", pa.binary()), ("docs", pa.binary()), ("numbers", pa.binary())])
    found = stage(texts.mapInArrow(scan, "p int, doc bigint, hashes binary, docs binary, numbers binary"))

    def meet(group: pa.Table) -> pa.Table:
        join = lambda c, kind: np.frombuffer(b"".join(group.column(c).to_pylist()), kind)
        h, docs, numbers = join("hashes", "<u4"), join("docs", "<i8"), join("numbers", "<u4")
        order, begin = _groups(h)
        sizes = np.diff(np.append(begin, len(order)))
        hit = order[np.repeat(sizes > 1, sizes)]
        docs, numbers = docs[hit], numbers[hit]
        order, begin = _groups(docs)
        packed = [x.tobytes() for x in np.split(numbers[order], begin[1:])] if len(order) else []
        return pa.table({"doc": pa.array(docs[order[begin]], pa.int64()), "numbers": pa.array(packed, pa.binary())})

    met = found.filter("p >= 0").select("p", "hashes", "docs", "numbers").groupBy("p").applyInArrow(meet, "doc bigint, numbers binary")
    return found.filter("p < 0").select("doc", "numbers").unionByName(met)


# --- suffix arrays -------------------------------------------------------------------------


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, by Larsson-Sadakane refinement, and the packed words of 7 symbols.

    Symbols are 1 to 256; a 0 ends a string (the last symbol has to be one), and
    equal strings come in the order of their places.  Only groups that are not
    yet single are sorted again, by the ranks of what follows.
    """
    n = len(text)
    words = np.zeros(n + 32 * _CHARS, np.uint64)
    padded = np.zeros(n + _CHARS, np.uint64)
    padded[:n] = text
    alive = np.ones(n, bool)
    for k in range(_CHARS):
        words[:n] = words[:n] << np.uint64(9) | np.where(alive, padded[k : k + n], np.uint64(0))
        alive &= padded[k : k + n] != 0
    # suffixes whose string ends within a word differ by place; the others are in groups of equal words
    long_, short = np.flatnonzero(alive), np.flatnonzero(~alive)
    sa = long_[np.argsort(words[long_])]
    short = short[np.lexsort((short, words[short]))]
    at = np.searchsorted(words[sa], words[short])
    new = np.ones(len(sa), bool)
    new[1:] = words[sa[1:]] != words[sa[:-1]]
    sa, new = np.insert(sa, at, short), np.insert(new, at, True)
    h = _CHARS
    rank = np.zeros(n, np.int64)
    while True:
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, n))
        rank[sa] = np.repeat(starts, sizes)
        at = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(at):
            return sa, words
        pos = sa[at]
        key = rank[pos] << 32 | rank[pos + h]
        order = np.argsort(key)
        sa[at] = pos[order]
        key = key[order]
        new[at[1:]] |= key[1:] != key[:-1]
        h *= 2


def common_prefixes(sa: np.ndarray, words: np.ndarray, lanes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, up to ``most``, of a suffix and the one before it in order, for ``counts`` suffixes from each lane's start.

    Kasai's recurrence: the next suffix shares at most one symbol less. All lanes take a step at a time.
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int16)
    edges = np.uint64(1) << (np.arange(_CHARS, dtype=np.uint64) * np.uint64(9))
    length = np.zeros(len(lanes), np.int64)
    for j in range(int(counts.max()) if len(counts) else 0):
        live = np.flatnonzero(counts > j)
        a = lanes[live] + j
        b = before[a]
        size = np.maximum(length[live] - 1, 0)
        size[b < 0] = 0
        todo = np.flatnonzero((b >= 0) & (size < most))
        while len(todo):
            x = words[a[todo] + size[todo]] ^ words[b[todo] + size[todo]]
            same = x == 0
            size[todo] += _CHARS - np.searchsorted(edges, x, "right")
            todo = todo[same]
            todo = todo[size[todo] < most]
        size = np.minimum(size, most)
        length[live] = size
        out[a] = size
    return out


class Contexts:
    """Strings of a shard in the order of documents and places, joined with a separator.

    Of equal contexts the earliest stays; ``again`` has the runs of the others.
    With ``alone`` unset, anchors that then have one context are left out too:
    an equal string would have brought another.
    """

    def __init__(self, docs: np.ndarray, starts: np.ndarray, counts: np.ndarray, anchors: np.ndarray, data: np.ndarray, length: int, alone: bool = True):
        cuts = np.concatenate(([0], np.cumsum(counts + length - 1)))
        order = np.lexsort((starts, docs))
        keep = _first_of_each(data, cuts[:-1], cuts[1:], order)[order]
        late = order[~keep]
        self.again = docs[late], starts[late], starts[late] + counts[late] + length - 1
        order = order[keep]
        if not alone:
            _, at, often = np.unique(anchors[order], return_inverse=True, return_counts=True)
            order = order[often[at] > 1]
        self.docs, self.starts, self.counts = docs[order], starts[order], counts[order]
        sizes = np.diff(cuts)[order]
        self.lanes = np.cumsum(sizes + 1) - sizes - 1
        flat = np.arange(int(sizes.sum())) + np.repeat(cuts[:-1][order] - (np.cumsum(sizes) - sizes), sizes)
        place = np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)
        self.text = np.zeros(len(flat) + len(sizes), np.int16)
        self.text[place] = data[flat].astype(np.int16) + 1
        self.length = length

    def repeats(self) -> np.ndarray:
        """Which of all positions start a string that starts at an earlier position too."""
        n = len(self.text)
        out = np.zeros(n, bool)
        self.is_start = out
        if not n:
            return out
        sa, words = suffix_array(self.text)
        lcp = common_prefixes(sa, words, self.lanes, self.counts, self.length)
        begins = np.zeros(n + 1, np.int32)
        begins[self.lanes] += 1
        np.subtract.at(begins, self.lanes + self.counts, 1)
        self.is_start = np.cumsum(begins[:-1]) > 0
        own = sa[self.is_start[sa]]
        new = lcp[own] < self.length
        if len(own):
            new[0] = True
        first = np.flatnonzero(new)
        low = np.minimum.reduceat(own, first) if len(own) else own
        out[own] = own != np.repeat(low, np.diff(np.append(first, len(own))))
        return out

    def runs(self, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, first byte, end) of the bytes covered by runs of marked starts and by contexts that were met again."""
        edge = np.diff(np.concatenate(([0], marked.view(np.int8), [0])))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        lane = np.searchsorted(self.lanes, a, "right") - 1
        shift = self.starts[lane] - self.lanes[lane]
        own = self.docs[lane], a + shift, b - 1 + shift + self.length
        return tuple(np.concatenate(x) for x in zip(own, self.again, strict=True))


def _contexts(texts: DataFrame, wanted: DataFrame, length: int, gram: int, shards: int) -> DataFrame:
    """A row for each context of the wanted anchors, with its shard; contexts that repeat one of the same block have shard -1 and no bytes.

    Rows are as many as contexts; a row for each block and shard would be as many as blocks times shards.
    """
    names = ["shard", "doc", "start", "count", "anchor", "data"]

    @tidy
    def run(batches):
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                a = Anchors(data, offsets, length, gram)
                cuts = np.searchsorted(a.row, np.arange(part.num_rows + 1))
                packed = column(part, "numbers").to_pylist()
                pairs = np.frombuffer(b"".join(packed), "<u4").astype(np.int64).reshape(-1, 2)
                first, many = pairs[:, 0] + np.repeat(cuts[:-1], [len(x) // 8 for x in packed]), pairs[:, 1]
                pick = np.arange(int(many.sum())) + np.repeat(first - (np.cumsum(many) - many), many)
                ids = column(part, "doc").to_numpy(zero_copy_only=False)
                docs, first, last = ids[a.row[pick]], a.first[pick], a.last[pick]
                starts, counts, end = first - offsets[a.row[pick]], last - first + 1, last + length
                new = _first_of_each(data, first, end, np.lexsort((starts, docs)))
                shard = np.where(new, (a.hash[pick] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), np.uint64(0)).astype(np.int64) - ~new
                sizes = np.where(new, end - first, 0)
                total = np.concatenate(([0], np.cumsum(sizes)))
                i = 0
                while i < len(pick):
                    j = max(i + 1, int(np.searchsorted(total, total[i] + BATCH_BYTES, "right")) - 1)
                    own, at = sizes[i:j], total[i : j + 1] - total[i]
                    flat = np.arange(int(at[-1])) + np.repeat(first[i:j] - at[:-1], own)
                    text = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[flat]))])
                    yield pa.RecordBatch.from_arrays([*(pa.array(x[i:j]) for x in (shard, docs, starts, counts)), longs(a.hash[pick[i:j]]), text], names=names)
                    i = j

    return texts.join(wanted, "doc").mapInArrow(run, "shard bigint, doc bigint, start bigint, count bigint, anchor bigint, data binary")


_RUNS = "doc bigint, a bigint, b bigint"


def _open(group: pa.Table, length: int, alone: bool) -> Contexts:
    docs, starts, counts, anchors = (group.column(c).to_numpy() for c in ("doc", "start", "count", "anchor"))
    data, _ = text_buffers(group.column("data").combine_chunks())
    return Contexts(docs, starts, counts, anchors, data, length, alone)


def _ranges_of(shared: DataFrame) -> DataFrame:
    """(doc, numbers, m): each document's m anchor numbers as packed pairs (first, how many); numbers of a copied passage follow each other."""

    @tidy
    def run(batches):
        for batch in batches:
            out, m = [], []
            for x in column(batch, "numbers").to_pylist():
                own = np.unique(np.frombuffer(b"".join(x), "<u4")).astype(np.int64)
                first = np.flatnonzero(np.diff(own, prepend=-2) != 1)
                out.append(np.stack((own[first], np.diff(np.append(first, len(own)))), axis=1).astype("<u4").tobytes())
                m.append(len(own))
            yield pa.RecordBatch.from_arrays([column(batch, "doc"), pa.array(out, pa.binary()), pa.array(m, pa.int64())], names=["doc", "numbers", "m"])

    return shared.groupBy("doc").agg(F.collect_list("numbers").alias("numbers")).mapInArrow(run, "doc bigint, numbers binary, m bigint")


def repeated_runs(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, a, b): byte ranges to remove, which may touch or overlap."""
    spark = texts.sparkSession
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shared = _shared_anchors(texts, length, gram, max(partitions(spark), -(-total // RANGE_BYTES)))
    wanted = stage(_ranges_of(shared))
    anchors = wanted.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    wanted = small_lists(wanted.select("doc", "numbers"), F.length("numbers"))
    shards = max(partitions(spark), -(-anchors * (length + gram) // (SHARD_BYTES // 2)))
    found = stage(_contexts(texts, wanted, length, gram, shards))
    local = found.filter("shard < 0").select("doc", F.col("start").alias("a"), (F.col("start") + F.col("count") + (length - 1)).alias("b"))

    # only shards that are cut are listed
    n_bytes = F.sum(F.col("count") + (length - 1))
    parts = stage(found.filter("shard >= 0").groupBy("shard").agg(F.ceil(n_bytes / SHARD_BYTES).cast("int").alias("parts")).filter("parts > 1"))
    dealt = found.filter("shard >= 0").join(small_lists(parts, F.lit(0)), "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("doc", "start"), F.col("parts")))

    def sort_shard(group: pa.Table) -> pa.Table:
        parts = group.column("parts")[0].as_py()
        own = _open(group, length, alone=parts > 1)
        marked = own.repeats()
        docs, a, b = own.runs(marked)
        none = np.full(len(docs), -1)
        table = {"doc": docs, "a": a, "b": b, "r": none, "one": none, "two": none}
        if parts > 1:  # first occurrences, in the order of their digests
            at = np.flatnonzero(own.is_start & ~marked)
            raw = np.maximum(own.text - 1, 0).astype(np.uint8)
            one, two = Spans(raw).hash(at, at + length), Spans(raw, base=1).hash(at, at + length)
            by = np.lexsort((two, one))
            at, one, two = at[by], one[by], two[by]
            lane = np.searchsorted(own.lanes, at, "right") - 1
            start = own.starts[lane] + at - own.lanes[lane]
            more = {"doc": own.docs[lane], "a": start, "b": start + length, "r": ((one >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64), "one": one.view(np.int64), "two": two.view(np.int64)}
            table = {k: np.concatenate((table[k], more[k])) for k in table}
        shard = group.column("shard")[0].as_py()
        return pa.table({"shard": np.full(len(table["doc"]), shard), "part": np.full(len(table["doc"]), group.column("part")[0].as_py()), **table})

    sorted_ = stage(dealt.groupBy("shard", "part").applyInArrow(sort_shard, "shard bigint, part bigint, doc bigint, a bigint, b bigint, r bigint, one bigint, two bigint"))

    def merge(group: pa.Table) -> pa.Table:
        docs, a, b, part = (group.column(c).to_numpy() for c in ("doc", "a", "b", "part"))
        one, two = (group.column(c).to_numpy().view(np.uint64) for c in ("one", "two"))
        late = np.zeros(len(docs), bool)
        lists = [np.flatnonzero(part == p) for p in np.unique(part)]
        order = np.lexsort((a, docs))
        age = np.empty(len(docs), np.int64)  # earlier strings have smaller numbers
        age[order] = np.arange(len(docs))
        by = np.lexsort((two, one))
        new = np.ones(len(by), bool)
        new[1:] = (one[by][1:] != one[by][:-1]) | (two[by][1:] != two[by][:-1])
        every, second = one[by][new], two[by][new]  # the merged list
        first, place = np.full(len(every), len(docs)), np.zeros(len(docs), np.int64)
        for own in lists:  # each part's strings find their places in it by binary search: equal first hashes are a run, the second decides within it
            low, high = np.searchsorted(every, one[own]), np.searchsorted(every, one[own], "right")
            for k in range(int((high - low).max(initial=0))):
                spot = np.minimum(low + k, high - 1)
                hit = second[spot] == two[own]
                place[own[hit]] = spot[hit]
            np.minimum.at(first, place[own], age[own])
        for own in lists:
            late[own] = age[own] > first[place[own]]
        return pa.table({"doc": docs[late], "a": a[late], "b": b[late]})

    across = sorted_.filter("r >= 0").groupBy("shard", "r").applyInArrow(merge, _RUNS)
    return local.unionByName(sorted_.filter("r < 0").select("doc", "a", "b")).unionByName(across)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", cut_text: bool = False) -> DataFrame:
    """The rows of ``docs`` with ``kept`` (binary: the remaining bytes), ``n_bytes``, ``n_removed`` and ``spans`` (start, end of each removed run).

    ``kept`` may end or begin inside a character where a run does.  With
    ``cut_text`` the text itself is replaced by what is left of it and there is
    no ``kept``: a character of which a run took some bytes goes whole, and
    null texts stay null.

    A null text is empty.  Documents come in the order of their ids, null ids
    last; texts that share an id, or have none, come in the order of a hash,
    and rows that repeat id and text are one document, which loses what repeats
    elsewhere earlier.  All other columns pass through, but for those of the
    new names, which are replaced.  An empty table gives an empty result.
    """
    docs = docs.drop("kept", "n_bytes", "n_removed", "spans")
    gram = min(GRAM, max(1, length // 3))
    key = free_name([*docs.columns, "spans"], "__key")
    keyed = one_text_a_key(docs, id_col, text_col, key)
    texts = keyed.select(F.col(key).alias("doc"), F.col(text_col).alias("text"))

    @tidy
    def unite(batches):
        for batch in batches:
            out = []
            for ranges in column(batch, "ranges").to_pylist():
                own = []
                for a, b in sorted((x["a"], x["b"]) for x in ranges):
                    if own and a <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], b)
                    else:
                        own.append([a, b])
                out.append([{"start": a, "end": b} for a, b in own])
            yield pa.RecordBatch.from_arrays([column(batch, "doc"), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=[key, "spans"])

    spans_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    ranges = repeated_runs(texts, length, gram).groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    spans = stage(ranges.mapInArrow(unite, T.StructType([T.StructField(key, T.LongType()), T.StructField("spans", spans_type)])))
    joined = keyed.join(small_lists(spans, 40 * F.size("spans")), key, "left").select(*docs.columns, "spans")
    more = [T.StructField("kept", T.BinaryType())] * (not cut_text) + [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", spans_type)]
    schema = T.StructType([*docs.schema.fields, *more])
    at = docs.columns.index(text_col)

    @tidy
    def cut(batches):
        for batch in batches:
            for part, data, offsets in blocks(batch, text_col):
                kept, gone = [], []
                lists = [x or [] for x in column(part, "spans").to_pylist()]
                for r, own in enumerate(lists):
                    text, to, pieces = data[offsets[r] : offsets[r + 1]].tobytes(), 0, []
                    for x in own:
                        pieces.append(text[to : x["start"]])
                        to = x["end"]
                    kept.append(b"".join([*pieces, text[to:]]) if own else text)
                    gone.append(sum(x["end"] - x["start"] for x in own))
                cols = part.columns[:-1]
                if cut_text:
                    null = part.column(at).is_null().to_pylist()
                    cols[at] = pa.array([None if z else k.decode("utf-8", "ignore") for k, z in zip(kept, null, strict=True)], pa.string())
                else:
                    cols.append(pa.array(kept, pa.binary()))
                last = pa.array(lists, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(offsets)), pa.array(gone, pa.int64()), last], names=schema.names)

    return joined.mapInArrow(cut, schema)
