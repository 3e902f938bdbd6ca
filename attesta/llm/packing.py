"""Best-fit packing of token pieces by bin completion.

Lengths are integers up to the capacity, so all that a packing has to know is
how many pieces there are of each length: a histogram of at most ``capacity``
rows, however many documents there are.  Bin completion runs on it, depth
first: for the largest length left it enumerates the undominated fillings of
the room beside it, takes one as often as the counts allow, and on the way back
less often, and then the next.  A branch ends where its waste is more than a
packing with one bin less than the incumbent can have; the first incumbent is
best fit.  The search stops at the lower bound, or after ``nodes`` steps; what
it gives says whether fewer bins are impossible.  Pieces then find their place
by their rank among the pieces of their length, counted bucket by bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.common import blocks, column, free_name, partitions, stage, tidy
from attesta.llm.token_cache import ENCODE_BYTES, VOCABULARY, WORD_CHUNKS, encoder

#: Steps of the search, and of them those that one enumeration of fillings may take; None is no limit, and the plan then is optimal.
NODES, LOOK = 400_000, 4_000
#: Pieces of a bucket within which ranks are counted.
BUCKET_ROWS = 50_000


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and an end id, cut into pieces of at most ``capacity``.

    A null or empty text is one piece with the end id; a null id is an id like
    others, and rows that repeat an id have their pieces each by themselves.  An
    empty table gives an empty result; other columns are left behind and may have
    any name.
    """

    @tidy(keep=VOCABULARY)
    def run(batches):
        enc = encoder(vocabulary, WORD_CHUNKS)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part, _, _ in blocks(batch, text_col, ENCODE_BYTES):
                rows = []
                for k, ids in zip(column(part, id_col).to_pylist(), enc.ids([t or "" for t in column(part, text_col).to_pylist()]), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        rows.append((k, piece, at // 4, len(own) // 4, zlib.crc32(own)))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), text_col).mapInArrow(run, "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


class Budget:
    """Steps that are left."""

    def __init__(self, nodes: int | None):
        self.left = float("inf") if nodes is None else nodes


def fillings(counts: list[int], room: int, most_waste: int, budget: Budget, look: int | None = LOOK) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``room``, longest pieces first, with at most ``most_waste`` left: first an exact one of one or two pieces, then what a short search finds best, then the others by their waste.

    A filling to which a piece could be added, or in which one could be changed
    for a longer one, is dominated.  ``look`` bounds the steps of each search.
    """
    lengths = [x for x in range(min(room, len(counts) - 1), 0, -1) if counts[x]]
    if not lengths:
        if room <= most_waste:
            yield ()
        return
    given = set()

    def give(f):
        if f not in given:
            given.add(f)
            yield f

    if room < len(counts) and counts[room]:
        yield from give((room,))
        # any other filling without waste is one of parts of this piece's length: dominated
        return
    pair = next(((x, room - x) for x in lengths if 2 * x >= room and counts[room - x] > (2 * x == room)), None)
    if pair:
        yield from give(pair)
    for first_only in (True, False):
        if first_only and pair:
            continue  # nothing wastes less
        found = _search(counts, lengths, room, most_waste, first_only, budget, look)
        for _, f in found[:1] if first_only else found:
            yield from give(f)


def _search(counts: list[int], lengths: list[int], room: int, most_waste: int, first_only: bool, budget: Budget, look: int | None) -> list[tuple[int, tuple[int, ...]]]:
    """(waste, filling) of undominated fillings of ``lengths``, which fall, best first; if ``first_only``, of falling waste until none is left.

    A length is taken as often as it fits, and on the way back once less often: a step is a length or a way back, however many copies it means.
    """
    found, best, n = [], most_waste + 1, len(lengths)
    path: list[list[int]] = []
    at_start = budget.left if look is None else min(look, budget.left)
    steps, i, left = at_start, 0, room
    while steps >= 0 and not (first_only and not best):
        while i < n and left:
            k = min(left // lengths[i], counts[lengths[i]])
            if k:
                path.append([i, k])
                left -= k * lengths[i]
                steps -= 1
            i += 1
        if left < best and (not left or _undominated(counts, {lengths[j]: k for j, k in path}, left)):
            best = left if first_only else best
            found.append((left, tuple(x for j, k in path for x in [lengths[j]] * k)))
        if not path:
            break
        i, k = path.pop()
        left += lengths[i]
        steps -= 1
        if k > 1:
            path.append([i, k - 1])
        i += 1
    if at_start != float("inf"):
        budget.left -= at_start - max(steps, 0)
    found.sort(key=lambda f: (f[0], [-x for x in f[1]]))
    return found


def _undominated(counts: list[int], chosen: dict[int, int], left: int) -> bool:
    """Whether no piece fits in what is left, and none can take the place of a shorter one in it."""
    more = lambda x: counts[x] > chosen.get(x, 0)
    if any(more(x) for x in range(1, min(left, len(counts) - 1) + 1)):
        return False
    return not any(more(y) for x in chosen for y in range(x + 1, min(x + left, len(counts) - 1) + 1))


def best_fit(counts: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit on the histogram: the largest piece left, then always the largest that fits."""
    counts, out = list(counts), []
    for top in range(capacity, 0, -1):
        while counts[top]:
            own, left = [top], capacity - top
            for x in range(min(left, top), 0, -1):
                k = min(left // x, counts[x] - own.count(x))
                own += [x] * max(0, k)
                left -= x * max(0, k)
            often = min(counts[x] // own.count(x) for x in set(own))
            for x in own:
                counts[x] -= often
            out.append((tuple(own), often))
    return out


class Plan(NamedTuple):
    """Bins as (lengths, how often), their number, the least number that the lengths allow, and whether fewer are known to be impossible."""

    bins: list[tuple[tuple[int, ...], int]]
    size: int
    bound: int
    optimal: bool


def plan(histogram: dict[int, int], capacity: int, nodes: int | None = NODES, look: int | None = LOOK) -> Plan:
    """The packing of a histogram (length: pieces) that the search finds, never more bins than best fit. With ``nodes`` and ``look`` None the search goes on until the plan is optimal."""
    counts = [0] * (capacity + 1)
    for x, n in histogram.items():
        counts[x] = n
    total = sum(x * n for x, n in enumerate(counts))
    bound = max(-(-total // capacity), sum(counts[capacity // 2 + 1 :]))
    best = best_fit(counts, capacity)
    size = sum(n for _, n in best)
    budget, complete = Budget(nodes), look is None

    def choices(waste: int, top: int) -> Iterator[tuple[tuple[int, ...], int]]:
        """(bin, how often) for the largest length left, at most ``waste`` in all."""
        counts[top] -= 1
        some = fillings(counts, capacity - top, waste, budget, look)
        counts[top] += 1
        while True:
            counts[top] -= 1  # the search of the next filling has to see the bin's own piece taken
            f = next(some, None)
            counts[top] += 1
            if f is None:
                return
            own = (top, *f)
            lost = capacity - sum(own)
            often = min(counts[x] // own.count(x) for x in set(own))
            for k in range(min(often, waste // lost) if lost else often, 0, -1):
                budget.left -= 1
                yield own, k

    path: list[tuple[tuple[int, ...], int]] = []
    stack, used, lost = [], 0, 0
    top = max((x for x in range(capacity + 1) if counts[x]), default=0)
    if size > bound and top:
        stack.append(choices((size - 1) * capacity - total, top))
    while stack and budget.left > 0 and size > bound:
        if len(path) == len(stack):  # back from below: undo
            own, k = path.pop()
            used, lost = used - k, lost - k * (capacity - sum(own))
            for x in own:
                counts[x] += k
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            continue
        own, k = step
        if lost + k * (capacity - sum(own)) > (size - 1) * capacity - total:
            continue
        path.append(step)
        used, lost = used + k, lost + k * (capacity - sum(own))
        for x in own:
            counts[x] -= k
        top = own[0]
        while top and not counts[top]:
            top -= 1
        if top:
            stack.append(choices((size - 1) * capacity - total - lost, top))
        elif used < size:
            best, size = list(path), used
    return Plan(best, size, bound, size == bound or (complete and not stack and budget.left > 0))


def pack(parts: DataFrame, capacity: int, nodes: int | None = NODES, look: int | None = LOOK) -> DataFrame:
    """Adds (sequence_id, offset) to rows with (id, piece, start, length). Lengths are 1 to ``capacity``; no sequence holds more than that, and it has no gaps.

    ``nodes`` and ``look`` bound the search, see ``plan``.  Null ids and
    repeated rows are pieces like others; columns of the new names are
    replaced.  An empty table gives an empty result.
    """
    parts = stage(parts.drop("sequence_id", "offset"))
    bucket, rank_col = free_name(parts.columns, "__bucket"), free_name(parts.columns, "__rank")
    n = parts.count()
    buckets = max(partitions(parts.sparkSession), -(-n // BUCKET_ROWS))
    placed = parts.withColumn(bucket, F.pmod(F.xxhash64("id", "piece", "start"), F.lit(buckets)))
    per = stage(placed.groupBy(bucket, "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows

    table: dict[int, list[tuple[int, int, int]]] = {}
    used, sequence = dict.fromkeys(histogram, 0), 0
    for own, often in plan(histogram, capacity, nodes, look).bins:
        for x, at in zip(own, accumulate((0, *own)), strict=False):
            table.setdefault(x, []).append((used[x], sequence, at))
            used[x] += often
        sequence += often
    steps = {x: np.array(rows, np.int64).T for x, rows in table.items()}

    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counted = per.select(bucket, "length", before.alias("n_before")).hint("merge")  # grows with the buckets: never broadcast
    rank = F.row_number().over(W.partitionBy(bucket, "length").orderBy("id", "piece", "start", *[c for c in parts.columns if c not in ("id", "piece", "start", "length")]))
    names = parts.columns
    ranked = placed.withColumn(rank_col, rank).join(counted, [bucket, "length"]).withColumn(rank_col, F.col("n_before") + F.col(rank_col) - 1).select(*names, rank_col)

    @tidy
    def assign(batches):
        for batch in batches:
            length, ranks = column(batch, "length").to_numpy(), column(batch, rank_col).to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                first, s, at = steps[int(length[own[0]])]
                k = np.searchsorted(first, ranks[own], "right") - 1
                seq[own], off[own] = s[k] + ranks[own] - first[k], at[k]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(assign, schema)
