"""Shared pieces: staged tables, range keys and vectorised text hashing.

Nothing here is an operator.  Tables are staged in the folder that the session
names in ``spark.checkpoint.dir``, so that work already done survives the loss
of an executor and is not computed twice.
"""

from __future__ import annotations

import ctypes
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.session import shared_folder

#: Bytes of text that one numpy step works on; a longer document is a step of its own.
BLOCK_BYTES = 1 << 20
#: Code points that separate words and lines, as in ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"
#: Most rows of (id)-sized tables that are broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 500_000
#: Most ranges of keys for each shuffle partition.
RANGES = 8
#: Most bytes of tables with lists that are broadcast.
BROADCAST_BYTES = 24_000_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the shared folder of the session."""
    return f"{shared_folder(spark)}/attesta-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranges(spark: SparkSession, total: int, each: int) -> int:
    """How many ranges ``total`` bytes are cut into: of ``each`` bytes or so, but RANGES for a shuffle partition at most, so that neither plan nor driver grow with the data; larger ranges are sorted by Spark and read as a stream."""
    n = partitions(spark)
    return max(n, min(-(-total // each), RANGES * n))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The (narrow, staged) table with a broadcast hint if it has at most ``limit`` rows; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def small_lists(df: DataFrame, n_bytes: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The (staged) table with a broadcast hint if its lists, of ``n_bytes`` a row, and its rows are small together."""
    total, n = df.agg(F.coalesce(F.sum(n_bytes), F.lit(0)), F.count(F.lit(1))).first()
    return F.broadcast(df) if total + 64 * n <= limit else df


def free_name(taken: list[str], name: str) -> str:
    """``name``, with as many underscores after it as it takes to differ from every taken one."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def one_text_a_key(docs: DataFrame, id_col: str, text_col: str, key: str) -> DataFrame:
    """``docs`` with a bigint column ``key`` in the order of the ids, one text to a key.

    Where no id is null or repeated, the id is the key.  Otherwise documents are
    numbered by id (null last) and a hash of the text: rows that repeat both
    share a key, different texts of an id and texts without one do not.
    """
    ids = docs.select(F.col(id_col).cast("bigint").alias("id"))
    if not ids.groupBy("id").count().filter("id is null or count > 1").limit(1).count():
        return docs.withColumn(key, F.col(id_col).cast("bigint"))
    h = F.xxhash64(F.col(text_col))
    order = [F.col("id").asc_nulls_last(), F.col("h").asc()]
    numbers = docs.select(F.col(id_col).cast("bigint").alias("id"), h.alias("h")).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    numbers = stage(numbers.withColumn(key, F.monotonically_increasing_id()))
    a, b = free_name(docs.columns, "__id"), free_name(docs.columns, "__hash")
    numbers = numbers.select(F.col("id").alias(a), F.col("h").alias(b), key)
    same = docs[id_col].cast("bigint").eqNullSafe(numbers[a]) & (F.xxhash64(docs[text_col]) == numbers[b])
    return docs.join(numbers, same).drop(a, b)


def range_bounds(docs: DataFrame, col: str, weight: Column, n: int) -> list[int]:
    """At most n-1 cut points of a bigint column, for ranges of about equal weight.

    Four times as many quantiles are weighed and joined, so a range is heavier
    than its share by one of them at most; a number for each goes through the
    driver.
    """
    fine = 4 * n
    ids = docs.select(F.col(col).cast("double").alias(col))
    cuts = sorted({int(c) for c in ids.approxQuantile(col, [i / fine for i in range(1, fine)], min(0.25 / fine, 0.01))}) if n > 1 else []
    if not cuts:
        return []
    weights = dict(docs.groupBy(range_key(F.col(col).cast("bigint"), cuts).alias("p")).agg(F.sum(weight)).collect())
    share, total, out = sum(w or 0 for w in weights.values()) / n, 0, []
    for p in range(len(cuts)):
        total += weights.get(p) or 0
        if total >= share:
            out.append(cuts[p])
            total = 0
    return out


def range_key(col: Column, bounds: list[int]) -> Column:
    """Number of cut points that are at most the value: 0 for the lowest range and for null. Found in two steps, of the square root of their number each."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    lists = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    upto = lambda values: F.size(F.filter(values, lambda b: b <= col))
    coarse = upto(F.lit([x[0] for x in lists]).cast("array<bigint>"))
    within = upto(F.element_at(F.array(*[F.lit(x).cast("array<bigint>") for x in lists]), coarse))
    return F.coalesce(F.when(col.isNull() | (coarse == 0), 0).otherwise((coarse - 1) * step + within), F.lit(0)).cast("int")


# --- memory of Python workers ------------------------------------------------------------

_caches: list[tuple[str, object]] = []


def forgets(clear, kind: str = ""):
    """Registers a function that empties a cache of the worker, of a kind that operators may ask ``tidy`` to keep."""
    _caches.append((kind, clear))
    return clear


def give_back(keep: str = "") -> None:
    """Empties the worker's caches, but for those of a kind, and gives free memory back to the system."""
    for kind, clear in _caches:
        if not kind or kind != keep:
            clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run=None, *, keep: str = ""):
    """``run``, whose worker gives memory back when a task ends: workers are used again, by other operators too. What is dear to load is kept for the next task by naming its kind; a task that does not name it drops it."""
    if run is None:
        return lambda f: tidy(f, keep=keep)

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back(keep)

    return wrapped


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# --- numpy over the bytes of a batch ---------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte; ``LOWER`` gives A-Z those of a-z.
RAW = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = RAW.copy()
LOWER[65:91] = RAW[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
forgets(_powers.clear)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i < n, B being one of two odd numbers."""
    if base not in _powers or len(_powers[base][0]) < n:
        both = []
        for b in (_BASES[base], pow(_BASES[base], -1, 1 << 64)):
            p = np.full(max(n, BLOCK_BYTES + 4096), b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers[base] = both[0], both[1]
    up, down = _powers[base]
    return up[:n], down[:n]


class Spans:
    """Hashes of any spans of one byte buffer, from one running sum."""

    def __init__(self, data: np.ndarray, table: np.ndarray = RAW, base: int = 0):
        n = len(data)
        up, self.down = powers(n + 1, base)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * up[:n], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


#: A prime of which remainders fit in 61 bits: unlike modulo 2^64, no order of two words cancels out.
PRIME = (1 << 61) - 1
_P, _LOW31, _LOW30 = np.uint64(PRIME), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
#: Bases below the prime, one for each independent hash.
_PRIME_BASES = (0x1F3A9C5D7B21E64F, 0x0C8E51D3A7F6942B)
_PLACE = np.uint64(0x9FB21C651E98DF25)
_prime_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
forgets(_prime_powers.clear)


def _fold(x: np.ndarray) -> np.ndarray:
    """Remainders by the prime of any 64-bit numbers."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of remainders, again below the prime: by halves of 31 and 30 bits, 2^61 counting as 1."""
    a1, a0, b1, b0 = a >> np.uint64(31), a & _LOW31, b >> np.uint64(31), b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _fold(_fold(a1 * b1 * np.uint64(2) + (middle >> np.uint64(30)) + ((middle & _LOW30) << np.uint64(31))) + a0 * b0)


def prime_powers(n: int, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo the prime for i < n."""
    if base not in _prime_powers or len(_prime_powers[base][0]) < n:
        both, n_all = [], max(n, BLOCK_BYTES + 4096)
        for b in (_PRIME_BASES[base], pow(_PRIME_BASES[base], -1, PRIME)):
            out = np.ones(n_all, np.uint64)
            have = 1
            while have < n_all:
                more = min(have, n_all - have)
                out[have : have + more] = times(out[:more], np.full(more, pow(b, have, PRIME), np.uint64))
                have += more
            both.append(out)
        _prime_powers[base] = both[0], both[1]
    up, down = _prime_powers[base]
    return up[:n], down[:n]


class Runs:
    """Hashes of any runs of a sequence of numbers below the prime, and of runs with some left out, from one running sum."""

    def __init__(self, values: np.ndarray, base: int = 0):
        up, self.down = prime_powers(len(values) + 2, base)
        terms = times(values, up[: len(values)])
        high, low = np.cumsum(terms >> np.uint64(31), dtype=np.uint64), np.cumsum(terms & _LOW31, dtype=np.uint64)
        high = _fold(high)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        self.sums[1:] = _fold(_fold(low) + ((high & _LOW30) << np.uint64(31)) + (high >> np.uint64(30)))

    def _between(self, a: np.ndarray, b: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Sum of the terms from a to b, moved down by ``shift`` places."""
        return times(_fold(self.sums[b] + (_P - self.sums[a])), self.down[shift])

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(self._between(a, b, a) + mix((b - a).astype(np.uint64)))

    def without(self, a: np.ndarray, cut: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equals ``hash`` of the numbers a..b without those at the columns of ``cut``, which ascend."""
        total, start = np.zeros(len(a), np.uint64), a
        for r in range(cut.shape[1]):
            total = _fold(total + self._between(start, cut[:, r], a + r))
            start = cut[:, r] + 1
        total = _fold(total + self._between(start, b, a + cut.shape[1]))
        return mix(total + mix((b - a - cut.shape[1]).astype(np.uint64)))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number below the prime for each word (of one byte or more) of a byte buffer, A-Z counting as a-z.

    A word is the sum of a random number for each byte and its place in the word, so that words of the same bytes in another order share nothing.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = ends - starts
    first = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(first, n)
    values = mix(LOWER[data[place + np.repeat(starts, n)]] + place.astype(np.uint64) * _PLACE)
    return _fold(mix(np.add.reduceat(values, first) + n.astype(np.uint64)))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a batch of texts and the n+1 offsets of its rows; null is empty."""
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    column = column.fill_null("" if wide == pa.large_string() else b"") if column.null_count else column
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, text: str, limit: int = BLOCK_BYTES):
    """Parts of a batch as (rows, bytes, offsets) of at most ``limit`` bytes, or one long document."""
    data, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (bytes not in ``outside``) of each row, and n+1 offsets of the rows into the words. A word does not cross rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~outside[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], after[-1] = False, False
    before[1:], after[:-1] = word[:-1], word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def long_lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))
