"""Token ids in shard files with a minimal perfect hash index.

A shard is one row of a Parquet folder: a raw payload of ids (unsigned 16 or
32-bit, little-endian) of documents in ascending key order, the keys, and an
index from key to place in the payload.  The index is a minimal perfect hash of
the shard's keys: levels of bit arrays, where a key is placed at the first
level on which it is alone, and its slot is the rank of its bit.  Each slot
stores a 32-bit fingerprint of its key, so that a key which the shard does not
hold is recognised, and the document's ordinal.  Rows are written by Spark's
own committer, to any store that Spark can write to.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.common import blocks, column, mix, range_bounds, range_key, ranges, tidy
from attesta.llm.token_cache import BLOCK_BYTES, ENCODE_BYTES, VOCABULARY, byte_encoder, encoder

#: Ids in a shard; a longer document is a shard of its own.
SHARD_IDS = 2_000_000
#: Bytes of text of a range of keys, which is a task's work.
RANGE_BYTES = 16_000_000
#: Bits of a level for each key that it is given.
GAMMA = 1.6
_SEEDS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MARK = np.uint64(0xD6E8FEB86659FD93)


class PerfectHash:
    """Slots 0..n-1 of n different 64-bit keys."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        while len(keys):
            m = max(64, -(-int(GAMMA * len(keys)) // 64) * 64)
            at = (mix(keys ^ _SEEDS[len(sizes)]) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(m)
            keys = keys[~alone[at]]
        return cls(np.array(sizes, np.uint32), np.concatenate(words) if words else np.zeros(0, "<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """-1 where no level has a bit for the key; a slot of another key is possible for keys that were not built in."""
        out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, m in enumerate(self.sizes.tolist()):
            at = (mix(keys[left] ^ _SEEDS[level]) % np.uint64(m)).astype(np.int64)
            word, bit = base + (at >> 6), (at & 63).astype(np.uint64)
            found = (self.words[word] >> bit) & np.uint64(1) == 1
            w, b = word[found], bit[found]
            out[left[found]] = self.ranks[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << b) - np.uint64(1)))
            left = left[~found]
            base += m // 64
            if not len(left):
                break
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys * _MARK + np.uint64(1)) >> np.uint64(32)).astype("<u4")


SHARD = T.StructType(
    [
        T.StructField("p", T.IntegerType()),
        T.StructField("first_key", T.LongType()),
        T.StructField("last_key", T.LongType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("start_in_p", T.LongType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("ends", T.BinaryType()),
        T.StructField("n_null", T.LongType()),
        T.StructField("keys", T.BinaryType()),
        T.StructField("mph_sizes", T.BinaryType()),
        T.StructField("mph_words", T.BinaryType()),
        T.StructField("marks", T.BinaryType()),
        T.StructField("ordinals", T.BinaryType()),
    ]
)


def _shard(p: int, start: int, width: int, keys: list, parts: list[bytes]) -> dict:
    nulls = sum(k is None for k in keys)
    have = np.array(keys[nulls:], np.int64)
    own, ordinal = np.unique(have, return_index=True)
    ph = PerfectHash.build(own.view(np.uint64))
    slots = ph.slots(own.view(np.uint64))
    marks, ordinals = np.zeros(len(own), "<u4"), np.zeros(len(own), "<u4")
    marks[slots], ordinals[slots] = fingerprints(own.view(np.uint64)), ordinal + nulls
    lengths = [len(x) // width for x in parts]
    return {
        "p": p, "first_key": int(have[0]) if len(have) else None, "last_key": int(have[-1]) if len(have) else None, "n_docs": len(keys), "n_ids": sum(lengths), "start_in_p": start, "width": width,
        "payload": b"".join(parts), "ends": np.array(list(accumulate(lengths)), "<u8").tobytes(), "n_null": nulls, "keys": have.astype("<i8").tobytes(),
        "mph_sizes": ph.sizes.astype("<u4").tobytes(), "mph_words": ph.words.tobytes(), "marks": marks.tobytes(), "ordinals": ordinals.tobytes(),
    }


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id`` and write shards in ascending key order under ``path``.

    Null texts are empty and hold the end id alone.  Rows that repeat a key all
    stay, in the order of their ids; the index leads to the first.  Rows with a
    null key come first and have no index entry.  Texts are encoded where they
    lie; only ids are shuffled, to ranges of keys of about equal bytes of text,
    RANGE_BYTES or so while there are no more than RANGES of them for a shuffle
    partition.  An empty table writes a folder without shards.  Other columns are left behind.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("key"), F.col(text_col).alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bounds = range_bounds(docs, "key", F.coalesce(F.octet_length("text"), F.lit(0)) + 64, ranges(docs.sparkSession, total, RANGE_BYTES))

    @tidy(keep=VOCABULARY)
    def encode(batches):
        if quick := byte_encoder(vocabulary):
            for batch in batches:
                for part, data, offsets in blocks(batch, "text", BLOCK_BYTES):
                    ids = quick.ids(data, offsets, end_id)
                    yield pa.RecordBatch.from_arrays([column(part, "key"), ids, pa.array([quick.dtype.itemsize] * len(ids), pa.int32())], names=["key", "ids", "width"])
            return
        enc = encoder(vocabulary)
        narrow = enc.tokenizer.get_vocab_size() <= 1 << 16
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part, _, _ in blocks(batch, "text", ENCODE_BYTES):
                ids = [i + end for i in enc.ids([t or "" for t in column(part, "text").to_pylist()])]
                if narrow:
                    ids = [np.frombuffer(i, "<u4").astype("<u2").tobytes() for i in ids]
                yield pa.RecordBatch.from_arrays([column(part, "key"), pa.array(ids, pa.binary()), pa.array([2 if narrow else 4] * len(ids), pa.int32())], names=["key", "ids", "width"])

    @tidy
    def pack(batches):
        schema = pa.schema([(f.name, {"integer": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[f.dataType.typeName() if f.dataType.typeName() != "bigint" else "long"]) for f in SHARD.fields])
        at, total, width, keys, parts, size = None, 0, 4, [], [], 0
        for batch in batches:
            for p, k, ids, w in zip(*(column(batch, c).to_pylist() for c in ("p", "key", "ids", "width")), strict=True):
                more = len(ids) // w
                if keys and (p != at or size + more > SHARD_IDS):
                    yield pa.RecordBatch.from_pylist([_shard(at, total, width, keys, parts)], schema)
                    total, keys, parts, size = total + size, [], [], 0
                if p != at:
                    at, total = p, 0
                keys.append(k)
                parts.append(ids)
                size, width = size + more, w
        if keys:
            yield pa.RecordBatch.from_pylist([_shard(at, total, width, keys, parts)], schema)

    encoded = docs.mapInArrow(encode, "key bigint, ids binary, width int")
    ranged = encoded.withColumn("p", range_key(F.col("key"), bounds)).repartitionById(len(bounds) + 1, F.col("p")).sortWithinPartitions("p", F.col("key").asc_nulls_first(), "ids")
    ranged.mapInArrow(pack, SHARD).write.option("compression", "zstd").parquet(path)


class Shard:
    """One row of the files, opened."""

    def __init__(self, row: dict):
        get = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids = get("payload", f"<u{row['width']}")
        self.ends, self.nulls = get("ends", "<u8").astype(np.int64), row["n_null"]
        self.keys, self.marks, self.ordinals = get("keys", "<i8"), get("marks", "<u4"), get("ordinals", "<u4").astype(np.int64)
        self.hash = PerfectHash(get("mph_sizes", "<u4"), get("mph_words", "<u8"))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ordinal of the first document of each key, -1 for keys that are not here."""
        keys = np.ascontiguousarray(keys, np.int64).view(np.uint64)
        slots = self.hash.slots(keys)
        ok = slots >= 0
        ok[ok] = self.marks[slots[ok]] == fingerprints(keys[ok])
        return np.where(ok, self.ordinals[np.where(ok, slots, 0)], -1) if len(self.marks) else np.full(len(keys), -1)

    def ids_of(self, ordinal: int) -> np.ndarray:
        return self.ids[self.ends[ordinal - 1] if ordinal else 0 : self.ends[ordinal]]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(key, start, n_tokens, ids): every document of the files, found through the index; ``start`` counts the ids of all before it. Rows of a null or repeated key are all given, in the order of the files. No shards give no rows."""
    shards = spark.read.schema(SHARD).parquet(path)
    totals = dict(shards.groupBy("p").agg(F.sum("n_ids")).collect())  # a row for each range at most
    order = sorted(totals)
    base = dict(zip(order, accumulate([0, *(totals[p] for p in order)]), strict=False))

    @tidy
    def open_all(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                s = Shard(row)
                at = s.find(s.keys)
                first = np.searchsorted(s.keys, s.keys)  # a repeated key: as many further on
                at = np.concatenate((np.arange(s.nulls), at + np.arange(len(at)) - first))
                start, end = np.concatenate(([0], s.ends[:-1]))[at], s.ends[at]
                keys = pa.array([None] * s.nulls + s.keys.tolist(), pa.int64())
                for j in range(0, len(at), 1000):
                    k = range(j, min(j + 1000, len(at)))
                    ids = [s.ids[start[x] : end[x]].astype("<u4").tobytes() for x in k]
                    yield pa.RecordBatch.from_arrays([keys.slice(j, len(k)), pa.array(start[j : j + 1000] + row["start_in_p"] + base[row["p"]]), pa.array((end - start)[j : j + 1000]), pa.array(ids, pa.binary())], names=["key", "start", "n_tokens", "ids"])

    return shards.mapInArrow(open_all, "key bigint, start bigint, n_tokens bigint, ids binary")


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """(key, ids) of some keys: shards are pruned by their key range, then each key costs one probe. Absent keys give no row; a repeated key gives its first document, and null is no key."""
    wanted = np.array(sorted(set(keys)), np.int64)
    if not len(wanted):
        return spark.createDataFrame([], "key bigint, ids binary")
    near = F.exists(F.lit(wanted.tolist()).cast("array<bigint>"), lambda k: (F.col("first_key") <= k) & (F.col("last_key") >= k))

    @tidy
    def probe(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = Shard(row)
                for k, o in zip(wanted.tolist(), s.find(wanted).tolist(), strict=True):
                    if o >= 0 and s.keys[o - s.nulls] == k:
                        yield pa.RecordBatch.from_pydict({"key": [k], "ids": [s.ids_of(o).astype("<u4").tobytes()]}, pa.schema([("key", pa.int64()), ("ids", pa.binary())]))

    return spark.read.schema(SHARD).parquet(path).filter(near & (F.col("first_key") <= int(wanted[-1])) & (F.col("last_key") >= int(wanted[0]))).mapInArrow(probe, "key bigint, ids binary")
