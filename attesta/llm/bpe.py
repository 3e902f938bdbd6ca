"""Byte-level BPE encoding and decoding over Arrow batches.

A rank file is turned into a model of the tokenizers library: bytes are
written as the printable characters of the byte table, and the merges follow
from the ranks.  Decoding reverses the byte table, so characters whose bytes
lie in several tokens come back whole.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.common import blocks, column, forgets, free_name, tidy
from attesta.llm.token_cache import BYTE_CHUNKS, ENCODE_BYTES, VOCABULARY, Encoder, byte_table, kept_encoder

_models: dict = {}
forgets(_models.clear, VOCABULARY)


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            token, rank = line.split()
            ranks[int(rank)] = base64.b64decode(token)
    return [ranks[i] for i in range(len(ranks))]


def library_model(path: str, pattern: str):
    """A Tokenizer that encodes as the rank file says: any two neighbours merge whose concatenation has the lowest rank."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    tokens = read_ranks(path)
    table = byte_table()
    written = ["".join(table[b] for b in t) for t in tokens]
    vocab = {w: i for i, w in enumerate(written)}
    merges = [(w[:k], w[k:]) for w in written for k in range(1, len(w)) if w[:k] in vocab and w[k:] in vocab]
    out = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


def _encoder(path: str, pattern: str) -> Encoder:
    return kept_encoder((path, pattern), lambda: Encoder(library_model(path, pattern), BYTE_CHUNKS))


def token_bytes(path: str) -> list[bytes]:
    """Bytes of each id, read back from the written form through the reversed byte table."""
    if ("bytes", path) not in _models:
        table = byte_table()
        back = {c: b for b, c in enumerate(table)}
        _models["bytes", path] = [bytes(back[c] for c in "".join(table[b] for b in t)) for t in read_ranks(path)]
    return _models["bytes", path]


def char_starts(ids: np.ndarray, data: bytes, lengths: np.ndarray) -> np.ndarray:
    """First code point of each token: that to which its first byte belongs."""
    lead = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    first = np.zeros(len(ids), np.int64)
    np.cumsum(lengths[ids][:-1], out=first[1:])
    return lead[first] - 1 if len(ids) else first


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", offsets: bool = False) -> DataFrame:
    """The ``keep`` columns, ``ids`` (binary, little-endian unsigned 32-bit), ``n_tokens`` and, on request, ``starts``.

    ``starts`` are code-point offsets of the tokens.  A null text is an empty
    one and has no ids.  Rows keep their partition and order; nothing shuffles,
    so null and repeated ids are rows like others and an empty table gives an
    empty result.  ``keep`` must not name one of the new columns: that is a
    ValueError.
    """
    if {c.lower() for c in keep} & {"ids", "n_tokens", "starts"}:
        raise ValueError("ids, n_tokens and starts are columns of the result")
    fields = [docs.schema[c] for c in keep]
    docs = docs.select(*keep, F.col(text_col).alias(free_name(list(keep), "__text")))
    text_col = docs.columns[-1]
    schema = T.StructType([*fields, T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())] + [T.StructField("starts", T.ArrayType(T.LongType()))] * offsets)

    @tidy(keep=VOCABULARY)
    def run(batches):
        enc = _encoder(path, pattern)
        lengths = np.array([len(t) for t in token_bytes(path)], np.int64) if offsets else None
        for batch in batches:
            for part, _, _ in blocks(batch, text_col, ENCODE_BYTES):
                texts = [t or "" for t in column(part, text_col).to_pylist()]
                ids = enc.ids(texts)
                cols = [column(part, c) for c in keep] + [pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())]
                if offsets:
                    cols.append(pa.array([char_starts(np.frombuffer(i, "<u4"), t.encode(), lengths) for i, t in zip(ids, texts, strict=True)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """All columns and ``decoded`` (binary, in place of a column of that name): the bytes of the ids. An id outside the vocabulary is an error; null ids decode to nothing.

    Cast ``decoded`` to string only where it is valid UTF-8: a cut between ids may fall inside a character.
    """
    encoded = encoded.drop("decoded")
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    @tidy(keep=VOCABULARY)
    def run(batches):
        table = token_bytes(path)
        for batch in batches:
            step = max(1, int(batch.num_rows * (4 << 20) / max(batch.nbytes, 1)))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                out = [b"".join(map(table.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in column(part, ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=schema.names)

    return encoded.mapInArrow(run, schema)


def decode_text(parts: list[bytes]) -> list[str]:
    """Texts of consecutive pieces of one stream: a character split between two pieces belongs to the later one."""
    import codecs

    reader = codecs.getincrementaldecoder("utf-8")("replace")
    return [reader.decode(p, final=k == len(parts) - 1) for k, p in enumerate(parts)]
