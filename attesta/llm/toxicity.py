"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence has a logistic score over hashed
features of its words; a document is toxic if any of its sentences is, so the
sentence scores combine by noisy-or: p = 1 - prod(1 - p_s).  Only documents
carry labels; the gradient of the noisy-or hands them to the sentences that
explain them, and the fitted sentence scores locate the offending ones.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import LOWER, Spans, blocks, column, tidy, word_spans

#: Features are hashed to 2^BITS weights.
BITS = 18
#: The fit reads at most so many labelled documents of each class, those first in the order of a hash of their ids (all, where there are fewer).
MAX_PER_CLASS = 2500
#: Training documents in which a feature has to occur.
MIN_DOCS = 2
#: ``.``, ``!``, ``?`` and line feeds end a sentence; letters, digits and bytes from 128 on make words; a word is also seen by its first bytes.
_END = np.zeros(256, bool)
_END[[10, 33, 46, 63]] = True
_OUTSIDE = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])
_PREFIXES = (4, 5)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the sentences of a block: feature ids (word by word), n+1 offsets into them, document of each sentence, and spans (start, end) in bytes.

    A document without words has one sentence without features.
    """
    starts, ends, _ = word_spans(data, offsets, _OUTSIDE)
    spans = Spans(data, LOWER)
    cols = [spans.hash(starts, ends)]
    for i, k in enumerate(_PREFIXES):
        cols.append(spans.hash(starts, np.minimum(starts + k, ends)) * np.uint64(0x9E3779B97F4A7C15 + 2 * (i + 1) & (1 << 64) - 1))
    ids = np.stack([(c >> np.uint64(64 - BITS)).astype(np.int32) for c in cols], axis=1)
    doc = np.searchsorted(offsets, starts, "right") - 1
    stops = np.concatenate(([0], np.cumsum(_END[data], dtype=np.int64)))
    key = stops[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    sdoc, sspan = doc[first], np.stack((starts[first], ends[last]), axis=1) if len(first) else np.zeros((0, 2), np.int64)
    cuts = np.append(first, len(starts)) * ids.shape[1]
    none = np.setdiff1d(np.arange(len(offsets) - 1), sdoc)
    if len(none):
        order = np.argsort(np.concatenate((sdoc, none)), kind="stable")
        sizes = np.concatenate((np.diff(cuts), np.zeros(len(none), np.int64)))[order]
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        sspan = np.concatenate((sspan, np.stack((offsets[none], offsets[none]), axis=1)))[order]
        sdoc = np.concatenate((sdoc, none))[order]
    return ids.ravel(), cuts, sdoc, sspan


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[cuts[1:]] - total[cuts[:-1]]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, ids: np.ndarray, cuts: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores of documents and of sentences."""
        z = self.bias + _sums(self.weights[ids], cuts)
        return -np.expm1(-np.bincount(doc, _softplus(z), n)), 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def train(bags: list[tuple[int, np.ndarray, np.ndarray]], rounds: int = 150, rate: float = 0.15, ridge: float = 1e-4) -> Model:
    """Fit on (label, feature ids, sentence offsets). Without both classes the model is the share of label 1 at no features."""
    labels = np.array([y for y, _, _ in bags], float)
    weights = np.zeros(1 << BITS)
    if not len(bags) or labels.min() == labels.max():
        return Model(weights, 8.0 if len(bags) and labels[0] else -8.0)
    often, hits = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for y, f, _ in bags:
        own = np.unique(f)
        often[own] += 1
        hits[own] += y
    share = labels.mean()
    # features that say something: their share of label 1 is off by more than chance
    keep = (often >= MIN_DOCS) & (np.abs(hits - often * share) > 2.5 * np.sqrt(often * share * (1 - share)))
    local, k = np.cumsum(keep) - 1, int(keep.sum())
    doc = np.repeat(np.arange(len(bags)), [len(c) - 1 for _, _, c in bags])
    sents, feats, at = [], [], 0
    for _, f, c in bags:  # the others are left out document by document
        used = np.flatnonzero(keep[f])
        sents.append((at + np.searchsorted(c, used, "right") - 1).astype(np.int32))
        feats.append(local[f[used]].astype(np.int32))
        at += len(c) - 1
    sent, feat = np.concatenate(sents), np.concatenate(feats)
    w, bias = np.zeros(k), -6.0
    m, v, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    balance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / len(bags)
    for t in range(1, rounds + 1):
        z = bias + np.bincount(sent, w[feat], len(doc))
        sigma = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        keepers = np.exp(-np.bincount(doc, _softplus(z), len(bags)))  # 1 - p
        pull = np.where(labels == 1, -keepers / np.maximum(1 - keepers, 1e-9), 1.0) * balance
        g = pull[doc] * sigma
        grad, gb = np.bincount(feat, g[sent], k) + ridge * w, g.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    weights[np.flatnonzero(keep)] = w
    return Model(weights, float(bias))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label") -> Model:
    """Fit on a bounded sample of labelled documents (see MAX_PER_CLASS).

    Labels other than 0 and 1, null ids and labels without a document are left
    out; an id with several rows counts once, with its largest label.
    """
    y = F.col(label_col).cast("int")
    ids = labels.filter(y.isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(y).alias("__y")).withColumn("__h", F.xxhash64(F.col(id_col)))
    chosen = [ids.filter(F.col("__y") == c).orderBy("__h", id_col).limit(MAX_PER_CLASS).select(id_col, "__y") for c in (0, 1)]
    bags = docs.select(id_col, text_col).join(F.broadcast(chosen[0].unionByName(chosen[1])), id_col)

    @tidy
    def run(batches):
        for batch in batches:
            for part, data, offsets in blocks(batch, text_col):
                f, cuts, doc, _ = features(data, offsets)
                at = np.searchsorted(doc, np.arange(part.num_rows + 1))
                own = [zlib.compress(f[cuts[at[i]] : cuts[at[i + 1]]].tobytes(), 1) for i in range(part.num_rows)]
                rel = [zlib.compress((cuts[at[i] : at[i + 1] + 1] - cuts[at[i]]).tobytes(), 1) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([column(part, "id"), column(part, "__y"), pa.array(own, pa.binary()), pa.array(rel, pa.binary())], names=["id", "y", "f", "c"])

    rows = bags.select(F.col(id_col).cast("bigint").alias("id"), "__y", text_col).mapInArrow(run, "id bigint, y int, f binary, c binary").collect()  # 2 * MAX_PER_CLASS at most
    return train([(r.y, np.frombuffer(zlib.decompress(r.f), np.int32), np.frombuffer(zlib.decompress(r.c), np.int64)) for r in sorted({r.id: r for r in rows}.values())])


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The ``keep`` columns, ``score`` (0 to 1), ``n_sentences`` and ``offending``.

    ``offending`` lists (start, end, score) of sentences of 0.5 or more, in
    bytes of the UTF-8 text.  Null and empty texts have one empty sentence and
    the score of the bias.  Rows are neither moved nor dropped: null and
    repeated ids are rows like others, and an empty table gives an empty result.
    ``keep`` must not name one of the new columns: that is a ValueError.
    """
    if {c.lower() for c in keep} & {"score", "n_sentences", "offending"}:
        raise ValueError("score, n_sentences and offending are columns of the result")
    weights, bias = model.weights.astype(np.float32), model.bias
    kept = [docs.schema[c] for c in keep]
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    names = [*keep, "score", "n_sentences", "offending"]

    @tidy
    def run(batches):
        m = Model(weights, bias)
        for batch in batches:
            for part, data, offsets in blocks(batch, text_col):
                n = part.num_rows
                f, cuts, doc, where = features(data, offsets)
                p, s = m.score(f, cuts, doc, n)
                bad = np.flatnonzero(s >= 0.5)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[bad], np.arange(n + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(where[bad, 0] - offsets[doc[bad]]), pa.array(where[bad, 1] - offsets[doc[bad]]), pa.array(s[bad])], fields=list(span)))
                yield pa.RecordBatch.from_arrays([*(column(part, c) for c in keep), pa.array(np.clip(p, 0, 1)), pa.array(np.bincount(doc, minlength=n)), lists], names=names)

    from pyspark.sql import types as T

    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("n_sentences", T.LongType()), T.StructField("offending", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])))])
    return docs.select(*dict.fromkeys((*keep, text_col))).mapInArrow(run, schema)
