"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

The terms of a text are trigrams of character classes (lower-case, upper-case, digit,
each punctuation mark, ...), hashed to TERMS places, so they describe how a text is
written in whatever language. TF-IDF vectors are projected on their leading singular
directions. Labelled vectors are broadcast; each document's cosine with every one
of them is computed exactly in blocks, and the labels of the K nearest (all ties with
the last one included) vote with weight cosine ** POWER.

The classifier is fitted on the FIT_ROWS labelled documents with the smallest hash of
their id (fewer, if there are fewer); every whole text is scored. An id with several
labels counts with their mean, NULL labels are left out, an id with several texts
counts with the largest in order. Without labelled rows every score is 0.5. NULL and
empty texts have no terms, hence cosine 0 with all, and get the mean label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterweave.llm import words as W
from rasterweave.llm.columns import unused

#: Bound on the labelled rows that are fitted and broadcast.
FIT_ROWS = 4096
TERMS = 1024
DIMENSIONS = 48
K = 25
POWER = 8
THRESHOLD = 0.3
_BLOCK = 2048
#: Rows that are scaled to unit length at a time, as that takes several copies of them.
_SCALED = 256


def _class_table() -> np.ndarray:
    table = np.zeros(256, np.uint32)
    for b in range(256):
        c = chr(b)
        if b >= 128 or c.islower():
            table[b] = 1
        elif c.isupper():
            table[b] = 2
        elif c.isdigit():
            table[b] = 3
        elif c in " \t":
            table[b] = 4
        elif c in "\r\n":
            table[b] = 5
        else:
            table[b] = 6 + b
    return table


_CLASS = _class_table()


def _terms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Term counts of each text, one row of TERMS places each."""
    rows = len(offsets) - 1
    out = np.zeros(rows * TERMS)
    if len(data) > 2:
        c = _CLASS[data]
        code = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
        place = (code * np.uint32(0x9E3779B1)) >> np.uint32(22)
        row = np.repeat(np.arange(rows), np.diff(offsets))[: len(place)]
        inside = np.arange(len(place)) + 2 < np.repeat(offsets[1:], np.diff(offsets))[: len(place)]
        out = np.bincount((row * TERMS + place)[inside], minlength=rows * TERMS)
    return out.reshape(rows, TERMS)


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF rows (zero rows stay zero)."""
    v = np.log1p(counts) * idf
    for at in range(0, len(v), _SCALED):
        v[at : at + _SCALED] /= np.maximum(np.linalg.norm(v[at : at + _SCALED], axis=1, keepdims=True), 1e-12)
    return v


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _counted(text: pa.Array) -> pa.Array:
    parts = [_terms(d, o) for _, _, d, o in W.chunks(text)]
    n = sum(map(len, parts))
    flat = np.concatenate(parts).astype(np.float32).ravel() if parts else np.zeros(0, np.float32)
    return W.list_array(np.full(n, TERMS), pa.array(flat))


def labelled(docs: DataFrame, labels: DataFrame, usable: Column, id_column: str = "doc_id", label: str = "quality") -> DataFrame:
    """(id, target) of the FIT_ROWS usable labelled documents with the smallest id hash."""
    known = (
        labels.filter(F.col(label).isNotNull() & F.col(id_column).isNotNull())
        .groupBy(id_column).agg(F.avg(label).alias("target"))
    )
    return (
        docs.filter(usable).select(id_column).distinct().join(known, id_column)
        .orderBy(F.xxhash64(id_column), id_column).limit(FIT_ROWS)
    )


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_column: str = "doc_id", text: str = "text", label: str = "quality") -> dict:
    """The model: term weights, projection, labelled vectors and labels."""
    chosen = labelled(docs, labels, usable, id_column, label)
    rows = (
        docs.select(id_column, text).join(F.broadcast(chosen), id_column)
        .select(id_column, "target", _counted(F.col(text)).alias("counts"))
        .groupBy(id_column).agg(F.first("target").alias("target"), F.max("counts").alias("counts"))
        .toArrow()
    )
    if not rows.num_rows:
        return {"labels": np.zeros(0)}
    order = np.argsort(rows[id_column].to_numpy(), kind="stable")
    counts = rows["counts"].combine_chunks().flatten().to_numpy().reshape(-1, TERMS)[order]
    target = rows["target"].to_numpy()[order]
    del rows
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 0.1
    v = _weigh(counts, idf)
    del counts
    _, directions = np.linalg.eigh(v.T @ v)
    projection = directions[:, ::-1][:, :DIMENSIONS]
    latent = v @ projection
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    return {
        "idf": idf, "projection": projection.astype(np.float32),
        "vectors": latent.astype(np.float32), "labels": target,
    }


def vote(vectors: np.ndarray, model: dict) -> np.ndarray:
    """Similarity-weighted mean label of the nearest labelled vectors."""
    known, labels = model["vectors"], model["labels"]
    k = min(K, len(labels))
    out = np.empty(len(vectors))
    for at in range(0, len(vectors), _BLOCK):
        cos = np.round(vectors[at : at + _BLOCK] @ known.T, 5)
        kth = np.partition(cos, len(labels) - k, axis=1)[:, len(labels) - k : len(labels) - k + 1]
        weight = np.where(cos >= kth, np.maximum(cos, 0), 0).astype(np.float64) ** POWER
        total = weight.sum(1)
        out[at : at + _BLOCK] = np.where(total > 0, weight @ labels / np.maximum(total, 1e-300), labels.mean())
    return np.clip(out, 0, 1)


def score(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``: 0 to 1, the higher the likelier is label 1. A column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        m = shared.value
        parts = []
        for _, _, data, offsets in W.chunks(text):
            if not len(m["labels"]):
                parts.append(np.full(len(offsets) - 1, 0.5))
                continue
            v = (_weigh(_terms(data, offsets), m["idf"]) @ m["projection"]).astype(np.float32)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            parts.append(vote(v, m))
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(out, scored.asNondeterministic()(F.col(text)))


def fold(parts: int, id_column: str = "doc_id") -> Column:
    """CRC-32 of the id as text, modulo ``parts``; NULL for a NULL id."""
    return F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(parts))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    model = fit(docs, labels, fold(5) != 0)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score reaches THRESHOLD, with their columns."""
    model = fit(docs, labels, fold(5) != 0)
    name = unused(docs, "_score")
    return score(docs, model, out=name).filter(F.col(name) >= THRESHOLD).drop(name)
