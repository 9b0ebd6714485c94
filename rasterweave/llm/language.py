"""Language of documents by a mixture over the languages, fitted by EM to each text.

Words are runs of letters (a-z after lower-casing A-Z, and everything beyond ASCII).
Each language has smoothed probabilities of byte trigrams of words with their borders,
hashed to BUCKETS places. A document's words are drawn from a mixture of languages;
expectation-maximisation estimates the proportions. The set of languages starts with
the single best one and grows by the next in proportion while the log-likelihood
gains more than PENALTY * log(words) per language. The prediction is the language with
the largest proportion (ties: first by name), its score that proportion.

Trigrams are counted over about SAMPLE documents of each language, chosen by a hash of
the id; every whole text is labelled. NULL texts and texts without a letter are
``und`` with score 0, and so is everything if there is nothing to learn from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterweave.llm import words as W

#: Documents per language that are counted, in expectation.
SAMPLE = 3000
_DRAW_BITS = 62
BUCKETS = 1 << 16
PENALTY = 1.0
SMOOTH = 0.5
ROUNDS = 6
UNKNOWN = "und"
#: A language is estimated from the documents; more names than this is a wrong column.
MAX_LANGUAGES = 1000

_LETTER = W.classes("".join(map(chr, [*range(0x61), *range(0x7B, 0x80)])))


def _trigrams(data: np.ndarray, found: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each byte of a word, first of these for each word)."""
    size = found.end - found.start
    first = np.cumsum(size) - size
    if not len(size):
        return np.zeros(0, np.int64), first
    at = np.arange(size.sum()) + np.repeat(found.start - first, size)
    here = data[at].astype(np.uint32)
    before = np.empty_like(here)
    before[1:] = here[:-1]
    before[first] = 32
    after = np.empty_like(here)
    after[:-1] = here[1:]
    after[first + size - 1] = 32
    code = (before << np.uint32(16)) | (here << np.uint32(8)) | after
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64), first


@F.arrow_udf(T.ArrayType(T.StructType().add("bucket", T.IntegerType()).add("n", T.IntegerType())))
def _counted(text: pa.Array) -> pa.Array:
    """Trigram counts of each text."""
    sizes, buckets, numbers = [], [], []
    for _, _, data, offsets in W.chunks(text):
        low = W.LOWER[data]
        found = W.Words(low, offsets, _LETTER)
        bucket, first = _trigrams(low, found)
        bounds = np.append(first, len(bucket))[found.first]
        for a, b in zip(bounds[:-1], bounds[1:]):
            u, n = np.unique(bucket[a:b], return_counts=True)
            sizes.append(len(u))
            buckets.append(u)
            numbers.append(n)
    join = lambda xs: pa.array(np.concatenate(xs) if xs else np.zeros(0), pa.int32())
    pairs = pa.StructArray.from_arrays([join(buckets), join(numbers)], ["bucket", "n"])
    return W.list_array(np.array(sizes, np.int64), pairs)


def draw_below(count: int) -> int:
    """Hashes of _DRAW_BITS bits below it are drawn: about SAMPLE of ``count`` documents, of any number."""
    return max(1, int((1 << _DRAW_BITS) * min(1.0, SAMPLE / count)))


def fit(docs: DataFrame, usable: Column, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> dict:
    """Log-probabilities of trigram buckets for each language, by name."""
    known = docs.filter(usable & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.shiftrightunsigned(F.xxhash64(id_column), 64 - _DRAW_BITS).alias("h")
    )
    sizes = known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in column {lang!r}")
    if not sizes:
        return {"names": []}
    part = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], draw_below(r["count"]))])
    counted = (
        known.filter(F.col("h") < part[F.col("lang")])
        .select("lang", F.inline(_counted("text")))
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        .toArrow()
    )
    names = sorted(r["lang"] for r in sizes)
    number = {x: i for i, x in enumerate(names)}
    counts = np.full((len(names), BUCKETS), SMOOTH)
    if counted.num_rows:
        row = np.array([number[x] for x in counted["lang"].to_pylist()])
        np.add.at(counts, (row, counted["bucket"].to_numpy()), counted["n"].to_numpy())
    return {"names": names, "log_p": np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)}


def mixture(like: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language number, proportion) of each text.

    ``like`` is the log-likelihood of each word in each language, ``first`` the bounds of
    the texts among the words; texts without words get (-1, 0).
    """
    n_words, n_langs = np.diff(first), like.shape[1]
    best, share = np.full(len(n_words), -1), np.zeros(len(n_words))
    docs = np.flatnonzero(n_words)
    if not len(docs):
        return best, share
    at, size = first[docs], n_words[docs]
    owner = np.repeat(np.arange(len(docs)), size)
    top = like.max(1)
    e = np.exp(like - top[:, None])

    def total(x):
        return np.add.reduceat(x, at)

    def climb(p, e, at, size, owner):
        for _ in range(ROUNDS):
            mass = (p[owner] * e).sum(1)
            for j in range(n_langs):
                p[:, j] *= np.add.reduceat(e[:, j] / mass, at) / size
        return p, np.add.reduceat(np.log(np.maximum((p[owner] * e).sum(1), 1e-30)), at)

    single = np.stack([total(like[:, j] - top) for j in range(n_langs)], 1)
    chosen = single.argmax(1)
    gain = single[np.arange(len(docs)), chosen]
    proportion = np.ones(len(docs))
    winner = chosen.copy()
    if n_langs > 1:
        full, _ = climb(np.full((len(docs), n_langs), 1 / n_langs, np.float32), e, at, size, owner)
        full[np.arange(len(docs)), chosen] += 2
        order = np.argsort(-full, axis=1, kind="stable")
        full[np.arange(len(docs)), chosen] -= 2
        active = np.arange(len(docs))
        for k in range(2, n_langs + 1):
            rows = np.isin(owner, active) if len(active) < len(docs) else slice(None)
            own = np.searchsorted(active, owner[rows])
            starts = np.cumsum(size[active]) - size[active]
            allowed = np.zeros((len(active), n_langs), np.float32)
            np.put_along_axis(allowed, order[active, :k], 1, axis=1)
            p = np.maximum(full[active], 1e-3) * allowed
            p, level = climb(p / p.sum(1, keepdims=True), e[rows], starts, size[active], own)
            better = level - gain[active] > PENALTY * np.log(size[active] + 1)
            active, p = active[better], p[better]
            if not len(active):
                break
            gain[active] = level[better]
            winner[active] = p.argmax(1)
            proportion[active] = p.max(1)
    best[docs], share[docs] = winner, np.minimum(proportion, 1)
    return best, share


def identify(docs: DataFrame, model: dict, text: str = "text", out: str = "language") -> DataFrame:
    """Add struct ``out`` (name, score). A column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<name:string,score:double>")
    def identified(text: pa.Array) -> pa.Array:
        m = shared.value
        names, scores = [], []
        for row, to, data, offsets in W.chunks(text, W.CHUNK_BYTES // 2):
            low = W.LOWER[data]
            found = W.Words(low, offsets, _LETTER)
            n = to - row
            if not m["names"]:
                names += [UNKNOWN] * n
                scores += [0.0] * n
                continue
            bucket, first = _trigrams(low, found)
            like = np.empty((len(found), len(m["names"])), np.float32)
            for j, log_p in enumerate(m["log_p"]):
                like[:, j] = np.add.reduceat(log_p[bucket], first) if len(first) else 0
            best, share = mixture(like, found.first)
            letters = (low >= 97) & (low <= 122)
            plain = np.concatenate(([0], np.cumsum(letters)))[offsets]
            for r in np.flatnonzero((plain[1:] == plain[:-1]) & (best >= 0)):
                if not any(map(str.isalpha, low[offsets[r] : offsets[r + 1]].tobytes().decode())):
                    best[r] = -1
            names += [m["names"][b] if b >= 0 else UNKNOWN for b in best.tolist()]
            scores += np.where(best >= 0, share, 0.0).tolist()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["name", "score"])

    return docs.withColumn(out, identified.asNondeterministic()(F.col(text)))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document."""
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    model = fit(docs, F.coalesce(part != 2, F.lit(False)))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"),
        F.col("language.name").alias("lang_pred"), F.col("language.score").alias("score"),
    )
