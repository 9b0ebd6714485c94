"""Benchmark decontamination by a broadcast set of normalised test n-grams.

Words are maximal runs of a-z, 0-9 and characters beyond ASCII after lower-casing
A-Z. A window is ``n`` consecutive words of an item; an item with fewer words, but
not none, is one window. Documents are scanned without a shuffle: window hashes are
looked up in the broadcast set and each hit is verified on the words themselves.

The set is broadcast in blocks of at most BLOCK_BYTES of window text (plus one
window); a larger benchmark takes further passes, each from a stored table.

NULL or empty texts have no words and no hits. Items with a NULL id are searched and
their words count as hit, but they are not listed. Repeated items count once. With
an empty benchmark nothing is hit. Other columns of the documents, whatever their
names, are kept as they are.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.llm import words as W
from rasterweave.llm.columns import unused
from rasterweave.sources.settle import settle

#: Words in a window.
N = 10
#: Window text in one broadcast.
BLOCK_BYTES = 32 << 20
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FILTER_BITS = 22

FOUND = (
    "struct<n_words:bigint,n_hit:bigint,spans:array<struct<start:int,end:int>>,"
    "items:array<string>,clean:string>"
)


def item_windows(benchmark: DataFrame, n: int = N, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (words, item) of all items; item as string."""
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = benchmark.select(
        F.col(item_id).cast("string").alias("item"), F.regexp_extract_all(lower, F.lit(_WORD), 0).alias("w")
    ).filter(F.size("w") > 0)
    every = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))),
        lambda i: F.concat_ws(" ", F.slice("w", i, n)),
    )
    return found.select("item", F.explode(every).alias("words")).distinct()


def _index(rows: list) -> dict:
    """Hashes of windows by their number of words, and what each stands for."""
    items = defaultdict(set)
    for r in rows:
        items[r["words"].encode()].add(r["item"])
    by_size = defaultdict(list)
    for text in items:
        by_size[text.count(b" ") + 1].append(text)
    out = {}
    for size, texts in by_size.items():
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.cumsum([0, *map(len, texts)])
        found = W.Words(data, offsets, W.ALNUM)
        _, h = found.windows(found.hashes(), size)
        known = defaultdict(list)
        for k, t in zip(h.tolist(), texts):
            known[k].append((t, sorted(x for x in items[t] if x is not None)))
        maybe = np.zeros(1 << _FILTER_BITS, bool)
        maybe[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        out[size] = (maybe, dict(known))
    return out


def _scan(text: pa.Array, index: dict, known: pa.Array | None) -> Iterator[pa.Array]:
    """Found structs for the chunks of one array, adding to spans and items known."""
    for row, to, data, offsets in W.chunks(text):
        low = W.LOWER[data]
        found = W.Words(low, offsets, W.ALNUM)
        hashes = found.hashes()
        starts, sizes = [], []
        items = defaultdict(set)
        owner = found.rows()
        for size, (maybe, windows) in index.items():
            at, h = found.windows(hashes, size)
            some = np.flatnonzero(maybe[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            for p, k in zip(at[some].tolist(), h[some].tolist()):
                if k not in windows:
                    continue
                words = found.bytes(p, p + size)
                for t, of in windows[k]:
                    if t == words:
                        starts.append(p)
                        sizes.append(size)
                        items[int(owner[p])].update(of)
        if known is not None:
            for r, x in enumerate(known.slice(row, to - row).to_pylist()):
                for s in x["spans"]:
                    starts.append(int(found.first[r]) + s["start"])
                    sizes.append(s["end"] - s["start"])
                items[r].update(x["items"])
        hit = W.covered(len(found), np.array(starts, np.int64), np.array(sizes, np.int64))
        a, b = W.ranges(hit, found.first)
        total = np.concatenate(([0], np.cumsum(hit)))
        spans = np.diff(np.searchsorted(a, found.first))
        base = np.repeat(found.first[:-1], spans)
        clean = []
        for r in range(to - row):
            lo, hi = np.searchsorted(a, found.first[r : r + 2])
            at, parts = int(offsets[r]), []
            for i in range(lo, hi):
                parts.append(data[at : found.start[a[i]]].tobytes())
                at = int(found.end[b[i] - 1])
            clean.append(b"".join([*parts, data[at : offsets[r + 1]].tobytes()]).decode() if hi > lo else None)
        listed = [sorted(items.get(r, ())) for r in range(to - row)]
        yield pa.StructArray.from_arrays(
            [
                pa.array(found.counts, pa.int64()),
                pa.array(total[found.first[1:]] - total[found.first[:-1]], pa.int64()),
                W.list_array(
                    spans,
                    pa.StructArray.from_arrays(
                        [pa.array(a - base, pa.int32()), pa.array(b - base, pa.int32())], ["start", "end"]
                    ),
                ),
                pa.array(listed, pa.list_(pa.string())),
                pa.array(clean, pa.string()),
            ],
            ["n_words", "n_hit", "spans", "items", "clean"],
        )


def find(docs: DataFrame, benchmark: DataFrame, n: int = N, text: str = "text", out: str = "found") -> DataFrame:
    """Add struct ``out``: n_words, n_hit, spans of hit words [start, end), the items whose
    windows occur, and ``clean``, the text without the spans (NULL where nothing is hit).

    A column named like ``out`` is replaced.
    """
    spark = docs.sparkSession
    windows = item_windows(benchmark, n)
    size = windows.agg(F.sum(F.octet_length("words") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    if blocks > 1:
        windows = settle(windows)
    result = docs
    for k in range(blocks):
        part = windows.filter(F.pmod(F.xxhash64("words", "item"), F.lit(blocks)) == k) if blocks > 1 else windows
        shared = spark.sparkContext.broadcast(_index(part.collect()))

        @F.arrow_udf(FOUND)
        def scan(text: pa.Array) -> pa.Array:
            return pa.concat_arrays(_scan(text, shared.value, None)) if len(text) else pa.array([], _TYPE)

        @F.arrow_udf(FOUND)
        def rescan(text: pa.Array, known: pa.Array) -> pa.Array:
            return pa.concat_arrays(_scan(text, shared.value, known)) if len(text) else pa.array([], _TYPE)

        scan, rescan = scan.asNondeterministic(), rescan.asNondeterministic()
        result = result.withColumn(out, scan(F.col(text)) if k == 0 else rescan(F.col(text), F.col(out)))
        if k + 1 < blocks:
            result = settle(result)
    return result


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_TYPE = pa.struct(
    [
        ("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(_SPAN)),
        ("items", pa.list_(pa.string())), ("clean", pa.string()),
    ]
)


def remove(docs: DataFrame, benchmark: DataFrame, action: str = "documents", n: int = N, text: str = "text") -> DataFrame:
    """Documents without benchmark passages; the columns stay as they are.

    ``documents`` drops each document with a hit, ``spans`` cuts the hit words and what
    stands between them out of the text.
    """
    name = unused(docs, "_found")
    found = find(docs, benchmark, n, text, name)
    if action == "documents":
        kept = found.filter(F.col(name)["n_hit"] == 0)
    elif action == "spans":
        kept = found.withColumn(text, F.coalesce(F.col(name)["clean"], F.col(text)))
    else:
        raise ValueError(f"action is 'documents' or 'spans', not {action!r}")
    return kept.drop(name)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document."""
    found = find(docs.select("doc_id", "text"), benchmark)
    items = F.array_sort("found.items")
    return found.select(
        "doc_id", "found.n_words", "found.n_hit",
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )
