"""Substring dedup by suffix automata of reference shards.

Words are runs of anything but ASCII white space, unchanged. A window is LENGTH
consecutive words of one text; each word in a window whose words also start anywhere
else, in the same text or another, is removed. All windows are judged on the input.

Holding every text against the automata of a whole corpus would take passes that grow
with the corpus, so each text meets only the shards that can hold a repeat of it:

1. Each window has an anchor, its ANCHOR-word run of smallest hash (the first of
   equals), so equal windows have equal anchors. Neighbouring windows with one anchor
   make up a context of at most 2 * LENGTH - ANCHOR words. Contexts whose anchor occurs
   once in the corpus have no repeat; where all contexts of an anchor are equal, or
   one occurs more than once, its windows repeat.
2. The other contexts are dealt out by anchor. Whole groups make up shards of about
   SHARD_WORDS words; a suffix automaton with occurrence counts is built of each, the
   contexts of documents are streamed through it, and the matching statistics,
   cut at LENGTH, tell which windows occur twice.
3. An anchor with more than WIDE different contexts would make too large a shard. Its
   windows are dealt out by their own hash and counted, with a map-side combine.

Equality is that of 64-bit hashes in steps 1 and 3, and of words in step 2. A text is
known by the hash of its id and words, so repeated ids do no harm; repeated rows
repeat each other's windows. NULL and empty texts have no words. Texts of fewer than
LENGTH words stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.llm import words as W
from rasterweave.llm.columns import unused
from rasterweave.sources.settle import settle

LENGTH = 35
ANCHOR = 8
#: Words in a shard, but for the last group that goes in.
SHARD_WORDS = 100_000
#: Different contexts of one anchor that a shard takes.
WIDE = 500


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest value in each run of ``width`` values."""
    n = len(h)
    if n < width:
        return np.zeros(0, np.int64)
    bits = np.uint64(max(n.bit_length(), 1))
    low = (h >> bits << bits) | np.arange(n, dtype=np.uint64)
    have, out = 1, low
    while 2 * have <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    shift = width - have
    out = np.minimum(out[: n - width + 1], out[shift : shift + n - width + 1])
    return (out & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _contexts(found: W.Words, hashes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, text, first window, number of windows) of each context."""
    n = len(found)
    if n < length:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    at = np.arange(n - ANCHOR + 1)
    grams = W.sums(hashes, at, at + ANCHOR)
    anchor = _smallest(grams, length - ANCHOR + 1)
    owner = found.rows()
    windows = np.flatnonzero(owner[: len(anchor)] == owner[length - 1 : length - 1 + len(anchor)])
    if not len(windows):
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    place, text = anchor[windows], owner[windows]
    opens = np.ones(len(windows), bool)
    opens[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(opens)
    size = np.diff(np.append(first, len(windows)))
    return grams[place[first]], text[first], windows[first], size


class Automaton:
    """Suffix automaton of several word sequences, with weighted occurrence counts."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.link) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """A copy of q that takes over the shorter ways to it."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list, weight: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
            else:
                new = self._state(self.length[last] + 1, 0, {})
                p = last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][word]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
                last = new
            self.count[last] += weight

    def close(self) -> None:
        """Pass the counts on to all suffixes."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]

    def repeats(self, words: list, size: int) -> list[int]:
        """Where in words, all of which were added, windows of ``size`` words start that occur twice."""
        out, state = [], 0
        for i, word in enumerate(words):
            state = self.next[state][word]
            while self.length[self.link[state]] >= size:
                state = self.link[state]
            if i + 1 >= size and self.count[state] > 1:
                out.append(i + 1 - size)
        return out


def _streamed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Build an automaton of each shard of whole anchor groups, and stream its contexts."""

    def shard(rows: list) -> pa.RecordBatch:
        automaton, numbers = Automaton(), {}
        rows = [(n, rid, start, [numbers.setdefault(w, len(numbers)) for w in words]) for n, rid, start, words in rows]
        for n, _, _, words in rows:
            automaton.add(words, n)
        automaton.close()
        rids, starts = [], []
        for n, rid, start, words in rows:
            if n == 1:
                found = automaton.repeats(words, length)
                rids += [rid] * len(found)
                starts += [start + x for x in found]
        return pa.RecordBatch.from_arrays(
            [pa.array(rids, pa.int64()), pa.array(starts, pa.int32()), pa.array([1] * len(rids), pa.int32())],
            ["rid", "start", "windows"],
        )

    rows, size, last = [], 0, None
    for batch in batches:
        for anchor, n, rid, start, words in zip(*(c.to_pylist() for c in batch.columns)):
            if anchor != last and size >= SHARD_WORDS:
                yield shard(rows)
                rows, size = [], 0
            last = anchor
            words = words.split(" ")
            rows.append((min(n, 2), rid, start, words))
            size += len(words)
    yield shard(rows)


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(rid, start, windows): runs of windows that occur elsewhere, for docs (rid, text)."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(0).to_numpy()
            for row, _, data, offsets in W.chunks(batch.column(1)):
                found = W.Words(data, offsets, W.NON_SPACE)
                hashes = found.hashes()
                anchor, text, first, size = _contexts(found, hashes, length)
                context = W.sums(hashes, first, first + size + length - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), pa.array(rid[row + text]),
                        pa.array(first - found.first[text], pa.int32()), pa.array(size, pa.int32()),
                    ],
                    ["anchor", "context", "rid", "start", "windows"],
                )

    every = docs.mapInArrow(contexts, "anchor bigint, context bigint, rid bigint, start int, windows int")
    anchors = (
        every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("a"), F.max("context").alias("b"))
        .filter("n > 1").select("anchor", (F.col("a") == F.col("b")).alias("equal"))
    )
    # Stored first, so that the join below starts from exchanges and hot anchors can be split.
    hits = settle(every.join(settle(anchors), "anchor"))
    place = ["rid", "start", "windows"]
    equal, mixed = hits.filter("equal").select(place), hits.filter("not equal")
    kinds = settle(
        mixed.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*place)).alias("at"))
    )
    several = mixed.join(kinds.filter("n > 1").select("anchor", "context"), ["anchor", "context"], "left_semi").select(place)

    sizes = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    asked = (
        kinds.join(sizes, "anchor").select("at.*", "anchor", "n", (F.col("kinds") > WIDE).alias("wide"))
        .groupBy("rid").agg(F.collect_list(F.struct("start", "windows", "anchor", "n", "wide")).alias("asked"))
    )
    given = docs.join(asked, "rid")

    def fetched(batches: Iterator[pa.RecordBatch], wide: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column(0).to_pylist()
            asked = batch.column(2).to_pylist()
            for row, to, data, offsets in W.chunks(batch.column(1)):
                out = []
                found = W.Words(data, offsets, W.NON_SPACE)
                hashes = found.hashes() if wide else None
                for r in range(row, to):
                    base = int(found.first[r - row])
                    for x in asked[r]:
                        if x["wide"] is not wide:
                            continue
                        a, k = base + x["start"], x["windows"]
                        if wide:
                            at = np.arange(a, a + k)
                            for i, h in enumerate(W.sums(hashes, at, at + length).view(np.int64).tolist()):
                                out.append((h, x["n"], rids[r], x["start"] + i, None))
                        else:
                            out.append((x["anchor"], x["n"], rids[r], x["start"], found.bytes(a, a + k + length - 1).decode()))
                columns = list(zip(*out)) or [[]] * 5
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["key", "n", "rid", "start", "words"])

    schema = "key bigint, n bigint, rid bigint, start int, words string"
    given = given.select("rid", "text", "asked")
    shards = (
        given.filter(F.exists("asked", lambda x: ~x["wide"])).mapInArrow(lambda b: fetched(b, False), schema)
        .repartition("key").sortWithinPartitions("key")
    )
    streamed = shards.mapInArrow(lambda b: _streamed(b, length), "rid bigint, start int, windows int")
    windows = given.filter(F.exists("asked", lambda x: x["wide"])).mapInArrow(lambda b: fetched(b, True), schema).drop("words")
    twice = windows.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key")
    counted = windows.join(twice, "key", "left_semi").select("rid", "start", F.lit(1).alias("windows"))
    return equal.union(several).union(streamed).union(counted)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.xxhash64(doc_id, text).alias("rid"), F.col(text).cast("string").alias("text"))


def remove(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", out: str = "kept") -> DataFrame:
    """Add struct ``out``: n_words, n_removed, and ``text``, the kept words joined by one space.

    A column named like ``out`` is replaced; the others stay as they are.
    """
    key, found = unused(docs, "_rid"), unused(docs, "_spans")
    spans = (
        repeated(_keyed(docs, doc_id, text), length)
        .groupBy(F.col("rid").alias(key)).agg(F.collect_set(F.struct("start", "windows")).alias(found))
    )

    @F.arrow_udf("struct<n_words:bigint,n_removed:bigint,text:string>")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        total, removed, kept = [], [], []
        for raw, s in zip(text, spans):
            words = (raw.as_py() or "").encode().split()
            gone = 0
            if s.is_valid:
                flat = s.values
                start, size = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                drop = W.covered(len(words), start, size + length - 1)
                gone = int(drop.sum())
                kept.append(b" ".join([w for w, d in zip(words, drop.tolist()) if not d]).decode())
            else:
                kept.append(b" ".join(words).decode())
            total.append(len(words))
            removed.append(gone)
        return pa.StructArray.from_arrays(
            [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["n_words", "n_removed", "text"]
        )

    keyed = docs.withColumn(key, F.xxhash64(doc_id, text)).join(spans, key, "left")
    return keyed.withColumn(out, cut.asNondeterministic()(F.col(text).cast("string"), F.col(found))).drop(key, found)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document."""
    kept = remove(docs.select("doc_id", "text"))
    return kept.select("doc_id", "kept.n_words", "kept.n_removed", F.sha2("kept.text", 256).alias("kept_sha256"))
