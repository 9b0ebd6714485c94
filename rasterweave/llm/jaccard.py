"""N-gram Jaccard join by parity sketches.

A text's set is its distinct shingles of SHINGLE words (white space between, A-Z
lower-cased; with fewer words the whole sequence, without words the empty set), as
64-bit hashes. Two sets link when 100 * intersection >= percent * union.

Sets of similar size share a band, and each band has a number of sketch blocks of 64
bits. Each shingle is XORed into one block, so the blocks in which two sketches differ
are at most as many as the elements in which the sets differ. Linked sets of
sizes a and b differ in at most d = (100 - percent) * (a + b) / (100 + percent)
elements; so under any common order of (block, value) the first d + 1 blocks of both
share one (pigeonhole). Blocks with many shingles come first, those that are
frequent in the corpus last: their frequency is counted over all documents in a
table of fixed size. Sets near a band's lower end also join the band below.

Equal sets are one node with one of its texts; a task makes keys of a node once. In each group of nodes with a common block all are held
against the smallest and the largest node; pairs whose sizes fit and whose parity sketches, with a bit
for each element, are near enough are verified on their whole sets, from the two nodes' texts. Texts that are
not asked for are left where they lie, as far as a bitmap of at most MOST_BITS bits tells; a join decides. Then pairs whose
components still differ go the same way, if FOLDED * 64 bits of their sketches let them: with fewer, most pairs
of a family just below the limit would pass. No link between different sets is lost, and a group of
thousands of copies gives twice as many pairs as it has members. Keys of blocks are
shuffled once; those in frequent places, which may be hot, are summed up before their join.

NULL and empty texts have empty sets and stand alone, texts of any length are used whole. Rows that
repeat an id, with one text or several, are
separate documents. Rows with a NULL id take part, but cannot name a component; linked
only with each other, or alone, they have NULL. Other columns do not matter, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.llm import words as W
from rasterweave.llm.columns import arrow_rows, no_late_broadcasts, unused
from rasterweave.llm.graphs import components
from rasterweave.sources.settle import forget, settle

SHINGLE = 5
PERCENT = 80
#: Places of the table of block frequencies; a block is frequent above so many times their mean.
PLACES = 1 << 16
FREQUENT = 8
_GROWTH = 5 / 3
#: Words of the sketches by which pairs of a group are held against each other; a parity sketch has as many at least.
FOLDED = 16
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1000
#: Bits of the bitmap of texts asked for: eight for each text, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27


def shingles(text: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, bounds of the texts among them), sorted and distinct in each text."""
    for _, _, data, offsets in W.chunks(text):
        found = W.Words(W.LOWER[data], offsets, W.NON_SPACE)
        hashes = found.hashes()
        at, h = found.windows(hashes, size)
        short = np.flatnonzero((found.counts > 0) & (found.counts < size))
        if len(short):
            whole = W.sums(hashes, found.first[short], found.first[short + 1])
            h = np.concatenate((h, whole))
            at = np.concatenate((at, found.first[short]))
            order = np.argsort(at, kind="stable")
            h, at = h[order], at[order]
        bounds = np.searchsorted(at, found.first)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            h[a:b].sort()
        fresh = np.ones(len(h), bool)
        fresh[1:] = h[1:] != h[:-1]
        fresh[bounds[:-1][bounds[:-1] < len(h)]] = True
        total = np.concatenate(([0], np.cumsum(fresh)))
        yield h[fresh], total[bounds]


def _summed(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit value for each set."""
    size = np.diff(bounds).astype(np.uint64)
    return W.mix(_summed(W.mix(h + np.uint64(0x632BE59BD9B4E019)), bounds) + size).view(np.int64)


def _parity(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of the parity sketches, words of each): at least as many bits as elements, and FOLDED words."""
    n = np.diff(bounds)
    length = np.maximum(FOLDED, np.int64(1) << np.ceil(np.log2(np.maximum(n, 64) / 64)).astype(np.int64))
    first = np.cumsum(length) - length
    place = np.repeat(first, n) + ((h >> np.uint64(6)) & np.repeat(length - 1, n).astype(np.uint64)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    place, bit = place[order], np.left_shift(np.uint64(1), h[order] & np.uint64(63))
    words = np.zeros(int(length.sum()), np.uint64)
    if len(place):
        opens = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        words[place[opens]] = np.bitwise_xor.reduceat(bit, opens)
    return words, length


class Bands:
    """Sizes of bands, the sketch blocks of each, and how far linked sets can differ."""

    def __init__(self, percent: int):
        self.percent = percent

    def differ(self, n: np.ndarray) -> np.ndarray:
        """Most elements in which a set of n elements differs from a linked one."""
        p = self.percent
        return (100 - p) * (n + 100 * n // p) // (100 + p)

    def start(self, band: int) -> int:
        """Smallest size in a band."""
        size = 1
        for _ in range(band):
            size = int(size * _GROWTH) + 1
        return size

    def of(self, n: np.ndarray) -> np.ndarray:
        starts = [1]
        while starts[-1] <= n.max(initial=1):
            starts.append(int(starts[-1] * _GROWTH) + 1)
        return np.searchsorted(starts, n, "right") - 1

    def blocks(self, band: int) -> int:
        """More than twice what sets that join this band differ in."""
        return 2 * int(self.differ(np.int64(100 * self.start(band + 1) // self.percent + 1))) + 2


def sketches(h: np.ndarray, bounds: np.ndarray, bands: Bands) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each band in the chunk: (texts, keys of their blocks, shingles in these), a row per text.

    Sets that can only link with equal ones are left out.
    """
    n = np.diff(bounds)
    own = bands.of(n)
    joins = np.flatnonzero(bands.differ(n) > 0)
    least = np.array([bands.start(int(b)) for b in range(own.max(initial=0) + 2)])
    below = joins[(n[joins] * bands.percent + 99) // 100 < least[own[joins]]]
    into = np.concatenate((own[joins], own[below] - 1))
    texts = np.concatenate((joins, below))
    for band in np.unique(into[into >= 0]):
        some = texts[into == band]
        m = bands.blocks(int(band))
        size = n[some]
        at = np.arange(size.sum()) + np.repeat(bounds[some] - (np.cumsum(size) - size), size)
        x = h[at]
        place = np.repeat(np.arange(len(some)) * m, size) + (((x >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        place, tokens = place[order], W.mix(x[order])
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        value = np.zeros(len(some) * m, np.uint64)
        value[place[first]] = np.bitwise_xor.reduceat(tokens, first)
        value = value.reshape(len(some), m)
        count = np.bincount(place, minlength=value.size).reshape(value.shape)
        salt = W.mix(np.arange(m, dtype=np.uint64) + np.uint64((int(band) + 1) << 32))
        yield some, W.mix(value + salt), count


def _frequent(docs: DataFrame, text: str, size: int, bands: Bands) -> np.ndarray:
    """Places of block keys that are much more frequent than the mean place."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PLACES, np.int64)
        for batch in batches:
            for h, bounds in shingles(batch.column(0), size):
                for _, keys, filled in sketches(h, bounds, bands):
                    total += np.bincount((keys[filled > 0] >> np.uint64(48)).astype(np.int64), minlength=PLACES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["place", "n"])

    counts = docs.select(F.col(text).cast("string")).mapInArrow(count, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    mean = counts.agg(F.sum("n") / PLACES).first()[0] or 0
    rows = counts.filter(F.col("n") > FREQUENT * mean).select("place").toArrow()
    table = np.zeros(PLACES, bool)
    table[rows["place"].to_numpy()] = True
    return table


def _keys(docs: DataFrame, size: int, bands: Bands, frequent: np.ndarray) -> DataFrame:
    """(key, node, late): the blocks by which each set is joined, and whether they lie in frequent places."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for h, bounds in shingles(batch.column(0), size):
                signs, need = _signatures(h, bounds), bands.differ(np.diff(bounds)) + 1
                fresh = np.zeros(len(signs), bool)
                fresh[np.unique(signs, return_index=True)[1]] = True
                fresh &= ~np.array([s in seen for s in signs.tolist()], bool)
                seen.update(signs[fresh].tolist())
                for some, keys, filled in sketches(h, bounds, bands):
                    new = fresh[some]
                    some, keys, filled = some[new], keys[new], filled[new]
                    late = frequent[(keys >> np.uint64(48)).astype(np.int64)]
                    rank = (late.astype(np.uint64) << np.uint64(63)) | ((np.uint64(64) - np.minimum(filled, 64).astype(np.uint64)) << np.uint64(56)) | (keys >> np.uint64(8))
                    order = np.argsort(rank, axis=1, kind="stable")
                    use = np.arange(keys.shape[1]) < need[some][:, None]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.take_along_axis(keys, order, 1)[use].view(np.int64)),
                        pa.array(np.repeat(signs[some], need[some])), pa.array(np.take_along_axis(late, order, 1)[use]),
                    ], ["key", "node", "late"])

    return docs.select("text").mapInArrow(emit, "key bigint, node bigint, late boolean")


def _groups(keys: DataFrame) -> DataFrame:
    """(key, node, centre, last) of nodes with a common block; centre and last are the group's smallest and largest."""
    ends = (F.min("node").alias("centre"), F.max("node").alias("last"))
    # No key outside the frequent places is held by many: one shuffle brings a group together.
    own = Window.partitionBy("key")
    rare = (
        keys.filter(~F.col("late")).select("key", "node")
        .select("key", "node", F.min("node").over(own).alias("centre"), F.max("node").over(own).alias("last"))
    )
    late = keys.filter("late").select("key", "node")
    often = late.join(late.groupBy("key").agg(*ends).filter("centre <> last"), "key")
    return rare.filter("centre <> last").distinct().union(often.distinct())


def _marks() -> tuple[Column, Column]:
    """Two hashes that stand for a text."""
    return F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g")


def _asked_for(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(h, g, text), once each, of the documents whose hashes are ``asked`` (h, g) for."""
    bits = int(min(MOST_BITS, max(LEAST_BITS, 1 << (8 * asked.count()).bit_length())))
    place = F.pmod("h", F.lit(bits))
    rows = asked.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, int(pmod(h, {bits}) & 63))").alias("bit"))
    rows = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    @F.arrow_udf("boolean")
    def maybe(h: pa.Array) -> pa.Array:
        at = h.to_numpy() & (bits - 1)
        return pa.array((shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1)

    # Copies are put together in the tasks that hold them, before the shuffle.
    texts = docs.filter("text is not null").select(*_marks(), "text").filter(maybe.asNondeterministic()("h"))
    return settle(texts.groupBy("h", "g").agg(F.first("text").alias("text")).join(asked, ["h", "g"], "left_semi"))


def _folded(s: str | Column, length: int | Column) -> Column:
    """A parity sketch folded to ``length`` words."""
    parts = F.sequence(F.lit(0), (F.size(s) / length).cast("int") - 1)
    return F.transform(
        F.sequence(F.lit(1), F.lit(length) if isinstance(length, int) else length),
        lambda i: F.aggregate(parts, F.lit(0).cast("bigint"), lambda x, k: x.bitwiseXOR(F.element_at(s, i + k * length))),
    )


def _linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose whole sets link.

    Texts are brought together, not sets: they are smaller once compressed.
    """

    @F.arrow_udf("boolean")
    def link(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(x), 64):
            sides = [
                [h[i:j] for h, bounds in shingles(text.slice(at, 64), size) for i, j in zip(bounds[:-1], bounds[1:])]
                for text in (x, y)
            ]
            for g, h in zip(*sides):
                both = int((h[np.minimum(np.searchsorted(h, g), len(h) - 1)] == g).sum())
                out.append(100 * both >= percent * (len(g) + len(h) - both))
        return pa.array(out, pa.bool_())

    def side(name):
        return nodes.select(F.col("node").alias(name), F.col("h").alias(f"h{name}"), F.col("g").alias(f"g{name}"), F.col("n").alias(f"n{name}"), F.col("sketch").alias(f"s{name}"))

    # Whether parity sketches leave a link possible. The longer one is folded.
    short = F.least(F.size("sa"), F.size("sb"))
    apart = F.aggregate(
        F.zip_with(_folded("sa", short), _folded("sb", short), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0), lambda x, n: x + n,
    )
    near = settle(
        pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
        .filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        .filter((100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b", "ha", "ga", "hb", "gb")
    )
    asked = settle(near.select(F.col("ha").alias("h"), F.col("ga").alias("g")).union(near.select("hb", "gb")).distinct())
    held = _asked_for(docs, asked)
    both = (
        near.join(held.toDF("ha", "ga", "x"), ["ha", "ga"]).select("a", "b", "hb", "gb", "x")
        .join(held.toDF("hb", "gb", "y"), ["hb", "gb"])
        .select("a", "b", link.asNondeterministic()("x", "y").alias("ok"))
    )
    done = settle(both.filter("ok").select("a", "b"))
    forget(near, asked, held)
    return done


def _fits(x: str, y: str, percent: int) -> Column:
    """Sizes and parity sketches that do not rule out a link."""
    n, o = F.col(f"{x}.n"), F.col(f"{y}.n")
    apart = sum((F.bit_count(F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))) for i in range(FOLDED)), F.lit(0))
    return (
        (100 * F.least(n, o) >= percent * F.greatest(n, o))
        & ((100 + percent) * apart <= (100 - percent) * (n + o))
    )


def _placed(docs: DataFrame, size: int, percent: int, doc_id: str, text: str) -> DataFrame:
    # All jobs that use Python run within. There are many with joins of small tables, so the driver's memory counts.
    with arrow_rows(docs.sparkSession, BATCH_ROWS), no_late_broadcasts(docs.sparkSession):
        return _placed_in_batches(docs, size, percent, doc_id, text)


def _placed_in_batches(docs: DataFrame, size: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text_hash, n, component, component_id) of each document; component is a node, NULL for empty sets."""
    bands = Bands(percent)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    @F.arrow_udf("struct<node:bigint,n:bigint,sketch:array<bigint>>")
    def signed(text: pa.Array) -> pa.Array:
        parts = [[np.zeros(0, np.int64)] for _ in range(3)]
        counts = [np.zeros(0, np.int64)]
        for h, bounds in shingles(text, size):
            words, length = _parity(h, bounds)
            columns = (_signatures(h, bounds), np.diff(bounds), words.view(np.int64))
            for part, column in zip(parts, columns):
                part.append(np.ascontiguousarray(column))
            counts.append(length)
        flat = [pa.array(np.concatenate(p)) for p in parts]
        return pa.StructArray.from_arrays(
            [*flat[:2], W.list_array(np.concatenate(counts), flat[2])], ["node", "n", "sketch"]
        )

    known = settle(
        docs.select("doc_id", *_marks(), signed.asNondeterministic()("text").alias("s")).select("doc_id", "h", "g", "s.*")
    )
    light = settle(known.filter("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("low"), F.min(F.struct("h", "g")).alias("m"), *[F.first(c).alias(c) for c in ("n", "sketch")]
    ).select("*", "m.*").drop("m"))
    groups = settle(_groups(_keys(docs, size, bands, _frequent(docs, "text", size, bands))))

    stars = (
        groups.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"))
        .union(groups.filter("node not in (centre, last)").select(F.col("node").alias("a"), F.col("last").alias("b")))
        .distinct()
    )
    links = _linked(stars, docs, light, size, percent)
    first = settle(components(links))

    # Stored, for the plan of the crossing pairs holds it four times.
    placed = settle(
        groups.filter("node not in (centre, last)").join(first, "node", "left")
        .select("key", "node", F.coalesce("component", "node").alias("component"))
    )
    forget(groups)
    split = placed.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).filter("_low <> _high").select("key")
    # Many keys name the same two nodes, so pairs are made once per pair of nodes.
    sketched = light.select("node", "n", _folded("sketch", FOLDED).alias("s"))
    sketched = sketched.select("node", "n", *[F.get("s", F.lit(i)).alias(f"s{i}") for i in range(FOLDED)])
    others = placed.join(split, "key").select("key", "node", "component").join(sketched, "node")
    x, y = others.alias("x"), others.alias("y")
    crossing = settle(
        x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node"))
               & (F.col("x.component") != F.col("y.component")) & _fits("x", "y", percent))
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"),
                F.col("x.component").alias("ca"), F.col("y.component").alias("cb")).distinct()
    )
    forget(placed)
    named = light.select("node", "low").join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if not crossing.isEmpty():
        more = _linked(crossing.select("a", "b"), docs, light, size, percent).join(crossing, ["a", "b"])
        second = components(more.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        second = settle(second.select(F.col("node").alias("component"), F.col("component").alias("_joined")))
        named = named.join(second, "component", "left").select("node", "low", F.coalesce("_joined", "component").alias("component"))
    names = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = settle(named.join(names, "component").select("node", "component", "component_id"))
    told = known.select("doc_id", "h", "n", "node").join(named, "node", "left")
    forget(light, links, crossing)
    has = F.col("n") > 0
    return told.select(
        "doc_id", F.col("h").alias("text_hash"), "n", F.when(has, F.col("component")).alias("component"),
        F.coalesce(F.when(has, F.col("component_id")), "doc_id").alias("component_id"),
    )


def classes(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document."""
    return _placed(docs, size, percent, doc_id, text).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each class, with its columns: that of the smallest id, NULL last (ties: smallest text hash).

    Of rows with equal ids and texts one stays, whichever comes first. Rows without words stand alone and all stay.
    """
    hash_, rows_ = unused(docs, "_hash"), unused(docs, "_rows")
    placed = _placed(docs, size, percent, "doc_id", "text")
    each = placed.filter("n > 0").groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    heads = each.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "n")).alias("h"))
    alone = placed.filter("n = 0").select("doc_id", "text_hash", F.lit(1).cast("bigint").alias("n")).distinct()
    kept = settle(heads.select("h.doc_id", "h.text_hash", "h.n").union(alone)).withColumnsRenamed({"text_hash": hash_, "n": rows_})

    def having(kept):
        named = docs.withColumn(hash_, F.xxhash64(F.col("text").cast("string")))
        return named.join(kept, named["doc_id"].eqNullSafe(kept["doc_id"]) & (named[hash_] == kept[hash_]), "left_semi")

    repeated = kept.filter(F.col(rows_) > 1)
    if repeated.isEmpty():
        return having(kept).drop(hash_)
    return having(kept.filter(F.col(rows_) == 1)).union(having(repeated).dropDuplicates(["doc_id", hash_])).drop(hash_)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each document, for 4 words and 85 percent."""
    return classes(docs, 4, 85)
