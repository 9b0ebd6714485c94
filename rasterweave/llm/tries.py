"""The prefix trie of conversations: a node for each distinct sequence of first turns.

A conversation is a path of turns, each told by TOKEN bytes: a digest of role and text,
and the size of the text. Equal paths are one row. Splitters, taken from a bounded
sample of the paths, cut the sorted paths into ranges. A node lies in several ranges only
if a splitter goes on below it, so the proper prefixes of the splitters - a small trie,
the skeleton - are sent to all. Each range is sorted and read once, with the open nodes of
the current path on a stack, and finishes all other nodes. Of a skeleton node it gives what
its own paths hold; these parts are added up, and what skeleton nodes owe to those below
them follows from the skeleton alone.

Splitters are cut to what tells them from the path before them in the sample, so the
skeleton holds only prefixes that paths share, SAMPLE_TURNS for each of RANGES at most. The digest of the
conversations that end at a node reads their ids in order, in strings of at most ID_BLOCK
ids, and keeps no more than one of them.

Turns are ordered by turn, NULL first; ties by the digest of role and text. NULL roles and
texts count as empty, rows repeat as often as they stand there, and rows without conv_id take no
part. An empty table has no nodes. Texts stay where they are: only their digests travel.
A conversation's digests (24 bytes a turn) are one row, so they must fit a task.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.sources.settle import settle

TOKEN = 24
#: Ranges at most, and paths that a range should hold at least.
RANGES = 8_192
RANGE_PATHS = 10_000
#: Paths of the sample for each range, and first turns of these that are looked at.
SAMPLE_A_RANGE = 4
SAMPLE_TURNS = 256
ID_BLOCK_BITS = 14
_FLUSH = 10_000


def turn_tokens(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, token) of rows (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    size = F.lpad(F.hex(F.octet_length(text).cast("bigint")), 16, "0")
    return turns.filter("conv_id is not null").select("conv_id", "turn", F.unhex(F.concat(F.substring(said, 1, 32), size)).alias("token"))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, tokens): the turns of each conversation in order."""
    rows = turn_tokens(turns).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "token"))).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda t: t["token"]).alias("tokens"))


def path(tokens: Column) -> Column:
    """Tokens as one binary value, ordered like the sequence."""
    return F.aggregate(tokens, F.lit(b""), lambda done, t: F.concat(done, t))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per path from rows (path, ids, n, low) sorted by path and block of ids."""
    schema = pa.schema([("path", pa.binary()), ("n", pa.int64()), ("low", pa.int64()), ("ends", pa.string())])
    current, state, n, low = None, None, 0, 0
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)
        out.clear()
        return made

    for batch in batches:
        for p, ids, count, least in zip(*[batch.column(i) for i in range(4)]):
            p, ids = p.as_py(), ids.as_py().encode()
            if p == current:
                state.update(b"," + ids)
                n, low = n + count.as_py(), min(low, least.as_py())
                continue
            if current is not None:
                out.append((current, n, low, state.hexdigest()))
            current, state, n, low = p, hashlib.sha256(ids), count.as_py(), least.as_py()
        yield flush()
    if current is not None:
        out.append((current, n, low, state.hexdigest()))
        yield flush()


def distinct_paths(paths: DataFrame) -> DataFrame:
    """(path, n, low, ends) of rows (conv_id, path): how many conversations have it, the smallest, and the digest of their ids."""
    blocks = paths.groupBy("path", F.shiftright("conv_id", ID_BLOCK_BITS).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"),
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"),
    )
    ordered = blocks.repartition("path").sortWithinPartitions("path", "block").select("path", "ids", "n", "low")
    return ordered.mapInArrow(_ends, "path binary, n bigint, low bigint, ends string")


def _shared(a: bytes, b: bytes) -> int:
    """How many tokens two paths begin with in common."""
    top = min(len(a), len(b)) // TOKEN
    low = 0
    if a[: top * TOKEN] == b[: top * TOKEN]:
        return top
    while low < top:
        mid = (low + top) // 2
        if a[: (mid + 1) * TOKEN] == b[: (mid + 1) * TOKEN]:
            low = mid + 1
        else:
            top = mid
    return low


def splitters(paths: DataFrame, ranges: int) -> list[bytes]:
    """Bounds of about equal ranges of the distinct paths, each cut to what tells it from the path before."""
    sample = paths.orderBy(F.xxhash64("path"), "path").limit(SAMPLE_A_RANGE * ranges).select(
        F.substring("path", 1, SAMPLE_TURNS * TOKEN).alias("path")
    )
    some = sorted(bytes(r["path"]) for r in sample.collect())
    step = max(1, len(some) // ranges)
    bounds = []
    for i in range(step, len(some), step):
        keep = _shared(some[i - 1], some[i]) + 1
        bounds.append(some[i][: keep * TOKEN])
    return bounds


def skeleton(bounds: list[bytes]) -> dict[tuple[int, bytes], int]:
    """The trie of the splitters' proper prefixes: numbers of nodes by (number of the parent, token). The root is 0."""
    trie: dict[tuple[int, bytes], int] = {}
    for b in bounds:
        node = 0
        for i in range(0, len(b) - TOKEN, TOKEN):
            node = trie.setdefault((node, b[i : i + TOKEN]), len(trie) + 1)
    return trie


class _Node:
    """An open node of the current path."""

    __slots__ = ("bone", "size", "n", "low", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, bone: int | None, size: int):
        self.bone, self.size = bone, size
        self.n = self.children = self.leaves = self.saved = 0
        self.low: int | None = None
        self.ends: str | None = None
        #: Finished children, which lack no more than this node's smallest member.
        self.waiting: list[tuple] = []


_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string, parent int, bone int"
_NAMES = [c.split()[0] for c in _NODE.split(", ")]
_TYPES = [pa.string() if c.split()[1] == "string" else pa.int32() if c.split()[1] == "int" else pa.int64() for c in _NODE.split(", ")]


def _shards(trie: dict[tuple[int, bytes], int]):
    """Finishes the nodes of ranges of sorted paths, as rows (shard, path, n, low, ends)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        stack: list[_Node] = []
        last, shard = b"", None

        def close() -> None:
            node, depth = stack.pop(), len(stack)
            if not node.children and node.bone is None:
                node.leaves = 1
            if node.bone is None:
                node.saved += (node.n - 1) * node.size
                for w in node.waiting:
                    out.append((w[0], w[1], node.low, *w[2:], None, None))
                row = (node.low, depth, node.n, node.children, node.leaves, node.saved, node.ends)
                parent = stack[-1]
                parent.children += 1
                if parent.bone is None:
                    parent.waiting.append(row)
                else:
                    out.append((row[0], row[1], None, *row[2:], parent.bone, None))
            else:
                out.append((node.low, depth, None, node.n, node.children, node.leaves, node.saved, node.ends, None, node.bone))
            if stack:
                parent = stack[-1]
                parent.n += node.n
                parent.leaves += node.leaves
                parent.saved += node.saved
                parent.low = node.low if parent.low is None else min(parent.low, node.low)

        def flush() -> pa.RecordBatch:
            columns = zip(*out) if out else [[] for _ in _TYPES]
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _TYPES)], _NAMES)
            out.clear()
            return made

        for batch in batches:
            for number, p, n, low, ends in zip(*[batch.column(i) for i in range(5)]):
                number, p, n, low = number.as_py(), p.as_py(), n.as_py(), low.as_py()
                if number != shard:
                    while stack:
                        close()
                    stack.append(_Node(0, 0))
                    last, shard = b"", number
                keep = _shared(last, p) + 1
                while len(stack) > keep:
                    close()
                for i in range((len(stack) - 1) * TOKEN, len(p), TOKEN):
                    token, above = p[i : i + TOKEN], stack[-1].bone
                    stack.append(_Node(None if above is None else trie.get((above, token)), int.from_bytes(token[16:], "big")))
                node = stack[-1]
                node.n += n
                node.low = low if node.low is None else min(node.low, low)
                node.ends = ends.as_py()
                last = p
                if len(out) > _FLUSH:
                    yield flush()
            yield flush()
        while stack:
            close()
        yield flush()

    return scan


def trie(paths: DataFrame, ranges: int | None = None) -> DataFrame:
    """A row per node of the trie of rows (conv_id, path); ``ends_sha256`` is the digest of the members that end there."""
    spark = paths.sparkSession
    distinct = settle(distinct_paths(paths))
    if ranges is None:
        ranges = int(min(RANGES, 1 + distinct.count() // RANGE_PATHS))
    bounds = splitters(distinct, ranges)
    bones = skeleton(bounds)
    sent = spark.sparkContext.broadcast(bounds)

    @F.arrow_udf("int")
    def shard(p: pa.Array) -> pa.Array:
        return pa.array([bisect.bisect_right(sent.value, x.as_py()) for x in p], pa.int32())

    ranged = distinct.withColumn("shard", shard("path")).repartition(max(1, len(bounds) + 1), "shard").sortWithinPartitions("shard", "path")
    done = settle(ranged.select("shard", "path", "n", "low", "ends").mapInArrow(_shards(bones), _NODE))

    # The skeleton: parts added up, then what each node owes to the skeleton nodes below it.
    lines = [(0, None, 0, 0, [0])]
    for (parent, token), bone in bones.items():
        above = lines[parent]
        lines.append((bone, parent, above[2] + 1, int.from_bytes(token[16:], "big"), [*above[4], bone]))
    frame = spark.createDataFrame(lines, "bone int, above int, level bigint, size bigint, line array<int>")
    parts = done.filter("bone is not null").groupBy("bone").agg(
        F.min("conv_id").alias("low"), F.sum("n_convs").alias("n"), F.sum("n_children").alias("children"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("ends").alias("ends"),
    )
    joint = settle(frame.join(parts, "bone"))
    owed = joint.select(F.explode("line").alias("bone"), ((F.col("n") - 1) * F.col("size")).alias("own")).groupBy("bone").agg(F.sum("own").alias("owed"))
    kids = joint.filter("above is not null").groupBy(F.col("above").alias("bone")).agg(F.count(F.lit(1)).alias("more"))
    above = joint.select(F.col("bone").alias("parent"), F.col("low").alias("parent_low"))
    top = (
        joint.join(owed, "bone").join(kids, "bone", "left").withColumnRenamed("above", "parent").join(above, "parent", "left")
        .select(
            F.col("low").alias("conv_id"), F.col("level").alias("depth"), F.col("parent_low").alias("parent_conv_id"),
            F.col("n").alias("n_convs"), (F.col("children") + F.coalesce("more", F.lit(0))).alias("n_children"),
            # A tree without splitters has a root only here.
            F.when((F.col("children") == 0) & F.col("more").isNull(), F.lit(1)).otherwise(F.col("leaves")).cast("bigint").alias("n_leaves"),
            (F.col("saved") + F.col("owed")).alias("saved_tokens"), "ends",
        )
    )
    below = done.filter("bone is null").join(above, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "parent_low"))
    return below.select(*top.columns).union(top).withColumn("ends_sha256", F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest()))).drop("ends")


def branched(turns: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """(conv_id, path): each conversation with the first turns of the first one of its family in place of its own.

    The first h turns of conversation c - c % family, then those of c after its first h, where h is crc32(c) % heads.
    """
    own = settle(sequences(turns))
    base = own.select(F.col("conv_id").alias("base"), F.slice("tokens", 1, heads - 1).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    rows = own.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(base, "base", "left")
    none = F.array().cast("array<binary>")
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("first", none), F.lit(1), F.col("h"))).otherwise(none)
    rest = F.slice("tokens", F.col("h") + 1, F.greatest(F.size("tokens") - F.col("h"), F.lit(0)))
    return rows.select("conv_id", path(F.concat(head, rest)).alias("path"))


def digest(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations."""
    return trie(branched(conversations)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
