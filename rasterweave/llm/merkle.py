"""A manifest of a table as Merkle trees: a root, and for each row the proof that leads to it.

A row's leaf is the hex SHA-256 of its fields, each ``-`` if NULL, else its UTF-8 byte
count, ``:`` and its value. Leaves of a group (a language) ascend by id; every two
consecutive nodes, the last one alone if need be, become the hash of their concatenated
digests, until one is left, the subroot. Subroots in the order of their groups (NULL
first, then by bytes) are the leaves of one more tree, whose root stands for the table.

Each aligned block of BLOCK leaves keeps a level of its part of the tree as one string of
digests, 64 hex digits each. Parents are hashes of substrings of 128 digits, and what
stands beside a node within its pair, to the left or right, is a substring too: these are the
siblings of a proof. The roots of the blocks are the leaves of the next tree, treated
alike, until one block holds a group. Digests are held as bytes, in which substrings
need no search for characters.

Rows with a NULL id come first in their group. Rows that repeat an id are ordered by leaf;
wholly equal rows have equal leaves and take neighbouring places. Texts of any length are
hashed where they lie, and other columns take no part. An empty table has no rows and no root.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.llm.ranks import numbered
from rasterweave.sources.settle import settle

HEIGHT = 10
BLOCK = 1 << HEIGHT
_DIGITS = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row's fields."""
    told = []
    for v in values:
        v = v.cast("string")
        told.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.sha2(F.concat(*told), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(proof, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """The digest of a proof's siblings, from the leaf's level to the root's."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _parents(level: Column) -> Column:
    last = F.ceil(F.octet_length(level) / (2 * _DIGITS)).cast("int") - 1
    hashed = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.sha2(F.substring(level, i * (2 * _DIGITS) + 1, F.lit(2 * _DIGITS)), 256)
    )
    return F.array_join(hashed, "").cast("binary")


def _beside(levels: Column, height: Column, place: Column) -> Column:
    """What flanks a leaf, and each node above it, within its pair."""

    def level(k: Column) -> Column:
        node = F.floor(place / F.pow(F.lit(2), k)).cast("int")
        odd = node % 2
        digits = F.element_at(levels, k + 1)
        return F.struct(
            F.substring(digits, (node - odd) * _DIGITS + 1, odd * _DIGITS).cast("string").alias("left"),
            F.substring(digits, (node + 1) * _DIGITS + 1, (1 - odd) * _DIGITS).cast("string").alias("right"),
        )

    return F.transform(F.slice(F.array(*[F.lit(k) for k in range(HEIGHT)]), F.lit(1), height), level)


def _blocks(nodes: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Blocks (g, block, n, height, levels, members) of nodes (g, idx, n, hash, keep); n counts the group's nodes."""
    member = F.struct((F.col("idx") % BLOCK).cast("int").alias("place"), "hash", *keep)
    powers = F.array(*[F.lit(1 << k).cast("bigint") for k in range(HEIGHT)])
    together = (
        nodes.groupBy("g", "n", F.floor(F.col("idx") / BLOCK).cast("bigint").alias("block"))
        .agg(F.array_sort(F.collect_list(member)).alias("members"))
        # As many levels as it takes to come to one node; a block of a larger tree has all of them.
        .withColumn("height", F.size(F.filter(powers, lambda p: p < F.col("n"))))
        .withColumn("level", F.array_join(F.transform("members", lambda m: m["hash"]), "").cast("binary"))
    )
    levels = F.aggregate(
        F.array_repeat(F.lit(0), F.col("height")), F.array("level").cast("array<binary>"),
        lambda done, _: F.concat(done, F.array(_parents(F.element_at(done, -1)))),
    )
    return settle(together.withColumn("levels", levels).drop("level"))


def _climb(blocks: DataFrame) -> DataFrame:
    """(g, block, root, above): the root of each block's group, and what flanks the way from the block's root to it."""
    tops = blocks.select("g", "block", "n", F.element_at("levels", -1).cast("string").alias("hash"))
    if tops.filter(F.col("n") > BLOCK).isEmpty():
        none = F.array().cast("array<struct<left:string,right:string>>")
        return tops.select("g", "block", F.col("hash").alias("root"), none.alias("above"))
    nodes = tops.select("g", F.col("block").alias("idx"), F.ceil(F.col("n") / BLOCK).cast("bigint").alias("n"), "hash")
    return settle(_proofs(_blocks(nodes, ["idx"]), ["idx"]).select("g", F.col("idx").alias("block"), "root", F.col("proof").alias("above")))


def _proofs(blocks: DataFrame, keep: Sequence[str], roots: DataFrame | None = None) -> DataFrame:
    """(g, hash, keep, root, proof) of each node of the blocks, with the columns of ``roots`` (g, root, ...) if given."""
    paths = _climb(blocks) if roots is None else roots
    more = [c for c in paths.columns if c not in ("g", "block", "root", "above")]
    each = F.transform(
        "members",
        lambda m: F.struct(
            m["hash"].alias("hash"), *[m[c].alias(c) for c in keep],
            _beside(F.col("levels"), F.col("height"), m["place"]).alias("within"),
        ),
    )
    rows = blocks.join(paths, ["g", "block"]).select("g", "root", "above", *more, F.explode(each).alias("_m"))
    return rows.select("g", "root", *more, "_m.*", F.concat("_m.within", "above").alias("proof")).drop("within")


def manifest(leaves: DataFrame, keep: Sequence[str] = (), group: str = "lang", order: str = "doc_id", leaf: str = "leaf") -> DataFrame:
    """(keep, leaf, subroot, root, proof) of each row; proof lists siblings as (left, right), one of them empty."""
    # A sortable key without NULL: NULL is '-', which stands before '='.
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    rows = leaves.select(
        key.alias("g"), F.col(order).alias("_order"), F.col(leaf).alias("hash"), F.monotonically_increasing_id().alias("_row"), *keep
    )
    blocks = _blocks(numbered(settle(rows), "g", ["_order", "hash", "_row"]).drop("_order", "_row"), keep)
    paths = _climb(blocks)

    subroots = paths.filter("block = 0").select(F.lit(0).alias("_all"), F.col("g").alias("_group"), F.col("root").alias("hash"))
    nodes = numbered(subroots, "_all", ["_group"]).withColumnRenamed("_all", "g")
    tops = _proofs(_blocks(nodes, ["_group"]), ["_group"]).select(
        F.col("_group").alias("g"), F.col("root").alias("table_root"), F.col("proof").alias("way")
    )
    whole = paths.join(tops, "g").select("g", "block", "root", "table_root", F.concat("above", "way").alias("above"))
    return _proofs(blocks, keep, whole).select(
        *keep, F.col("hash").alias("leaf"), F.col("root").alias("subroot"), F.col("table_root").alias("root"), "proof"
    )


def digest(docs: DataFrame) -> DataFrame:
    """Each document's leaf, roots, proof and the root folded from it; where 7 divides the id's crc32, from a leaf with n_chars one higher."""
    true = [F.col(c) for c in FIELDS]
    false = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = docs.select("doc_id", "lang", leaf(true).alias("leaf"), F.when(tampered, leaf(false)).alias("told"))
    done = manifest(leaves, ["doc_id", "told"]).withColumn("folded_root", fold(F.coalesce("told", "leaf"), F.col("proof")))
    return done.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
