"""Overlapping windows over long sequences: plan, score, stitch."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.sources.settle import forget, settle

START_CLOUDY_ABOVE = 0.1
MIN_WINDOW = 4


#: Frames of a sequence, and windows, that one row of arrays holds.
BLOCK_FRAMES = 4096
CHUNK_WINDOWS = 256


def _next_starts(first: int, coverage: np.ndarray, n: int, window: int, block: int) -> np.ndarray:
    """For each start in a block, where the next window starts, counted from ``first``; -1 after the last window."""
    stride = window // 2
    reach = math.ceil(stride / 2)
    start = np.arange(min(block, n - first))
    # Nearest first, the earlier of two equally near: the first minimum is the one to take.
    steps = np.array(sorted(range(-reach, reach + 1), key=lambda d: (abs(d), d)))
    due = start + stride
    wide = np.concatenate((coverage, np.full(max(0, len(start) + stride + reach - len(coverage)), np.inf)))
    near = wide[due[:, None] + steps]
    moved = due + steps[near.argmin(axis=1)]
    after = np.where(wide[due] <= START_CLOUDY_ABOVE, due, moved)
    last = n - window - first
    after = np.where(due > last, last, np.minimum(after, last))
    return np.where(start < last, after, -1)


def _crossing(after: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """From each start to the first one beyond the block (counted from there; -1 if the chain ends), and the windows between."""
    place, count = after.copy(), np.ones(len(after), np.int64)
    while True:
        inside = (place >= 0) & (place < len(after))
        if not inside.any():
            return np.where(place < 0, -1, place - block), count
        to = place[inside]
        # Twice as far each time: from the place reached, as far again.
        count[inside], place[inside] = count[inside] + count[to], place[to]


def _prefixes(parts: DataFrame, sample: str, number: str, then: Callable[[Column, Column], Column]) -> DataFrame:
    """(sample, number, f): ``f`` of each part applied after those of all parts before it.

    Functions are stored as values; ``then(f, g)`` is the one that applies f, then g. Parts
    reach twice as far back in each round, so the rounds grow with the logarithm of the parts.
    """
    done = settle(parts.select(sample, number, "f"))
    most = done.agg(F.max(number)).first()[0] or 0
    far = 1
    while far <= most:
        back = done.select(sample, (F.col(number) + far).alias(number), F.col("f").alias("_f"))
        joined = done.join(back, [sample, number], "left")
        joined = joined.withColumn("f", F.when(F.col("_f").isNull(), F.col("f")).otherwise(then(F.col("_f"), F.col("f"))))
        before, done = done, settle(joined.drop("_f"))
        forget(before)
        far *= 2
    return done


def plan_windows(
    coverage: DataFrame, window: int, sample: str = "sample_id", t: str = "t", block: int = BLOCK_FRAMES
) -> DataFrame:
    """Windows (sample, k, t_start, t_end) from the coverage of each frame, t from 0 without a break.

    The next start lies half a window on; if that frame is more than 10 % hidden
    it moves to the least hidden frame nearby, and the last window ends with the
    sequence. A NULL coverage counts as hidden.

    Each start depends on the one before, but every possible start knows its successor
    from the frames nearby. So a sequence is cut into blocks, and each block becomes a table: where a
    chain that enters it at one of its first frames leaves it, and after how many windows. Tables
    are composed along the blocks, and then all blocks list their windows at once. No
    task sees more of a sequence than a block.
    """
    if window < MIN_WINDOW:
        raise ValueError(f"window must be at least {MIN_WINDOW}")
    stride = window // 2
    entries = stride + math.ceil(stride / 2)
    block = max(block, entries)
    rows = coverage.select(
        sample, F.col(t).cast("bigint").alias("t"), F.coalesce(F.col("coverage").cast("double"), F.lit(1.0)).alias("coverage")
    )
    lengths = rows.groupBy(sample).agg((F.max("t") + 1).alias("n"))
    own = F.floor(F.col("t") / block).cast("bigint")
    # The first frames of a block are looked at from the block before as well.
    shared = (F.col("t") % block < entries) & (own > 0)
    placed = rows.withColumn("block", F.explode(F.when(shared, F.array(own, own - 1)).otherwise(F.array(own))))
    blocks = placed.groupBy(sample, "block").agg(F.array_sort(F.collect_list(F.struct("t", "coverage"))).alias("c"))
    blocks = blocks.select(sample, "block", F.transform("c", lambda c: c["coverage"]).alias("c")).join(lengths, sample)

    @F.arrow_udf("struct<after:array<int>,leaves:array<int>,windows:array<bigint>>")
    def local(number: pa.Array, c: pa.Array, n: pa.Array) -> pa.Array:
        out = []
        for b, cover, length in zip(number.to_pylist(), c, n.to_pylist()):
            first = b * block
            after = _next_starts(first, cover.values.to_numpy(), length, window, block) if length > window else np.array([-1])
            leaves, count = _crossing(after, block)
            out.append({"after": after, "leaves": leaves[:entries], "windows": count[:entries]})
        return pa.array(out, pa.struct([("after", pa.list_(pa.int32())), ("leaves", pa.list_(pa.int32())), ("windows", pa.list_(pa.int64()))]))

    tables = settle(
        blocks.select(sample, "block", "n", local.asNondeterministic()("block", "c", "n").alias("x"))
        .select(sample, "block", "n", "x.after", F.struct("x.leaves", "x.windows").alias("f"))
    )

    def then(f: Column, g: Column) -> Column:
        entered = lambda x: F.get(g["leaves"], x)
        return F.struct(
            F.transform(f["leaves"], lambda x: F.when(x < 0, F.lit(-1)).otherwise(F.coalesce(entered(x), F.lit(-1)))).alias("leaves"),
            F.zip_with(
                f["windows"], f["leaves"],
                lambda k, x: k + F.when(x < 0, F.lit(0).cast("bigint")).otherwise(F.coalesce(F.get(g["windows"], x), F.lit(0).cast("bigint"))),
            ).alias("windows"),
        )

    whole = _prefixes(tables, sample, "block", then)
    before = whole.select(
        sample, (F.col("block") + 1).alias("block"), F.get("f.leaves", F.lit(0)).alias("_entry"), F.get("f.windows", F.lit(0)).alias("_k")
    )
    entered = tables.drop("f").join(before, [sample, "block"], "left").withColumns({
        "_entry": F.when(F.col("block") == 0, F.lit(0)).otherwise(F.coalesce("_entry", F.lit(-1))),
        "_k": F.coalesce("_k", F.lit(0).cast("bigint")),
    })

    @F.arrow_udf("array<int>")
    def walk(after: pa.Array, entry: pa.Array) -> pa.Array:
        out = []
        for chain, at in zip(after, entry.to_pylist()):
            chain, found = chain.values.to_numpy(), []
            while 0 <= at < len(chain):
                found.append(at)
                at = int(chain[at])
            out.append(found)
        return pa.array(out, pa.list_(pa.int32()))

    starts = entered.where("_entry >= 0").select(sample, "block", "n", "_k", F.posexplode(walk("after", "_entry")).alias("_p", "_s"))
    start = F.col("block") * block + F.col("_s")
    return starts.select(
        sample, (F.col("_k") + F.col("_p")).alias("k"), start.alias("t_start"), F.least(start + window, F.col("n")).alias("t_end")
    )


def window_frames(windows: DataFrame, sample: str = "sample_id") -> DataFrame:
    """One row per window and frame, so frames join on equality of (sample, t)."""
    return windows.withColumn("t", F.explode(F.sequence("t_start", F.col("t_end") - 1)))


def score_windows(
    frames: DataFrame,
    windows: DataFrame,
    predict: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    sample: str = "sample_id",
) -> DataFrame:
    """Run ``predict`` on the frames of every window.

    ``predict`` gets the rows of one window in time order - at most ``window``
    frames - and returns rows of ``schema``, which must hold (sample, k, t).
    """
    rows = window_frames(windows, sample).join(
        frames.withColumn("t", F.col("t").cast("bigint")), [sample, "t"]
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return predict(pdf.sort_values("t").reset_index(drop=True))

    return rows.groupBy(sample, "k").applyInPandas(run, schema)


def _overlap_errors(by_frame: DataFrame, preds: Sequence[str], sample: str) -> DataFrame:
    """Mean absolute difference of every two windows that share a frame."""

    def gap(a, b):
        total = F.lit(0.0)
        n = F.lit(0)
        for p in preds:
            diffs = F.zip_with(a[p], b[p], lambda u, v: F.abs(u - v))
            total = total + F.aggregate(
                diffs, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0))
            )
            n = n + F.aggregate(diffs, F.lit(0), lambda s, v: s + v.isNotNull().cast("int"))
        return F.when(n > 0, total / n).otherwise(F.lit(0.0))

    # A frame lies in a handful of windows, whatever the length of the sequence:
    # starts are at least stride - ceil(stride/2) frames apart.
    later = F.transform(
        F.col("_in"),
        lambda b: F.transform(
            F.filter(F.col("_in"), lambda a: a["k"] < b["k"]),
            lambda a: F.struct(a["k"].alias("a"), b["k"].alias("k"), gap(a, b).alias("err")),
        ),
    )
    return by_frame.select(sample, "t", F.explode(F.flatten(later)).alias("_e")).select(
        sample, "_e.k", "t", "_e.a", "_e.err"
    )


def _named(profile: tuple[int, ...] | None) -> str:
    return "" if profile is None else ",".join(map(str, profile))


class Overlaps:
    """Differences of windows from those before them, and what follows from who owns the shared frames.

    A profile lists the owners of the frames that window k shares with window k - 1, in order
    of time, each as k minus the owner's number.
    """

    def __init__(self, rows: pa.StructArray) -> None:
        fields = [rows.field(i).to_pylist() for i in range(4)]
        self.err: dict[int, dict[int, dict[int, float]]] = {}
        for k, t, a, e in zip(*fields):
            self.err.setdefault(k, {}).setdefault(t, {})[k - a] = e
        # Only frames that the window before has too can be the one to take over at.
        self.shared = {k: sorted(t for t, by in frames.items() if 1 in by) for k, frames in self.err.items()}

    def profiles(self, k: int) -> list[tuple[int, ...]]:
        """All ways to own the shared frames of window k: later frames never by earlier windows."""
        frames = self.shared.get(k)
        if not frames:
            return []
        if k == 1:
            return [(1,) * len(frames)]
        ways: list[tuple[int, ...]] = [()]
        for t in frames:
            able = self.err[k][t]
            ways = [(*w, d) for w in ways for d in sorted(able) if not w or d <= w[-1]]
        return ways

    def follow(self, first: int, until: int, profile: tuple[int, ...]) -> tuple[list[tuple[int, int]], tuple[int, ...] | None]:
        """([(k, frame of the switch)] for the windows from ``first``, the profile of window ``until`` if it exists)."""
        switches, k = [], first
        while True:
            if k == until or k not in self.shared:
                return switches, (profile if k == until and k in self.shared else None)
            frames = self.shared[k]
            at = min(range(len(frames)), key=lambda i: (self.err[k][frames[i]][profile[i]], i))
            switches.append((k, frames[at]))
            owner = dict(zip(frames, profile))
            k += 1
            profile = tuple(1 if t >= frames[at] else owner[t] + 1 for t in self.shared.get(k, ()))


def stitch_windows(
    scored: DataFrame,
    windows: DataFrame,
    preds: Sequence[str],
    sample: str = "sample_id",
    chunk: int = CHUNK_WINDOWS,
) -> DataFrame:
    """One prediction per frame from the overlapping windows' array columns.

    Each window takes over at the frame where it differs least from the result so
    far. Differences are worked out frame by frame in parallel. What a window finds depends only on
    who owns the frames it shares with the window before, so a chunk of windows becomes
    a function from the possible owners of its first shared frames to those of the next
    chunk's; functions are composed along the chunks, and then all chunks decide at once.
    ``scored`` feeds both the differences and the result: hand over a checkpointed or stored table when
    the predictor is costly.
    """
    value = F.struct(F.col("k"), *[F.col(p) for p in preds])
    by_frame = scored.groupBy(sample, "t").agg(F.collect_list(value).alias("_in"))
    number = F.floor((F.col("k") - 1) / chunk).cast("bigint")
    # A chunk also sees the first window of the next: whose frames it must tell the owners of.
    opens = ((F.col("k") - 1) % chunk == 0) & (F.col("k") > 1)
    errors = _overlap_errors(by_frame, preds, sample).withColumn(
        "chunk", F.explode(F.when(opens, F.array(number, number - 1)).otherwise(F.array(number)))
    )
    chunks = settle(
        errors.groupBy(sample, "chunk").agg(F.array_sort(F.collect_list(F.struct("k", "t", "a", "err"))).alias("e"))
    )

    @F.arrow_udf("map<string,string>")
    def function(number: pa.Array, e: pa.Array) -> pa.Array:
        out = []
        for c, rows in zip(number.to_pylist(), e):
            steps = Overlaps(rows.values)
            first = c * chunk + 1
            entries = steps.profiles(first)
            left = [steps.follow(first, first + chunk, p)[1] for p in entries]
            out.append([(_named(p), _named(q)) for p, q in zip(entries, left)])
        return pa.array(out, pa.map_(pa.string(), pa.string()))

    functions = chunks.select(sample, "chunk", function.asNondeterministic()("chunk", "e").alias("f"))
    # An owner's name is its distance from the window that asks, so names hold for every chunk.
    whole = _prefixes(functions, sample, "chunk", lambda f, g: F.transform_values(f, lambda _, p: F.try_element_at(g, p)))
    given = whole.select(sample, (F.col("chunk") + 1).alias("chunk"), F.element_at(F.map_values("f"), 1).alias("_entry"))

    @F.arrow_udf("array<struct<k:bigint,t_switch:bigint>>")
    def decide(number: pa.Array, e: pa.Array, entry: pa.Array) -> pa.Array:
        out = []
        for c, rows, name in zip(number.to_pylist(), e, entry.to_pylist()):
            steps = Overlaps(rows.values)
            first = c * chunk + 1
            profile = steps.profiles(first)[0] if c == 0 else tuple(int(x) for x in name.split(",") if x)
            out.append([{"k": k, "t_switch": s} for k, s in steps.follow(first, first + chunk, profile)[0]])
        return pa.array(out, pa.list_(pa.struct([("k", pa.int64()), ("t_switch", pa.int64())])))

    decided = chunks.join(given, [sample, "chunk"], "left")
    switched = decided.select(sample, F.explode(decide("chunk", "e", "_entry")).alias("_d")).select(sample, "_d.*")
    owners = (
        windows.join(switched, [sample, "k"], "left")
        .select(
            sample,
            "k",
            F.explode(
                F.sequence(F.coalesce("t_switch", "t_start"), F.col("t_end") - 1)
            ).alias("t"),
        )
        .groupBy(sample, "t")
        .agg(F.max("k").alias("owner"))
    )
    chosen = F.get(F.filter(F.col("_in"), lambda w: w["k"] == F.col("owner")), F.lit(0))
    return (
        by_frame.join(owners, [sample, "t"])
        .withColumn("_c", chosen)
        .select(sample, "t", "owner", *[F.col(f"_c.{p}").alias(p) for p in preds])
    )
