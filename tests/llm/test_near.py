"""Decontamination, substring dedup and Jaccard join against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweave.llm import decontamination, graphs, jaccard, substrings
from rasterweave.llm.columns import no_late_broadcasts
from tests.llm import brute

DOCS = "doc_id bigint, text string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def prose(rng, n, kinds):
    return " ".join(f"{rng.choice('aBé')}{rng.randrange(kinds)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    shared = [prose(rng, 60, 400) for _ in range(4)]
    out = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(0, 80), 400)]
        if i % 3 == 0:
            parts.insert(rng.randrange(2), shared[i % 4])
        out.append((i, rng.choice([" ", "\n", " \t "]).join(parts)))
    base = prose(rng, 120, 400).split(" ")
    for i in range(60, 80):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        out.append((i, " ".join(w)))
    out += [(80, None), (81, ""), (82, "one two"), (83, "ONE  two"), (84, out[0][1]), (85, "ab " * 90), (86, "solo")]
    return out


def test_contaminated(spark, texts, monkeypatch):
    items = [(1, " ".join(texts[4][1].split()[:25])), (2, "Solo!"), (3, None), (4, "..."), (10, texts[61][1]), (10, texts[61][1])]
    items += [(7, "aB"), (None, "ONE two")]
    docs, bench = spark.createDataFrame(texts, DOCS), spark.createDataFrame(items, "item_id bigint, text string")
    wanted = sorted(brute.contaminated(texts, items), key=str)
    assert rows(decontamination.digest(docs, bench)) == wanted
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 2000)
    assert rows(decontamination.digest(docs, bench)) == wanted


def test_contaminated_spans_and_empty(spark):
    docs = spark.createDataFrame([(1, "Keep this. Bad words here, and keep that.", 5)], "doc_id bigint, text string, _found int")
    bench = spark.createDataFrame([(1, "bad WORDS here")], "item_id bigint, text string")
    assert decontamination.remove(docs, bench).count() == 0
    kept = decontamination.remove(docs, bench, "spans").first()
    assert kept["text"] == "Keep this. , and keep that." and kept["_found"] == 5
    none = bench.limit(0)
    assert decontamination.remove(docs, none).count() == 1
    assert rows(decontamination.digest(docs.limit(0), bench)) == []
    with pytest.raises(ValueError):
        decontamination.remove(docs, bench, "other")


@pytest.mark.parametrize("wide", [500, 1])
def test_substrings(spark, texts, monkeypatch, wide):
    monkeypatch.setattr(substrings, "WIDE", wide)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 300)
    docs = spark.createDataFrame(texts, DOCS)
    assert rows(substrings.digest(docs)) == sorted(brute.deduplicated(texts), key=str)


def test_substrings_repeated_rows_and_names(spark):
    long = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, long, 1), (1, long, 2), (None, long + " end", 3)], "doc_id bigint, text string, _rid int")
    got = substrings.remove(docs).select("_rid", "kept.n_words", "kept.n_removed", "kept.text")
    assert rows(got) == [(1, 50, 50, ""), (2, 50, 50, ""), (3, 51, 50, "end")]
    assert rows(substrings.digest(docs.limit(0))) == []


def test_automaton_counts():
    rng = random.Random(1)
    for _ in range(30):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(4, 30))] for _ in range(4)]
        automaton = substrings.Automaton()
        for t in texts:
            automaton.add(t, 1)
        automaton.close()
        windows = [tuple(t[i : i + 4]) for t in texts for i in range(len(t) - 3)]
        for t in texts:
            wanted = [i for i in range(len(t) - 3) if windows.count(tuple(t[i : i + 4])) > 1]
            assert automaton.repeats(t, 4) == wanted


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80), (2, 60)])
def test_jaccard(spark, texts, size, percent):
    docs = spark.createDataFrame(texts, DOCS)
    assert rows(jaccard.classes(docs, size, percent)) == sorted(brute.classes(texts, size, percent), key=str)


def test_jaccard_pairs_across_components(spark):
    """Chains whose members share blocks but are not all linked with the smallest node."""
    rng = random.Random(5)
    base, texts = [f"t{i}" for i in range(200)], []
    for i in range(60):
        at = rng.randrange(0, 190)
        base[at : at + 2] = [f"u{i}", f"v{i}"]
        texts.append((i, " ".join(base)))
    rng.shuffle(texts)
    got = rows(jaccard.classes(spark.createDataFrame(texts, DOCS), 4, 85))
    assert got == sorted(brute.classes(texts, 4, 85), key=str)


def test_jaccard_edges(spark):
    docs = spark.createDataFrame(
        [(None, "a b c d e f"), (3, "a b c d e f"), (3, "other words"), (None, "alone"), (5, None)],
        "doc_id bigint, text string",
    ).withColumn("node", F.lit(1))
    assert rows(jaccard.classes(docs)) == sorted([(None, 2, 3), (3, 2, 3), (3, 1, 3), (None, 1, None), (5, 0, 5)], key=str)
    assert sorted(jaccard.keep_first(docs).columns) == ["doc_id", "node", "text"]
    assert rows(jaccard.digest(docs.limit(0))) == []


def test_jaccard_keeps_one_row_of_each_class(spark):
    rng = random.Random(8)
    long, other = prose(rng, 60, 400), prose(rng, 60, 400)
    texts = [
        (1, long), (1, long), (2, long + " end"), (2, other), (4, other + " end"), (5, "a b c"), (5, "d e f"),
        (None, long), (None, "x y z"), (None, "x y z"), (None, "u v w"), (6, None), (7, ""), (7, ""),
    ]
    docs = spark.createDataFrame([(*t, i) for i, t in enumerate(texts)], DOCS + ", _hash int")
    got = rows(jaccard.keep_first(docs).select("doc_id", "text"))
    wanted = [(1, long), (2, other), (5, "a b c"), (5, "d e f"), (None, "x y z"), (None, "u v w"), (6, None), (7, ""), (7, "")]
    assert got == sorted(wanted, key=str)
    twice = docs.union(docs).filter("text <> ''")
    assert rows(jaccard.keep_first(twice).select("doc_id", "text")) == sorted([w for w in wanted if w[1]], key=str)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_jaccard_ids_of_many_texts(spark, doc_id):
    """A thousand texts without an id, or with the same one: texts are fetched by node, not by id."""
    rng = random.Random(4)
    texts = []
    for _ in range(500):
        w = prose(rng, 40, 5000).split(" ")
        texts += [" ".join(w), " ".join([*w, "more"])]
    docs = spark.createDataFrame([(doc_id, t) for t in texts], DOCS)
    got = jaccard.classes(docs, 4, 85).collect()
    assert len(got) == 1000 and {r["component_id"] for r in got} == {doc_id}
    assert jaccard.keep_first(docs, 4, 85).count() == 500


def test_jaccard_long_text(spark):
    rng = random.Random(6)
    long = prose(rng, 60_000, 40_000)
    docs = spark.createDataFrame([(2, long), (1, long + " end"), (3, long[: len(long) // 2])], DOCS)
    assert {(r["doc_id"], r["component_id"]) for r in jaccard.digest(docs).collect()} == {(1, 1), (2, 1), (3, 3)}


def test_bands_cover_all_linked_sizes():
    for percent in (60, 80, 85):
        bands = jaccard.Bands(percent)
        n = np.arange(1, 3000)
        differ, band = bands.differ(n), bands.of(n)
        for a in range(1, 1500, 7):
            most = 100 * a // percent
            for b in (a, (a + most) // 2, most):
                # The most that linked sets of these sizes differ in fits both and the sketch.
                d = (100 - percent) * (a + b) // (100 + percent)
                assert d <= min(differ[a - 1], differ[b - 1])
                assert band[b - 1] - band[a - 1] <= 1
                assert differ[b - 1] < bands.blocks(int(band[a - 1]))


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = dict(map(tuple, graphs.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
    assert graphs.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_are_stored_in_small_plans(spark, monkeypatch):
    reads, store = [], graphs.settle
    monkeypatch.setattr(graphs, "settle", lambda df: (reads.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size()), store(df))[1])
    links = [(i, i + 1) for i in range(40)]
    got = graphs.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r["component"] for r in got} == {0} and len(got) == 41
    assert len(reads) > 4 and max(reads) <= 6


def tasks_of(spark, group, run):
    """What ``run`` gives and the tasks it takes with 20 partitions to each shuffle, however little is in them."""
    names = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in names}
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    for k, v in names.items():
        spark.conf.set(k, v)
    sc.setJobGroup(group, group)
    try:
        out = run()
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
        return out, sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_components_take_few_tasks(spark):
    """The driver keeps record of each task."""
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
    with no_late_broadcasts(spark):
        got, tasks = tasks_of(spark, "components", lambda: graphs.components(links).collect())
    assert {tuple(r) for r in got} == {(i, 0) for i in range(41)}
    assert tasks < 900


def test_jaccard_broadcasts_no_shuffled_tables(spark):
    seen, key = [], "spark.sql.adaptive.autoBroadcastJoinThreshold"
    docs = spark.createDataFrame([(i, "a b c d e f g") for i in range(3)], DOCS)
    before, keys = spark.conf.get(key, None), jaccard._keys
    with pytest.MonkeyPatch.context() as m:
        m.setattr(jaccard, "_keys", lambda *a: (seen.append(spark.conf.get(key, None)), keys(*a))[1])
        jaccard.classes(docs, 5, 80).collect()
    assert seen == ["-1"] and spark.conf.get(key, None) == before


def test_jaccard_family_below_the_limit_is_not_verified_by_pairs(spark, monkeypatch):
    """Copies that share blocks but differ in more than linked sets can: the sketches tell them apart."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    docs = []
    for d in range(30):
        w = list(base)
        for at in rng.sample(range(0, 400, 10), 6):
            w[at] = f"x{d}.{at}"
        docs.append((d, " ".join(w)))
    made, linked = [], jaccard._linked

    def counted(pairs, *rest):
        made.append(pairs.count())
        return linked(pairs, *rest)

    monkeypatch.setattr(jaccard, "_linked", counted)
    assert rows(jaccard.classes(spark.createDataFrame(docs, DOCS), 5, 80)) == sorted(brute.classes(docs, 5, 80), key=str)
    assert sum(made[1:]) < 100
