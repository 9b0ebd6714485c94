"""Prefix trie, Merkle manifest and WARC archives against plain versions."""

from __future__ import annotations

import gzip
import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rasterweave.llm import archives, merkle, ranks, tries
from tests.compare import connect, differences, spark_rows, sql_rows
from tests.llm.brute import sha

TURNS = "conv_id bigint, turn bigint, role string, text string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- prefix trie ------------------------------------------------------------
def plain_trie(turns):
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    paths = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(c - c % 5, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = sorted(c for c in m if paths[c] == p)
        parent = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), kids[p], sum(not kids[q] for q in below), saved, sha(",".join(map(str, ends)))))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(5)
    out = []
    for conv in [*range(40), 100, 101, 103, 2**40 + 1, 2**40]:
        for turn in range(rng.randrange(0, 12)):
            out.append((conv, turn, rng.choice(["user", "assistant"]), rng.choice(["é", "yes", "no way"])))
    out += [(50 + i, t, "user", "same") for i in range(9) for t in range(10)]
    out += [(60, None, None, None), (60, 3, None, "x"), (61, None, "user", ""), (None, 1, "user", "lost")]
    out += [(65, t, "user", f"turn {t}") for t in range(300)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("ranges", [1, 4, 40])
def test_trie(spark, turns, monkeypatch, ranges):
    monkeypatch.setattr(tries, "ID_BLOCK_BITS", 1)
    monkeypatch.setattr(tries, "_FLUSH", 3)
    df = spark.createDataFrame(turns, TURNS).withColumn("path", F.lit(1)).withColumn("ends", F.lit("x")).repartition(3)
    got = tries.trie(tries.branched(df), ranges).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert rows(got) == plain_trie(turns)


def test_skeleton_is_used(spark, turns):
    paths = tries.branched(spark.createDataFrame(turns, TURNS))
    bounds = tries.splitters(tries.distinct_paths(paths), 40)
    assert len(bounds) > 10 and bounds == sorted(bounds)
    assert len(tries.skeleton(bounds)) > 5


def test_trie_edges(spark):
    empty = spark.createDataFrame([], TURNS)
    assert rows(tries.digest(empty)) == []
    turnless = [(0, None, None, None), (7, 0, "user", "a"), (7, 0, "user", "a")]
    assert rows(tries.digest(spark.createDataFrame(turnless, TURNS))) == plain_trie(turnless)
    only_heads = [(1, t, "user", "b") for t in range(2)]  # no conversation 0: its first turns are gone
    assert rows(tries.digest(spark.createDataFrame(only_heads, TURNS))) == plain_trie(only_heads)
    long = [(3, t, "user", "z" * 200_000) for t in range(12)]
    assert rows(tries.digest(spark.createDataFrame(long, TURNS))) == plain_trie(long)


# --- Merkle manifest --------------------------------------------------------
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plain_manifest(docs):
    def told(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(d, more=0):
        doc, text, lang, source, n = d
        return sha("".join(map(told, (doc, source, lang, None if n is None else n + more, text))))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
        return levels

    def way(levels, i):
        out = []
        for level in levels[:-1]:
            j = i ^ 1
            out.append((level[j] if j < i else "", level[j] if i < j < len(level) else ""))
            i //= 2
        return out

    groups = defaultdict(list)
    for d in docs:
        groups[d[2]].append(d)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
        trees[g] = tree([leaf(d) for d in groups[g]])
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, d in enumerate(groups[g]):
            proof = way(trees[g], i) + way(top, k)
            h = leaf(d, 1) if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0 else leaf(d)
            for left, right in proof:
                h = sha(left + h + right)
            out.append((d[0], leaf(d), trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in proof)), h, h == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("height", [1, 2, 10])
def test_manifest(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "BLOCK", 1 << height)
    rng = random.Random(height)
    sizes = {"en": 37, None: 5, "é": 1, "-": 2, "": 3, "zz": 8, "=": 1}
    docs, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            i += 1
            docs.append((i, rng.choice(["text é", "", None, "x" * 50]), lang, rng.choice(["a", None, ""]), rng.choice([None, 5])))
    docs += [docs[0], docs[0], (None, "no id", "en", "a", 1), (None, None, None, None, None), (3, "other", "en", None, 2)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, DOCS).withColumn("g", F.lit(1)).withColumn("leaf", F.lit("x")).repartition(3)
    got = rows(merkle.digest(df))
    assert got == plain_manifest(docs)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_manifest_edges(spark):
    assert rows(merkle.digest(spark.createDataFrame([], DOCS))) == []
    one = [(1, "a" * 300_000, "en", "s", 1)]
    assert rows(merkle.digest(spark.createDataFrame(one, DOCS))) == plain_manifest(one)
    same = [(1, "a", "en", "s", 1)] * 3000
    assert rows(merkle.digest(spark.createDataFrame(same, DOCS).repartition(5))) == plain_manifest(same)


# --- archives ---------------------------------------------------------------
PAGES = "page_id bigint, url string, html string"


def plain_records(pages):
    held = defaultdict(list)
    for page, _, html in pages:
        if page is not None and len((html or "").encode()) >= 100:
            held[html].append(page)
    seen, out = set(), []
    for page, _, html in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        data = (html or "").encode()
        row = (page, len(data), hashlib.sha256(data).hexdigest())
        if html in held and html in seen:
            out.append((*row, "revisit", min(held[html])))
        else:
            out.append((*row, "response", None))
            seen.add(html)
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(9)
    body = "<p>é</p>\r\n\r\n" * 40
    texts = [body, body + "WARC/1.1\r\nWARC-Type: response\r\n\r\n" + body, "x" * 4096, "y" * 4089 + "WARC/1.1", "0\r\n\r\n" * 900,
             "WARC/1.1", "", None, "short", "z" * 99, "z" * 100, "é" * 50, "é" * 49, "w" * 100_000 + "WARC/1.1" * 3000]
    out = [(i, f"http://a.example/{i}", rng.choice(texts)) for i in range(120)]
    out += [(3, "http://twice", body), (3, "http://twice", body), (None, None, body), (None, "x", "only without id " * 20), (None, "y", "only without id " * 20)]
    out += [(500, "http://a/b\r\nWARC/1.1", "q" * 100), (501, "http://a/WARC/1.1", "q" * 101), (502, "", "WARC/1.1\r\n" * 300)]
    return out


@pytest.mark.parametrize("segment", [37, 16_384])
def test_archives(spark, pages, monkeypatch, segment):
    monkeypatch.setattr(archives, "SEGMENT", segment if segment > 100 else 997)
    monkeypatch.setattr(archives, "CHUNK", segment if segment > 100 else 331)
    monkeypatch.setattr(archives, "FILE_RECORDS", 50)
    df = spark.createDataFrame(pages, PAGES).withColumn("row", F.lit(1)).withColumn("digest", F.lit("x")).repartition(3)
    got = rows(archives.digest(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    assert got == plain_records(pages)


def test_framing():
    for data in (b"", b"a", b"WARC/1.1\r\n" * 5, bytes(range(256)) * 40):
        framed = archives.chunked(data, 7)
        assert archives.unchunked(framed) == data and b"WARC/1.1" not in framed
    assert archives.unchunked(b"5\r\nab") is None
    assert archives.unchunked(b"nothing") is None
    assert archives.unchunked(b"2;name=x\r\nab\r\n0\r\n\r\n") == b"ab"


def test_broken_archives(spark, tmp_path):
    html = "<p>text</p>" * 5000
    source = spark.createDataFrame([(1, "http://a", html), (2, "http://b", "fine")], PAGES)
    archives.write_archives(source, str(tmp_path / "a"))
    data = b"".join(gzip.open(p).read() for p in (tmp_path / "a").glob("*.gz"))
    records = [b"WARC/1.1\r\n" + r for r in data.split(b"WARC/1.1\r\n")[1:]]

    def read(some, name):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc").write_bytes(b"".join(some))
        back = archives.reassembled(spark, str(tmp_path / name))
        return {r["page"]: (r["intact"], r["payload"] and bytes(r["payload"]).decode()) for r in back.collect()}

    assert read(reversed(records), "turned") == {1: (True, html), 2: (True, "fine")}
    parts = [i for i, r in enumerate(records) if b"WARC-Type: continuation" in r]
    assert len(parts) > 2
    lost = read([r for i, r in enumerate(records) if i != parts[1]], "lost")
    assert lost == {1: (False, None), 2: (True, "fine")}
    cut = read([r[:-9] + b"\r\n\r\n" if i == parts[0] else r for i, r in enumerate(records)], "cut")
    assert cut[1] == (False, None)
    changed = read([r.replace(b"fine", b"Fine") for r in records], "changed")
    assert changed[2] == (False, None)


def test_archives_empty(spark):
    assert rows(archives.digest(spark.createDataFrame([], PAGES))) == []


# --- helpers ----------------------------------------------------------------
def test_hot_join(spark, monkeypatch):
    monkeypatch.setattr(ranks, "HOT_KEYS", 4)
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(k, k) for k in range(2, 20)] + [(None, 0)], "k int, v int")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(1, 10)], "k int, w string")
    wanted = [(1, i, "r1") for i in range(50)] + [(k, k, f"r{k}") for k in range(2, 10)]
    assert rows(ranks.hot_join(left, right, "k")) == sorted(wanted, key=str)
    assert rows(ranks.hot_join(left, right, "k", "left")) == sorted(wanted + [(k, k, None) for k in range(10, 20)] + [(None, 0, None)], key=str)


@pytest.mark.parametrize("name", ["op11_trie", "op12_manifest", "op13_warc"])
def test_native_tables(spark, sf_dir, name):
    from rasterweave.llm import catalog

    assert differences(spark_rows(catalog.QUERIES[name](spark, sf_dir)), sql_rows(connect(sf_dir), catalog.SQL[name])) is None
