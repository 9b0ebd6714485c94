"""Secret scans: fixed patterns, and a linear-chain conditional random field.

Patterns (kind: what matches): assign, a keyword with a value of 12 or more characters;
access, an access-key id of 18 or more; hex, 16 or more hex digits. They are found
leftmost and without overlap for each kind.

The field tags the words of a text (runs of anything but ASCII white space) as begin,
inside or outside of a secret. Features are the word's shape, the shapes of the words
next to it, the two words before it, and features of the file (its length, how many
digits and assignment signs it has). Its weights are learned by maximum likelihood on
at most FIT_ROWS windows of words around pattern findings, as many around other words
with digits and as many elsewhere, with the findings as labels, and as many around
findings whose value is broken into words of PIECE bytes: the first of a value is begin,
the others inside. A keyword and sign before a value are outside. Viterbi decoding is exact: a word whose margin for outside
exceeds whatever its transitions could gain splits the sequence, and the stretches
between are decoded step by step. Spans of the field that meet no pattern span are added
as kind ``crf``.

Positions are code points, end exclusive. NULL and empty texts have no spans. Nothing
is learned from an empty table, and then nothing is added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.llm import words as W
from rasterweave.llm.columns import unused
from rasterweave.sources.settle import settle

KINDS = ("assign", "access", "hex", "crf")
#: Windows of words of each class that are learned from.
FIT_ROWS = 1500
#: Documents whose windows are counted before, and how many times FIT_ROWS the tasks may give of a class.
COUNTED = 5_000
MARGIN = 8
WINDOW = 8
ROUNDS = 60
#: One of so many windows without findings is looked at.
EVERY = 61
#: Bytes of the words into which values are broken to learn from.
PIECE = 8
OUT, BEGIN, INSIDE = range(3)
MASK = "[secret]"
#: Windows of so many words, or fewer, are padded to one size; longer ones by powers of two.
PADDED = 32

_ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = W.classes("".join(chr(c) for c in range(128) if chr(c) not in "0123456789abcdef"))
_HEX[128:] = False

_WORDS = 1 << 12
#: Places of: size and digits, changes and marks, case; size and digits of the neighbours; words before; file.
_GROUPS = (32, 32, 32, 32, 32, _WORDS, _WORDS, 64)
_PLACES = np.cumsum((0, *_GROUPS))


def patterns(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, kind, first byte, end byte) of the pattern findings of some texts."""
    out = []
    hexes = W.Words(data, offsets, _HEX)
    long = np.flatnonzero(hexes.end - hexes.start >= 16)
    rows = np.searchsorted(offsets, hexes.start[long], "right") - 1
    out += [(r, 2, int(hexes.start[i] - offsets[r]), int(hexes.end[i] - offsets[r])) for r, i in zip(rows.tolist(), long.tolist())]
    signs = np.concatenate(([0], np.cumsum((data == 58) | (data == 61))))[offsets]
    keys = np.concatenate(([0], np.cumsum(data == 75)))[offsets]
    for r in np.flatnonzero((signs[1:] > signs[:-1]) | (keys[1:] > keys[:-1])).tolist():
        raw = data[offsets[r] : offsets[r + 1]].tobytes()
        if signs[r + 1] > signs[r]:
            out += [(r, 0, *m.span()) for m in _ASSIGN.finditer(raw) if len(m[2]) >= 12]
        if b"AKIA" in raw:
            out += [(r, 1, *m.span()) for m in _ACCESS.finditer(raw) if len(m[0]) >= 18]
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


def _count(mask: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=total[1:])
    return total


def features(data: np.ndarray, offsets: np.ndarray, found: W.Words) -> np.ndarray:
    """Places of the features of each word in the table of weights, one row per group."""
    s, e = found.start, found.end
    size = e - s
    digit = (data >= 48) & (data <= 57)
    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)
    kind = digit.astype(np.uint8) + 2 * upper + 3 * lower
    turns = _count(np.diff(kind, prepend=0) != 0)
    digits, uppers, lowers = map(_count, (digit, upper, lower))
    signs = _count((data == 58) | (data == 61))
    n = {name: c[e] - c[s] for name, c in (("d", digits), ("u", uppers), ("l", lowers), ("s", signs))}
    t = turns[e] - turns[np.minimum(s + 1, e)]
    other = size - n["d"] - n["u"] - n["l"]
    share = np.minimum(3, (4 * n["d"]) // np.maximum(size, 1) + (n["d"] > 0))
    length = np.minimum(7, np.searchsorted([4, 8, 12, 16, 20, 32, 48], size, "right"))
    shape = (length + 8 * share).astype(np.int64)
    marks = (np.minimum(3, other) + 4 * np.minimum(3, (8 * t) // np.maximum(size, 1)) + 16 * (n["s"] > 0)).astype(np.int64)
    case = ((n["u"] > 0) + 2 * (n["l"] > 0) + 4 * share + 16 * (n["u"] > 1)).astype(np.int64)
    text = found.rows()
    word = (W.sums(W._BYTE[W.LOWER[data]], s, e) >> np.uint64(64 - 12)).astype(np.int64)

    def shifted(x, by, none):
        out = np.full(len(x), none, np.int64)
        if by > 0:
            same = text[by:] == text[:-by]
            out[by:][same] = x[:-by][same]
        else:
            same = text[:by] == text[-by:]
            out[:by][same] = x[-by:][same]
        return out

    of = offsets
    bytes_ = np.maximum(np.diff(of), 1)
    rate = np.minimum(3, (50 * (digits[of[1:]] - digits[of[:-1]])) // bytes_)
    equal = np.minimum(3, (200 * (signs[of[1:]] - signs[of[:-1]])) // bytes_)
    file = np.minimum(3, np.log10(bytes_).astype(np.int64)) + 4 * rate + 16 * equal
    groups = (
        shape, marks, case, shifted(shape, 1, 0), shifted(shape, -1, 0), shifted(word, 1, 0), shifted(word, 2, 0), file[text],
    )
    return np.stack([g + p for g, p in zip(groups, _PLACES)])


def likelihood(emit: np.ndarray, move: np.ndarray, tags: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood by emissions (sequences, steps, tags) and transitions."""
    n, steps, k = emit.shape
    real = np.arange(steps) < size[:, None]
    ahead = np.empty_like(emit)
    ahead[:, 0] = emit[:, 0]
    for t in range(1, steps):
        x = np.logaddexp.reduce(ahead[:, t - 1, :, None] + move, axis=1) + emit[:, t]
        ahead[:, t] = np.where(real[:, t, None], x, ahead[:, t - 1])
    total = np.logaddexp.reduce(ahead[:, -1], axis=1)
    back = np.zeros_like(emit)
    pairs = np.zeros_like(move)
    for t in range(steps - 2, -1, -1):
        after = emit[:, t + 1] + back[:, t + 1]
        x = np.logaddexp.reduce(move + after[:, None, :], axis=2)
        back[:, t] = np.where(real[:, t + 1, None], x, 0)
        p = np.exp(ahead[:, t, :, None] + move + after[:, None, :] - total[:, None, None])
        pairs -= p[real[:, t + 1]].sum(0)
    by_emit = -np.exp(ahead + back - total[:, None, None]) * real[:, :, None]
    at = np.nonzero(real)
    by_emit[at[0], at[1], tags[at]] += 1
    a, b = tags[:, :-1][real[:, 1:]], tags[:, 1:][real[:, 1:]]
    np.add.at(pairs, (a, b), 1)
    return by_emit, pairs


def broken(data: np.ndarray, offsets: np.ndarray, found: W.Words, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, tags) of the windows around some words, with each of these broken into words of PIECE bytes."""
    text = found.rows()[at]
    a = np.maximum(at - WINDOW, found.first[text])
    b = np.minimum(at + WINDOW + 1, found.first[text + 1])
    parts, tags = [], []
    for i, x, y in zip(at.tolist(), a.tolist(), b.tolist()):
        s, e = int(found.start[i]), int(found.end[i])
        raw = data[s:e].tobytes()
        pieces = [raw[k : k + PIECE] for k in range(0, len(raw), PIECE)]
        parts.append(data[found.start[x] : s].tobytes() + b" ".join(pieces) + data[e : found.end[y - 1]].tobytes())
        tags.append(np.array([OUT] * (i - x) + [BEGIN] + [INSIDE] * (len(pieces) - 1) + [OUT] * (y - 1 - i), np.int8))
    own = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    every = np.frombuffer(b"".join(parts), np.uint8)
    words = W.Words(every, own, W.NON_SPACE)
    places = features(every, own, words)
    # The file is the one that the window is from.
    places[-1] = features(data, offsets, found)[-1][at][words.rows()]
    return [(places[:, i:j], t) for i, j, t in zip(words.first[:-1].tolist(), words.first[1:].tolist(), tags)]


def thresholds(texts: DataFrame) -> list[int]:
    """For each class of windows, the hash below which about MARGIN times FIT_ROWS of all windows lie.

    From a sample of about COUNTED documents, chosen by the hash of the text. What all tasks
    together give is then bounded, however many there are; a class that the sample lacks is not bounded.
    """
    total = texts.agg(F.count("text")).first()[0]
    drawn = min(1.0, COUNTED / max(1, total))
    some = texts.filter(F.shiftrightunsigned(F.xxhash64("text"), 2) < F.lit(max(1, int((1 << 62) * drawn)))) if drawn < 1 else texts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(4, np.int64)
        for batch in batches:
            for _, _, data, offsets in W.chunks(batch.column(0)):
                found = W.Words(data, offsets, W.NON_SPACE)
                if not len(found):
                    continue
                ends = {np.searchsorted(found.start, offsets[r] + end, "left") - 1 for r, _, _, end in patterns(data, offsets)}
                at = np.array(sorted(ends), np.int64)
                digits = _count((data >= 48) & (data <= 57))
                numbers = int((digits[found.end] > digits[found.start]).sum())
                n += (len(found) // EVERY, len(at), max(0, numbers - len(at)), int(((found.end - found.start)[at] > PIECE).sum()))
        yield pa.RecordBatch.from_arrays([pa.array(range(4), pa.int32()), pa.array(n)], ["label", "n"])

    counts = dict.fromkeys(range(4), 0)
    counts.update({r["label"]: r["n"] for r in some.mapInArrow(count, "label int, n bigint").groupBy("label").agg(F.sum("n").alias("n")).collect()})
    whole = (1 << 64) - 1
    share = [min(1.0, MARGIN * FIT_ROWS * drawn / counts[c]) if counts[c] else 1.0 for c in range(4)]
    return [min(whole, int((whole // EVERY if c == 0 else whole) * share[c])) for c in range(4)]


def fit(docs: DataFrame, text: str = "text") -> dict:
    """Weights of features and transitions, learned from pattern findings."""

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of smallest hash of each class in a partition, equal ones once (smallest features)."""
        kept: list[dict] = [{}, {}, {}, {}]
        limit = [np.uint64(0xFFFFFFFFFFFFFFFF)] * 4
        # Of the windows elsewhere only some are looked at, by their own hash.
        limit[0] //= np.uint64(EVERY)
        limit = [min(x, np.uint64(y)) for x, y in zip(limit, below)]
        for batch in batches:
            for _, _, data, offsets in W.chunks(batch.column(0)):
                found = W.Words(data, offsets, W.NON_SPACE)
                if not len(found):
                    continue
                tags = np.zeros(len(found), np.int8)
                for r, _, _, end in patterns(data, offsets):
                    # The last word of a finding is where the secret stands.
                    tags[np.searchsorted(found.start, offsets[r] + end, "left") - 1] = BEGIN
                digits = _count((data >= 48) & (data <= 57))
                marked, hashes, text = _count(tags > 0), found.hashes(), found.rows()
                some = (
                    np.arange(len(found)), np.flatnonzero(tags),
                    np.flatnonzero((digits[found.end] > digits[found.start]) & (tags == OUT)),
                )
                places = None
                for label, at in enumerate(some):
                    a = np.maximum(at - WINDOW, found.first[text[at]])
                    b = np.minimum(at + WINDOW + 1, found.first[text[at] + 1])
                    rank = W.sums(hashes, a, b)
                    use = rank <= limit[label]
                    if label != 1:
                        use &= marked[a] == marked[b]
                    if use.any() and places is None:
                        places = features(data, offsets, found)
                    for i in np.flatnonzero(use).tolist():
                        new = (places[:, a[i] : b[i]].T.ravel().tolist(), tags[a[i] : b[i]].tolist())
                        kept[label][int(rank[i])] = min(new, kept[label].get(int(rank[i]), new))
                    if label == 1:
                        use = rank <= limit[3]
                        use &= (found.end - found.start)[at] > PIECE
                        # No other finding in the window, for that would have to be broken as well.
                        use &= marked[b] - marked[a] == 1
                        if use.any():
                            for r, (p, t) in zip(rank[use].tolist(), broken(data, offsets, found, at[use])):
                                new = (p.T.ravel().tolist(), t.tolist())
                                kept[3][r] = min(new, kept[3].get(r, new))
                for label in range(4):
                    if len(kept[label]) > 2 * FIT_ROWS:
                        kept[label] = dict(sorted(kept[label].items(), key=lambda x: x[0])[:FIT_ROWS])
                        limit[label] = np.uint64(max(kept[label]))
        out = [(label, r >> 1, *row) for label in range(4) for r, row in kept[label].items()]
        columns = list(zip(*out)) or [[]] * 4
        types = [pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["label", "rank", "places", "tags"])

    texts = docs.select(F.col(text).cast("string").alias("text"))
    below = thresholds(texts)
    every = settle(texts.mapInArrow(examples, "label int, rank bigint, places array<int>, tags array<int>"))
    # The windows with the smallest rank of each class, equal ones once, as Arrow columns: rows of Python
    # numbers would take the driver many times their size.
    parts = [
        every.filter(F.col("label") == label).groupBy("rank")
        .agg(F.min(F.struct("places", "tags")).alias("w")).select("rank", "w.*").orderBy("rank").limit(FIT_ROWS)
        .select("places", "tags").toArrow()
        for label in range(4)
    ]
    chosen = pa.concat_tables(parts).combine_chunks()
    places, tags = (chosen[c].combine_chunks() for c in ("places", "tags"))
    return learn(
        places.flatten().to_numpy().reshape(-1, len(_GROUPS)).astype(np.int16), tags.flatten().to_numpy().astype(np.int8),
        tags.value_lengths().to_numpy().astype(np.int64),
    )


def learn(places: np.ndarray, tags: np.ndarray, size: np.ndarray) -> dict:
    """Maximum likelihood with a small penalty, by adaptive gradient steps.

    Takes a row of places and a tag for each word, and the number of words of each window. Only windows of
    like sizes are padded to one size, so memory follows the words, however long one window is.
    """
    weights, move = np.zeros((_PLACES[-1], 3)), np.zeros((3, 3))
    if not tags.any():
        return {"weights": np.zeros((_PLACES[-1], 3), np.float32), "move": move.astype(np.float32), "learned": False}
    seen = np.zeros(_PLACES[-1], bool)
    for g in range(len(_GROUPS)):
        seen[places[:, g]] = True
    used = np.flatnonzero(seen)
    at = (np.cumsum(seen) - 1).astype(np.int16)[np.ascontiguousarray(places.T)]
    # (words, places of these in a padded table, tags there, sizes) of the windows of like sizes.
    first, padded = np.cumsum(size) - size, []
    like = np.ceil(np.log2(np.maximum(size, PADDED) / PADDED))
    for k in np.unique(like):
        some = size[like == k]
        real = np.arange(some.max()) < some[:, None]
        words = (first[like == k][:, None] + np.arange(some.max()))[real]
        own = np.zeros(real.shape, np.int8)
        own[real] = tags[words]
        padded.append((words, real, own, some))
    w, seen_w, seen_m = weights[used], np.zeros((len(used), 3)), np.zeros((3, 3))
    by_word = np.empty((len(tags), 3))
    for _ in range(ROUNDS):
        of_word = w[at[0]]
        for group in at[1:]:
            of_word += w[group]
        by_move = np.zeros((3, 3))
        for words, real, own, some in padded:
            emit = np.zeros((*real.shape, 3))
            emit[real] = of_word[words]
            by_emit, by_pair = likelihood(emit, move, own, some)
            by_word[words] = by_emit[real]
            by_move += by_pair
        by_w = np.stack([
            sum(np.bincount(group, by_word[:, k], len(used)) for group in at) for k in range(3)
        ], 1) - 1e-2 * w
        by_move = by_move - 1e-2 * move
        seen_w += by_w**2
        seen_m += by_move**2
        w += 0.5 * by_w / np.sqrt(seen_w + 1e-8)
        move += 0.5 * by_move / np.sqrt(seen_m + 1e-8)
    weights[used] = w
    return {"weights": weights.astype(np.float32), "move": move.astype(np.float32), "learned": True}


def decode(emit: np.ndarray, move: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best tags of all words; ``first`` has the bounds of the texts. Ties go to the lower tag."""
    n = len(emit)
    tags = np.zeros(n, np.int8)
    edge = np.zeros((1, 3), np.float32)
    into = (np.vstack((move, edge)) - np.vstack((move, edge))[:, :1]).max(0)
    out = (np.vstack((move.T, edge)) - np.vstack((move.T, edge))[:, :1]).max(0)
    sure = ((emit[:, :1] - emit[:, 1:]) > (into + out)[1:] + 1e-4).all(1)
    a, b = W.ranges(~sure, first)
    if not len(a):
        return tags
    size = b - a
    order = np.argsort(-size, kind="stable")
    a, b, size = a[order], b[order], size[order]
    begins, ends = np.isin(a, first), np.isin(b, first)
    back = np.zeros((int(size.sum()), 3), np.int8)
    level = emit[a] + np.where(begins[:, None], 0, move[OUT])
    starts, active = [], len(a)
    used = 0
    final = np.empty_like(level)
    for t in range(1, int(size[0]) + 1):
        still = int(np.searchsorted(-size, -t, "left")) if t < size[0] else 0
        final[still:active] = level[still:active]
        active = still
        if not active:
            break
        ways = level[:active, :, None] + move
        starts.append(used)
        back[used : used + active] = ways.argmax(1)
        used += active
        level = ways.max(1) + emit[a[:active] + t]
    final += np.where(ends[:, None], 0, move[:, OUT])
    tag = final.argmax(1)
    tags[b - 1] = tag
    for t in range(len(starts), 0, -1):
        active = int((size > t).sum())
        tag[:active] = back[starts[t - 1] + np.arange(active), tag[:active]]
        tags[a[:active] + t - 1] = tag[:active]
    return tags


def _spans(data: np.ndarray, offsets: np.ndarray, model: dict) -> list[list[tuple[int, int, int]]]:
    """(kind, first, end) in code points for each text, by start and kind."""
    out: list[list] = [[] for _ in range(len(offsets) - 1)]
    for r, kind, a, b in patterns(data, offsets):
        out[r].append((kind, a, b))
    found = W.Words(data, offsets, W.NON_SPACE)
    if model["learned"] and len(found):
        places = features(data, offsets, found)
        emit = sum(model["weights"][p] for p in places)
        tags = decode(emit, model["move"], found.first)
        opens = np.flatnonzero(tags != OUT)
        text = np.searchsorted(found.first, opens, "right") - 1
        i = 0
        while i < len(opens):
            j = i
            while j + 1 < len(opens) and opens[j + 1] == opens[j] + 1 and text[j + 1] == text[i] and tags[opens[j + 1]] == INSIDE:
                j += 1
            r = int(text[i])
            a, b = int(found.start[opens[i]] - offsets[r]), int(found.end[opens[j]] - offsets[r])
            if not any(k < 3 and a < y and x < b for k, x, y in out[r]):
                out[r].append((3, a, b))
            i = j + 1
    for r, spans in enumerate(out):
        if spans:
            raw = data[offsets[r] : offsets[r + 1]]
            point = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
            out[r] = sorted(((k, int(point[a]), int(point[b])) for k, a, b in spans), key=lambda x: (x[1], x[0]))
    return out


def scan(docs: DataFrame, model: dict, text: str = "text", out: str = "secrets") -> DataFrame:
    """Add ``out``: array of (kind, start, end), by start and kind. A column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<struct<kind:string,start:int,end:int>>")
    def scanned(text: pa.Array) -> pa.Array:
        counts, flat = [], []
        for _, _, data, offsets in W.chunks(text):
            for spans in _spans(data, offsets, shared.value):
                counts.append(len(spans))
                flat += spans
        k, a, b = zip(*flat) if flat else ((), (), ())
        values = pa.StructArray.from_arrays(
            [pa.array([KINDS[x] for x in k], pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["kind", "start", "end"]
        )
        return W.list_array(np.array(counts, np.int64), values)

    return docs.withColumn(out, scanned.asNondeterministic()(F.col(text).cast("string")))


def redact(docs: DataFrame, model: dict, text: str = "text", mask: str = MASK) -> DataFrame:
    """Replace each stretch of secret spans by ``mask``; other columns stay as they are."""

    @F.arrow_udf("string")
    def masked(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for x, found in zip(text.to_pylist(), spans.to_pylist()):
            if found:
                parts, at = [], 0
                for s in found:
                    if s["start"] >= at:
                        parts += [x[at : s["start"]], mask]
                    at = max(at, s["end"])
                x = "".join([*parts, x[at:]])
            out.append(x)
        return pa.array(out, pa.string())

    name = unused(docs, "_secrets")
    found = scan(docs, model, text, name)
    return found.withColumn(text, masked.asNondeterministic()(F.col(text).cast("string"), F.col(name))).drop(name)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each document."""
    docs = docs.select("doc_id", "text")
    found = scan(docs, fit(docs))

    def listed(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    base = F.filter("secrets", lambda s: s["kind"] != "crf")

    def number(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, KINDS[:3]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
