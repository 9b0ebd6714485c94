"""SentencePiece encoding by sampling from the piece lattice, and lossless decoding.

Each piece of the vocabulary that matches at a place of the text is an edge of a
lattice. Forward filtering sums the weight of all ways to each place; backward sampling
then draws edges from the end, so a segmentation comes up with probability in
proportion to the product of its pieces' weights, (1 + rank) ** -SHARPNESS. The draws
are hashes of the row's key, the place in the text and a seed: the same row always gets
the same pieces, on any machine.

Spaces are pieces' word marks, nothing is normalised and no prefix is added. Characters
that no single piece stands for become byte pieces, as do bytes where no piece can end, so decoding gives back every text
exactly; each text is decoded and compared, and would be encoded as bytes if it
differed. No piece spans the cut before a space or next to a byte that no piece has, so
lattices are built once for the different stretches between cuts, a batch at a time.

NULL texts give NULL, empty texts an empty list. Rows with equal keys and texts get equal
pieces; a NULL key counts as one key. Other columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.llm import words as W
from rasterweave.llm.columns import unused

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: How strongly frequent pieces are preferred; 0 draws any segmentation alike.
SHARPNESS = 2.0
#: Pieces that are broadcast at most.
MAX_PIECES = 1 << 20
_CHUNK = 1 << 17
#: Rows of texts that are encoded together.
_ROWS = 512
_BUCKETS = (4, 8, 12, 16, 24, 32, 48, 64)
_BITS = 18
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(model_file: str = MODEL) -> dict:
    """Bytes, ids and log-weights of a model's pieces, ready to broadcast."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    if model.get_piece_size() > MAX_PIECES:
        raise ValueError(f"the vocabulary has more than {MAX_PIECES} pieces")
    text: list[bytes] = []
    of_byte = np.full(256, -1)
    by_size: dict[int, list[tuple[bytes, int]]] = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            of_byte[int(piece[3:5], 16)] = i
            text.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            text.append(b"")
        else:
            raw = piece.replace("▁", " ").encode()
            text.append(raw)
            by_size.setdefault(len(raw), []).append((raw, i))
    if (of_byte < 0).any():
        raise ValueError("the model has no byte pieces, so decoding could not be lossless")
    tables, inner = {}, np.zeros(256, bool)
    for size, group in by_size.items():
        known = dict(group)
        data = np.frombuffer(b"".join(known), np.uint8).reshape(-1, size)
        inner[data.ravel()] = True
        h = (W._BYTE[data] * W.powers(W._STEP, size)).sum(1, dtype=np.uint64)
        order = np.argsort(h)
        ids = np.array(list(known.values()))[order]
        maybe = np.zeros(1 << _BITS, bool)
        maybe[((h * _SPREAD) >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        tables[size] = (maybe, h[order], ids.astype(np.int32), (-SHARPNESS * np.log1p(ids)).astype(np.float32))
    ends = np.concatenate(([0], np.cumsum([len(x) for x in text])))
    return {
        "tables": tables, "of_byte": of_byte.astype(np.int32), "inner": inner,
        "bytes": np.frombuffer(b"".join(text), np.uint8), "ends": ends,
    }


def lattices(data: np.ndarray, size: np.ndarray, v: dict) -> tuple[np.ndarray, np.ndarray]:
    """For rows of bytes, padded: (cumulative chances, ids) of the last edge to each place.

    Both are (rows, places + 1, lengths); entry l is the edge that is l + 1 bytes long.
    """
    n_rows, n = data.shape
    most = min(n, max(v["tables"]))
    score = np.full((n_rows, n + 1, most), -np.inf, np.float32)
    ids = np.full((n_rows, n + 1, most), -1, np.int32)
    total = np.zeros((n_rows, n + 1), np.uint64)
    np.cumsum(W._BYTE[data] * W.powers(W._STEP, n), axis=1, out=total[:, 1:])
    back = W.powers(W._BACK, n + 1)
    for length, (maybe, known, known_ids, weight) in v["tables"].items():
        if length > n:
            continue
        h = (total[:, length:] - total[:, :-length]) * back[: n - length + 1]
        row, at = np.nonzero(maybe[((h * _SPREAD) >> np.uint64(64 - _BITS)).astype(np.int64)])
        x = h[row, at]
        k = np.minimum(np.searchsorted(known, x), len(known) - 1)
        right = (known[k] == x) & (at + length <= size[row])
        row, at, k = row[right], at[right], k[right]
        score[row, at + length, length - 1] = weight[k]
        ids[row, at + length, length - 1] = known_ids[k]
    # Characters without a piece of their own: one edge for each byte.
    lead = 1 + (data >= 0xC0).astype(np.int64) + (data >= 0xE0) + (data >= 0xF0)
    lead[(data & 0xC0) == 0x80] = 0
    for c in range(1, 5):
        row, at = np.nonzero(lead == c)
        inside = at + c <= size[row]
        row, at = row[inside], at[inside]
        bare = ids[row, at + c, c - 1] < 0 if c <= most else np.ones(len(row), bool)
        for k in range(c):
            score[row[bare], at[bare] + k + 1, 0] = 0
            ids[row[bare], at[bare] + k + 1, 0] = v["of_byte"][data[row[bare], at[bare] + k]]
    # Bytes where no edge ends, such as a part of a character in a stretch of its own: an edge for each.
    row, at = np.nonzero((ids < 0).all(2)[:, 1:] & (np.arange(n) < size[:, None]))
    score[row, at + 1, 0] = 0
    ids[row, at + 1, 0] = v["of_byte"][data[row, at]]
    ahead = np.full((n_rows, n + 1), -np.inf, np.float32)
    ahead[:, 0] = 0
    with np.errstate(divide="ignore", invalid="ignore"):
        for j in range(1, n + 1):
            m = min(j, most)
            way = score[:, j, :m]
            way += ahead[:, j - m : j][:, ::-1]
            top = way.max(1, initial=-np.inf)
            chance = np.exp(way - np.where(np.isfinite(top), top, 0)[:, None])
            np.cumsum(chance, axis=1, out=way)
            ahead[:, j] = top + np.log(way[:, -1])
            if m < most:
                score[:, j, m:] = way[:, -1:]
    return score, ids


def sample(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, v: dict, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of pieces of each text) for some texts."""
    n = len(data)
    rows = len(offsets) - 1
    if not n:
        return np.zeros(0, np.int32), np.zeros(rows, np.int64)
    cut = np.zeros(n + 1, bool)
    space = data == 32
    cut[1:n] = space[1:] & ~space[:-1]
    alone = ~v["inner"][data]
    cut[:n] |= alone
    cut[1:] |= alone
    cut[offsets] = True
    edge = np.flatnonzero(cut)
    start, end = edge[:-1], edge[1:]
    size = end - start
    text = np.searchsorted(offsets, start, "right") - 1
    base = W.mix(keys.view(np.uint64)[text] + np.uint64(seed) * _SPREAD) + (start - offsets[text]).astype(np.uint64) * np.uint64(W._STEP)
    h = W.sums(W._BYTE[data], start, end)
    _, first, same = np.unique(h, return_index=True, return_inverse=True)
    count = np.zeros(len(start), np.int64)
    steps = []
    bounds = [0, *[b for b in _BUCKETS if b < size.max()], int(size.max())]
    for low, high in zip(bounds[:-1], bounds[1:]):
        kinds = np.flatnonzero((size[first] > low) & (size[first] <= high))
        limit = max(1, (1 << 20) // (high * min(high, max(v["tables"])) + 1))
        for a in range(0, len(kinds), limit):
            part = kinds[a : a + limit]
            own = np.full(len(first), -1)
            own[part] = np.arange(len(part))
            stretch = np.flatnonzero(own[same] >= 0) if len(part) < len(first) else np.arange(len(start))
            lengths = size[first[part]]
            at = np.minimum(start[first[part]][:, None] + np.arange(high), n - 1)
            block = np.where(np.arange(high) < lengths[:, None], data[at], 0).astype(np.uint8)
            chance, ids = lattices(block, lengths, v)
            row, place = own[same[stretch]], size[stretch].copy()
            while len(stretch):
                c = chance[row, place]
                u = (W.mix(base[stretch] + place.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)) >> np.uint64(11)) * 2.0**-53
                length = (c <= (u * c[:, -1])[:, None].astype(np.float32)).sum(1)
                # Rounding may reach the last sum itself: then the last edge with a chance counts.
                over = length >= c.shape[1]
                if over.any():
                    length[over] = (c[over] < c[over][:, -1:]).sum(1)
                steps.append((stretch, count[stretch], ids[row, place, length]))
                count[stretch] += 1
                place = place - length - 1
                left = place > 0
                stretch, row, place = stretch[left], row[left], place[left]
    after = np.cumsum(count)
    out = np.empty(int(after[-1]), np.int32)
    for stretch, k, ids in steps:
        out[after[stretch] - 1 - k] = ids
    return out, np.bincount(text, count, rows).astype(np.int64)


def spell(ids: np.ndarray, v: dict) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all pieces in order, length of each)."""
    size = v["ends"][ids + 1] - v["ends"][ids]
    first = np.cumsum(size) - size
    return v["bytes"][np.arange(size.sum()) + np.repeat(v["ends"][ids] - first, size)], size


def _encoded(text: pa.Array, keys: np.ndarray, v: dict, seed: int) -> tuple[pa.Array, pa.Array]:
    """(ids of each text, whether they spell it); both NULL for NULL."""
    counts, flat, same = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, bool)]
    for row, to, data, offsets in W.chunks(text, _CHUNK):
        ids, n = sample(data, offsets, keys[row:to], v, seed)
        right = np.ones(to - row, bool)
        whole = not (ids < 0).any()
        if whole:
            back, _ = spell(ids, v)
            whole = len(back) == len(data) and not (back != data).any()
        if not whole:
            parts, bounds = [], np.concatenate(([0], np.cumsum(n)))
            for r in range(to - row):
                own, raw = ids[bounds[r] : bounds[r + 1]], data[offsets[r] : offsets[r + 1]]
                if (own < 0).any() or spell(own, v)[0].tobytes() != raw.tobytes():
                    own = v["of_byte"][raw]
                right[r] = spell(own, v)[0].tobytes() == raw.tobytes()
                parts.append(own)
            ids, n = np.concatenate(parts), np.array([len(p) for p in parts])
        counts.append(n)
        flat.append(ids)
        same.append(right)
    n = np.concatenate(counts)
    ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
    missing = text.is_null().to_numpy(zero_copy_only=False)
    mask = pa.array(missing) if missing.any() else None
    return (
        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat)), mask=mask),
        pa.array(np.concatenate(same), pa.bool_(), mask=missing if missing.any() else None),
    )


def encode(
    docs: DataFrame, v: dict, key: Column, text: str = "text", out: str = "ids", seed: int = 0, checked: str | None = None
) -> DataFrame:
    """Add ``out``: ids of a sampled segmentation of each text. A column of that name is replaced.

    ``checked`` names one more column: whether the ids, decoded, gave the text back (NULL for NULL).
    """
    shared = docs.sparkSession.sparkContext.broadcast(v)

    @F.arrow_udf("struct<ids:array<int>,same:boolean>")
    def encoded(text: pa.Array, keys: pa.Array) -> pa.Array:
        done = [
            _encoded(text.slice(at, _ROWS), keys.slice(at, _ROWS).to_numpy(zero_copy_only=False), shared.value, seed)
            for at in range(0, max(1, len(text)), _ROWS)
        ]
        return pa.StructArray.from_arrays([pa.concat_arrays([d[i] for d in done]) for i in (0, 1)], ["ids", "same"])

    both = unused(docs, "_both")
    done = docs.withColumn(both, encoded.asNondeterministic()(F.col(text).cast("string"), F.xxhash64(key)))
    done = done.withColumn(out, F.col(f"{both}.ids"))
    return (done.withColumn(checked, F.col(f"{both}.same")) if checked else done).drop(both)


def decode(docs: DataFrame, v: dict, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the text that the ids spell. A column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast({k: v[k] for k in ("bytes", "ends")})

    @F.arrow_udf("string")
    def decoded(ids: pa.Array) -> pa.Array:
        v, out = shared.value, []
        for x in ids:
            out.append(spell(x.values.to_numpy().astype(np.int64), v)[0].tobytes().decode() if x.is_valid else None)
        return pa.array(out, pa.string())

    return docs.withColumn(out, decoded.asNondeterministic()(F.col(ids)))


def digest(docs: DataFrame, model_file: str = MODEL) -> DataFrame:
    """doc_id, ids, n_pieces and whether decoding gives the text back, of each document."""
    done = encode(docs.select("doc_id", "text"), vocabulary(model_file), F.col("doc_id"), checked="same")
    return done.select("doc_id", "ids", F.size("ids").alias("n_pieces"), F.coalesce("same", F.lit(True)).alias("lossless"))
