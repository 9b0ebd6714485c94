"""Lent masks against the reference's rule, drawn by hand: all valid samples of a tile lend, no others."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import __spark_entry__ as entry
import pytest

from rasterweave.sources.driver_tables import scene_frames

QUERIES = entry.queries()


def _h(purpose: str, *keys: int) -> str:
    return hashlib.md5("|".join(["0", purpose, *map(str, keys)]).encode()).hexdigest()


def _pick(rows: list, purpose: str, *keys: int):
    return rows[int(_h(purpose, *keys)[:13], 16) % len(rows)]


class Scenes:
    """The frames, and the rule of ``tiles2samples``: samples of at least 5 good frames."""

    def __init__(self, spark, sf_dir):
        self.frames = {(r.sample_id, r.t): r for r in scene_frames(spark, sf_dir).collect()}
        good = defaultdict(list)
        for r in QUERIES["frame_quality"](spark, sf_dir).where("valid_obs = 1").collect():
            good[r.sample_id].append(r.t)
        self.good = {s: sorted(ts) for s, ts in good.items() if len(ts) >= 5}
        self.masked = [(r.sample_id, r.t) for r in QUERIES["masked_frames"](spark, sf_dir).where("masked = 1").collect()]
        self.lenders = defaultdict(list)
        cloudy = [k for k, r in self.frames.items() if sum(r.cloud_mask) / len(r.cloud_mask) >= 0.1]
        self.refused = [k for k in cloudy if k[0] not in self.good]
        for s, t in cloudy:
            if s in self.good:
                self.lenders[self.frames[s, t].tile].append((s, t))

    def frame(self, s: int, t: int) -> tuple[int, int]:
        order = sorted(self.lenders[self.frames[s, t].tile], key=lambda k: _h("donor_order", *k))
        return _pick(order, "donor", s, t)


@pytest.fixture(scope="module")
def scenes(spark, sf_dir):
    made = Scenes(spark, sf_dir)
    assert made.refused, "no sample that the rule refuses has a mask to lend"
    return made


def test_donor_masks(spark, sf_dir, scenes):
    want = {(s, t, *scenes.frame(s, t)) for s, t in scenes.masked}
    assert {tuple(r) for r in QUERIES["donor_masks"](spark, sf_dir).collect()} == want


def test_donor_masks_two_stage(spark, sf_dir, scenes):
    def frame(s: int, t: int) -> tuple[int, int]:
        lenders = scenes.lenders[scenes.frames[s, t].tile]
        order = sorted({d for d, _ in lenders}, key=lambda d: _h("donor_sample_order", d))
        donor = _pick(order, "donor_sample", s, t)
        frames = sorted((k for k in lenders if k[0] == donor), key=lambda k: _h("donor_order", *k))
        return _pick(frames, "donor", s, t)

    want = {(s, t, *frame(s, t)) for s, t in scenes.masked}
    assert {tuple(r) for r in QUERIES["donor_masks_two_stage"](spark, sf_dir).collect()} == want


def _masks(scenes) -> dict[tuple[int, int], list[int]]:
    """Of every good frame of a valid sample: real clouds, and on masked frames the lent ones."""
    lent = {k: scenes.frames[scenes.frame(*k)].cloud_mask for k in scenes.masked}
    out = {}
    for s, ts in scenes.good.items():
        for t in ts:
            real = scenes.frames[s, t].cloud_mask
            out[s, t] = [max(a, b) for a, b in zip(lent.get((s, t), real), real)]
    return out


def _values(scenes, s: int, t: int, band: str) -> list[float]:
    return [v or 0.0 for v in scenes.frames[s, t][band]]


def test_simulate_gaps(spark, sf_dir, scenes):
    want = {}
    for (s, t), mask in _masks(scenes).items():
        hidden = [[1.0 if m else v for m, v in zip(mask, _values(scenes, s, t, f"b{b}"))] for b in range(4)]
        want.update({(s, t, i // 4, i % 4): (m, *[h[i] for h in hidden]) for i, m in enumerate(mask)})
    rows = QUERIES["simulate_gaps"](spark, sf_dir).collect()
    got = {(r.sample_id, r.t, r.y, r.x): (r.mask, r.b0_in, r.b1_in, r.b2_in, r.b3_in) for r in rows}
    assert len(rows) == len(want) and got.keys() == want.keys()
    assert [k for k in want if got[k] != pytest.approx(want[k], abs=1e-6)] == []


def test_union_masks(spark, sf_dir, scenes):
    want = {(s, t, i // 4, i % 4, m) for (s, t), mask in _masks(scenes).items() for i, m in enumerate(mask)}
    rows = QUERIES["union_masks"](spark, sf_dir).collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def _fills(seen: list[tuple[int, float]], day: int) -> tuple:
    """last, next, closest, linear of a pixel, from the frames that show it."""
    before = [x for x in seen if x[0] <= day][-1:]
    after = [x for x in seen if x[0] >= day][:1]
    last, ahead = before[0][1] if before else None, after[0][1] if after else None
    if not (before and after):
        one = ahead if last is None else last
        return last, ahead, one, one
    (d0, v0), (d1, v1) = before[0], after[0]
    linear = v0 if d0 == d1 else v0 + (v1 - v0) * ((day - d0) / (d1 - d0))
    return last, ahead, v0 if day - d0 <= d1 - day else v1, linear


def test_impute_raster(spark, sf_dir, scenes):
    masks, day = _masks(scenes), {k: r.acq_date.toordinal() for k, r in scenes.frames.items()}
    want = {}
    for s, ts in scenes.good.items():
        assert len({day[s, t] for t in ts}) == len(ts)
        values = {(t, b): _values(scenes, s, t, f"b{b}") for t in ts for b in range(4)}
        for i in range(16):
            seen = [t for t in ts if not masks[s, t][i]]
            for t in ts:
                each = [_fills([(day[s, u], values[u, b][i]) for u in seen], day[s, t]) for b in range(4)]
                want[s, t, i // 4, i % 4] = [v for four in each for v in four]
    rows = QUERIES["impute_raster"](spark, sf_dir).collect()
    names = [f"b{b}_{m}" for b in range(4) for m in ("last", "next", "closest", "linear")]
    got = {(r.sample_id, r.t, r.y, r.x): [r[n] for n in names] for r in rows}
    assert len(rows) == len(want) and got.keys() == want.keys()
    empty = lambda values: [-1.0 if v is None else v for v in values]
    assert [k for k in want if empty(got[k]) != pytest.approx(empty(want[k]), abs=1e-6)] == []


def test_total_loss(spark, sf_dir, scenes):
    masks = _masks(scenes)
    parts = {
        "l1_loss": lambda m, c: True,
        "l1_loss_occluded_input_pixels": lambda m, c: m == 1,
        "l1_loss_observed_input_pixels": lambda m, c: m == 0,
        "masked_l1_loss": lambda m, c: c == 0,
    }
    rows = {r.sample_id: r for r in QUERIES["total_loss"](spark, sf_dir).collect()}
    assert rows.keys() == scenes.good.keys()
    for s, ts in scenes.good.items():
        pixels = []
        for t in ts:
            mask, cloud = masks[s, t], scenes.frames[s, t].cloud_mask
            bands = [_values(scenes, s, t, f"b{b}") for b in range(4)]
            pixels += [(m, c, sum(1.0 - v[i] for v in bands) / 4 if m else 0.0) for i, (m, c) in enumerate(zip(mask, cloud))]
        for name, of in parts.items():
            errors = [e for m, c, e in pixels if of(m, c)]
            want = sum(errors) / len(errors) if errors else None
            assert rows[s][name] == (want if want is None else pytest.approx(want, abs=1e-6)), (s, name)
