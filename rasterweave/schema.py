"""Table schemas and checked option sets.

Two physical layouts are used throughout:

* ``frames`` - one row per (sample, t); each band is one row-major array.
  Everything that looks at one frame at a time runs here without a shuffle.
* ``pixels`` - one row per (sample, t, y, x); each band is one column.
  Operators that look along time run here, keyed by (sample, y, x).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
SPLITS = ("train", "iid", "ood", "extreme", "seasonal")
SPLIT_LENGTHS = {"train": 30, "iid": 30, "ood": 30, "extreme": 60, "seasonal": 210}
SENSOR_SPLITS = ("train", "val", "test")
MODES = ("train", "val", "all")
FILTER_TYPES = (None, "cloud-free", "cloud-free_consecutive")
CROP_TYPES = ("random", "center")
POSITION_STRATEGIES = ("day-of-year", "day-within-sequence", "absolute", "enumeration")
MASK_TYPES = ("random_clouds", "real_clouds")
FILL_TYPES = ("fill_value", "white_noise", "mean")
IMPUTE_MODES = ("last", "next", "closest", "linear")
# Band order on disk: B2 (blue), B3 (green), B4 (red), B8 (near infrared).
FOUR_BAND_CHANNELS = {
    "rgb": (2, 1, 0),
    "bgr": (0, 1, 2),
    "bgr-nir": (0, 1, 2, 3),
    "bgr-mask": (0, 1, 2),
    "bgr-nir-mask": (0, 1, 2, 3),
}
# Thirteen-band optical sensor: B2, B3, B4 at 1, 2, 3 and B8 at 7.
THIRTEEN_BAND_CHANNELS = {
    "bgr": (1, 2, 3),
    "bgr-nir": (1, 2, 3, 7),
    "all": tuple(range(13)),
    "bgr-mask": (1, 2, 3),
    "bgr-nir-mask": (1, 2, 3, 7),
    "all-mask": tuple(range(13)),
}
# ----------------------------------------------------------------------------


def frames_schema(n_bands: int) -> T.StructType:
    """Schema of the stored frame table with ``n_bands`` band columns."""
    head = [
        T.StructField("split", T.StringType()),
        T.StructField("tile", T.StringType()),
        T.StructField("sample_id", T.StringType()),
        T.StructField("sensor", T.StringType()),
        T.StructField("t", T.IntegerType()),
        T.StructField("acq_date", T.DateType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
    ]
    bands = [T.StructField(f"b{i}", T.ArrayType(T.FloatType())) for i in range(n_bands)]
    tail = [
        T.StructField("cloud_prob", T.ArrayType(T.FloatType())),
        T.StructField("class_id", T.ArrayType(T.ByteType())),
        T.StructField("cloud_mask", T.ArrayType(T.ByteType())),
    ]
    return T.StructType(head + bands + tail)


def band_columns(columns: list[str]) -> list[str]:
    """The band columns ``b0, b1, ...`` among ``columns``, in band order."""
    found = [c for c in columns if c[:1] == "b" and c[1:].isdigit()]
    return sorted(found, key=lambda c: int(c[1:]))


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class FilterSettings:
    """Which sequences and frames to keep."""

    type: str | None = None
    min_length: int = 0
    max_num_consec_invalid: int | None = None
    max_t_sampling: int | None = None
    return_valid_obs_only: bool = True

    def __post_init__(self) -> None:
        _require(self.type in FILTER_TYPES, f"filter type must be one of {FILTER_TYPES}")
        for name in ("min_length", "max_num_consec_invalid", "max_t_sampling"):
            value = getattr(self, name)
            _require(value is None or isinstance(value, int), f"{name} must be an int")


@dataclass(frozen=True)
class CropSettings:
    """Spatial crop shared by all frames of a sample."""

    type: str = "random"
    shape: tuple[int, int] = (64, 64)
    enabled: bool = True

    def __post_init__(self) -> None:
        _require(self.type in CROP_TYPES, f"crop type must be one of {CROP_TYPES}")
        _require(
            len(self.shape) == 2 and all(isinstance(n, int) and n > 0 for n in self.shape),
            "crop shape must be two positive ints",
        )


@dataclass(frozen=True)
class MaskSettings:
    """How artificial gaps are drawn and filled."""

    mask_type: str = "random_clouds"
    ratio_masked_frames: float = 0.5
    ratio_fully_masked_frames: float = 0.0
    non_masked_frames: tuple[int, ...] = ()
    fixed_masking_ratio: bool = False
    union_real_masks: bool = False
    dilate: int = 0
    fill_type: str = "fill_value"
    fill_value: float = 1.0
    apply_full: bool = False
    min_donor_coverage: float = 0.1
    donor_draw: str = "frame"
    occlude_above: float | None = None
    seed: int = 0

    def __post_init__(self) -> None:
        _require(self.mask_type in MASK_TYPES, f"mask_type must be one of {MASK_TYPES}")
        _require(self.fill_type in FILL_TYPES, f"fill_type must be one of {FILL_TYPES}")
        _require(self.donor_draw in ("frame", "sample"), "donor_draw must be 'frame' or 'sample'")
        _require(
            self.ratio_fully_masked_frames <= self.ratio_masked_frames,
            "ratio_fully_masked_frames must not exceed ratio_masked_frames",
        )

    @property
    def run_key(self) -> str:
        """Name under which masks of these settings are stored."""
        key = f"ratio_masked_{self.ratio_masked_frames}"
        if self.ratio_fully_masked_frames > 0:
            key += f"_fully_masked_{self.ratio_fully_masked_frames}"
        return f"{key}/masks_{self.mask_type}"


@dataclass(frozen=True)
class ReadOptions:
    """Options of one data set read, checked on construction."""

    split: str = "train"
    mode: str | None = "train"
    sensor: str = "four-band"
    channels: str = "bgr-nir"
    include_radar: bool = False
    position_strategy: str = "day-of-year"
    max_seq_length: int | None = None
    render_occluded_above: float | None = None
    filter: FilterSettings = field(default_factory=FilterSettings)
    crop: CropSettings | None = None
    mask: MaskSettings | None = None
    augment: bool = False
    #: Leave out samples with a frame whose scaled bands are all 0.
    drop_black: bool = False
    #: Arrays returned beside the sample: cloud_prob, class_id.
    extra: tuple[str, ...] = ()
    #: Folder of a stored simulation, whose run by ``mask`` is read instead of simulating.
    stored_run: str | None = None

    def __post_init__(self) -> None:
        _require(set(self.extra) <= {"cloud_prob", "class_id"}, "extra may hold cloud_prob and class_id")
        _require(self.stored_run is None or self.mask is not None, "a stored run is told by mask settings")
        _require(self.sensor in ("four-band", "thirteen-band"), f"unknown sensor {self.sensor!r}")
        splits = SPLITS if self.sensor == "four-band" else SENSOR_SPLITS
        _require(self.split in splits, f"split must be one of {splits}")
        if self.sensor == "four-band" and self.split == "train":
            _require(self.mode in MODES, f"mode must be one of {MODES}")
        _require(self.channels in self.channel_table, f"unknown channels {self.channels!r}")
        _require(
            self.position_strategy in POSITION_STRATEGIES,
            f"position_strategy must be one of {POSITION_STRATEGIES}",
        )
        if self.channels.endswith("-mask"):
            _require(self.mask is not None, "a '-mask' channel set needs mask settings")
        p = self.render_occluded_above
        _require(p is None or isinstance(p, float), "render_occluded_above must be a float")

    @property
    def channel_table(self) -> dict[str, tuple[int, ...]]:
        return FOUR_BAND_CHANNELS if self.sensor == "four-band" else THIRTEEN_BAND_CHANNELS

    @property
    def band_positions(self) -> tuple[int, ...]:
        return self.channel_table[self.channels]

    @property
    def num_channels(self) -> int:
        return len(self.band_positions) + int(self.channels.endswith("-mask"))
