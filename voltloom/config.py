"""Thresholds and registries shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass, field

BLOCK_SECONDS = 600
BLOCKS_PER_HOUR = 6
BLOCKS_PER_DAY = 144
READINGS_PER_BLOCK = 10
BLOCK_HOURS = 10 / 60

# They must be equal for equal results.
SEMESTER, VACATION = "semester", "vacation"
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
# ((start month, start day), (end month, end day)), both ends inclusive
VACATION_WINDOWS = (((5, 16), (7, 31)), ((12, 16), (12, 31)), ((1, 1), (1, 1)))
ZERO_RUN_BUCKETS = (
    (6, "< 6 h"), (18, "6-18 h"), (24, "18-24 h"), (48, "1-2 days"),
    (168, "2-7 days"), (8760, "over a week"),
)
TEMPERATURE_BANDS = ((0, 15), (15, 20), (20, 25), (25, 30), (30, 35), (35, 40), (40, 50))
IDLE_DEVICES = {
    "Academic": 50, "Boys_Hostel": 20, "Girls_Hostel": 20, "Mess": 20,
    "Library": 20, "Lecture": 20, "Facilities": 20,
}
IDLE_DEVICES_DEFAULT = 20
# meter, building, role, kind, occupancy code
METER_REGISTRY = (
    ("acad_mains", "Academic", "mains", "commercial", "ACB"),
    ("boys_mains", "Boys_Hostel", "mains", "residential", "BH"),
    ("boys_ups", "Boys_Hostel", "ups", "residential", "BH"),
    ("girls_mains", "Girls_Hostel", "mains", "residential", "GH"),
    ("girls_ups", "Girls_Hostel", "ups", "residential", "GH"),
    ("library_mains", "Library", "mains", "commercial", "LB"),
    ("mess_mains", "Mess", "mains", "commercial", "DB"),
    ("lecture_mains", "Lecture", "mains", "commercial", "LCB"),
    ("facilities_mains", "Facilities", "mains", "commercial", "SRB"),
)
WIDE_COLUMNS = {
    "Academic": "acad_mains", "Boys_main": "boys_mains", "Boys_backup": "boys_ups",
    "Girls_main": "girls_mains", "Girls_backup": "girls_ups", "Library": "library_mains",
    "Mess": "mess_mains", "Lecture": "lecture_mains", "Facilities": "facilities_mains",
}


# Names of day types, and where a day counts as flat, as peaking in the morning, in the evening.
LEVEL_NAMES = {"bottom": "lowest", "second": "low", "third": "high", "top": "highest"}
SHAPE_NAMES = {"flat": "flat all day", "morning": "morning peak", "evening": "evening peak", "daytime": "daytime peak"}
FLAT_SWING, MORNING_BEFORE, EVENING_FROM = 0.15, 12, 18


@dataclass(frozen=True)
class Rules:
    """Every numeric rule of the pipeline; the defaults are the published ones."""

    timezone: str = "Asia/Kolkata"
    power_max_w: float = 200_000.0
    voltage_min: float = 180.0
    voltage_max: float = 270.0
    dead_meter_hours: float = 6.0
    fill_limit: int = 3            # blocks
    weather_fill_limit: int = 12   # rows
    outlier_z: float = 3.0
    outlier_iqr_k: float = 1.5
    outlier_min_rows: int = 10     # strictly more live rows than this
    low_fraction: float = 0.05
    low_percentile: float = 0.95
    sweep: tuple = field(default_factory=lambda: tuple(f / 100 for f in range(21)))
    cdh_base: float = 24.0
    cdh_scan: tuple = tuple(range(16, 31))
    train_share: float = 0.70
    val_share: float = 0.15
    cv_folds: int = 5
    z_warning: float = 2.0
    z_anomaly: float = 3.0
    episode_gap: int = 3           # row positions
    segment_days: int = 28         # width of the time slices a long series is cut into

    @property
    def dead_blocks(self) -> int:
        return int(round(self.dead_meter_hours * BLOCKS_PER_HOUR))


DEFAULT_RULES = Rules()
