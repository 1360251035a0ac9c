"""From raw inputs to the hub table: one lazy plan per stage, all buildings at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from voltloom.config import DEFAULT_RULES, Rules
from voltloom.operators import assemble, blocks, features, runs
from voltloom.session import stage


def build_meters(readings: DataFrame, rules: Rules = DEFAULT_RULES, staged: bool = True) -> DataFrame:
    """Cleaned ten-minute table of every meter.

    The readings are scanned once: their block sums, about a tenth of the rows, are staged
    before the grid asks for each meter's first and last block. The ruled table is staged
    for the outlier limits, which read it again.
    """
    made = blocks.aggregate_blocks(blocks.invalidate(readings, rules))
    return clean_meters(blocks.complete_grid(stage(made, "block_sums") if staged else made), rules, staged)


def clean_meters(made: DataFrame, rules: Rules = DEFAULT_RULES, staged: bool = True) -> DataFrame:
    """The cleaned table from blocks on their grid, such as a staged one."""
    ruled = runs.clean_rules(made, rules=rules)
    if staged:
        ruled = stage(ruled, "ruled")
    return runs.flag_outliers(ruled, ["meter"], "power_w", runs.live_rows(), rules)


def build_table(cleaned: DataFrame, registry: DataFrame, occupancy: DataFrame,
                weather: DataFrame | None, calendar: DataFrame | None,
                rules: Rules = DEFAULT_RULES) -> DataFrame:
    """The building table: meters combined, joined to occupancy, weather and calendar."""
    combined = assemble.combine_meters(cleaned, registry)
    merged = assemble.join_occupancy(combined, occupancy)
    merged = assemble.join_weather(merged, weather, rules)
    return assemble.with_usable(features.add_all_features(merged, calendar, rules=rules))
