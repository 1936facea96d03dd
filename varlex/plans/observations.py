"""Observations of the final matches of a search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varlex import fixed
from varlex.operators import observe as O
from varlex.operators.skew import HEAVY_SHARE


def observations_for_matches(
    records: DataFrame,
    who: DataFrame | None = None,
    dhs: DataFrame | None = None,
    wide: DataFrame | None = None,
    n: int = fixed.OBSERVATIONS_PER_MATCH,
    heavy_share: int = HEAVY_SHARE,
) -> DataFrame:
    """First n observations of every valid match, families stacked.

    ``records``: ``target_ordinal, variable_id, table_id, source_dataset``.  A
    match whose family is unknown or whose variable has no rows adds nothing.
    """
    targets = O.route_targets(O.valid_targets(records))
    options = {"heavy_share": heavy_share}
    frames = []
    if who is not None:
        frames.append(
            O.who_observations(targets.where(F.col("family") == "WHO"), who, n, **options)
        )
    if dhs is not None:
        frames.append(
            O.dhs_observations(targets.where(F.col("family") == "DHS"), dhs, n, **options)
        )
    if wide is not None:
        frames.append(
            O.wide_observations(targets.where(F.col("family") == "NHANES"), wide, n, **options)
        )
    if not frames:
        raise ValueError("give at least one observation table")
    return O.union_observations(frames)
