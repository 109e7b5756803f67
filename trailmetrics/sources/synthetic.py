"""Repeatable synthetic failures, derived row by row from an id column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmetrics import fixed_values as fixed
from trailmetrics.functions.windows import instant


def synthetic_failures(
    ids: DataFrame,
    seed: int = fixed.SYNTHETIC_SEED,
    anchor: str = fixed.SYNTHETIC_ANCHOR,
    days: int = fixed.SYNTHETIC_DAYS,
    sites: Sequence[str] = fixed.SYNTHETIC_SITES,
    failure_types: Sequence[str] = fixed.SYNTHETIC_FAILURE_TYPES,
) -> DataFrame:
    """One failure per row of ``ids`` (a column ``id``, as of ``spark.range``).

    Every value is a slice of one digest of seed and id, so a row never depends on how the
    ids are partitioned; ``rand(seed)`` would.
    """
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("id")))

    def draw(part: int, size: int) -> Column:
        word = F.substring(F.col("digest"), 1 + 8 * part, 8)
        return F.conv(word, 16, 10).cast("bigint") % size

    def pick(part: int, values: Sequence[str]) -> Column:
        return F.element_at(
            F.array(*map(F.lit, values)), (draw(part, len(values)) + 1).cast("int")
        )

    suffixes = fixed.SYNTHETIC_SUFFIX_MAX - fixed.SYNTHETIC_SUFFIX_MIN + 1
    seconds_back = draw(1, days * 86400 + 1)
    return ids.select("id", digest.alias("digest")).select(
        pick(0, sites).alias("site"),
        F.timestamp_seconds(F.unix_seconds(instant(anchor)) - seconds_back).alias("timestamp"),
        pick(2, failure_types).alias("failure_type"),
        F.format_string(
            "doc_%06d_%d", F.col("id"), draw(3, suffixes) + fixed.SYNTHETIC_SUFFIX_MIN
        ).alias("document_id"),
    )
