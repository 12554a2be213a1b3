"""Owner names and how many of them the territory map covers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, person_key
from ..model import union_all
from ..sources.atlas import dimension, owner_regions_by_key


def distinct_owners(frames: Sequence[DataFrame], owner: str = "owner") -> DataFrame:
    """Every owner name in any of the tables, sorted."""
    # Names are made distinct per table first, so only those cross the union.
    names = [
        f.select(clean_text(F.col(owner)).alias("owner")).where(F.col("owner").isNotNull()).distinct()
        for f in frames
    ]
    return union_all(names).distinct().orderBy("owner")


def routing_coverage(owners: DataFrame, owner_regions: Mapping[str, str]) -> DataFrame:
    """One row: owners found, owners with a region, and whether routing can say anything.

    Zero routing findings only mean "clean" when `routing_active` is true.
    """
    regions = dimension(owners.sparkSession, owner_regions_by_key(owner_regions), "_key", "region")
    return (
        owners.withColumn("_key", person_key(F.col("owner")))
        .join(regions, "_key", "left")
        .agg(
            F.count(F.lit(1)).alias("owners_found"),
            F.count("region").alias("owners_assigned"),
        )
        .withColumn("owners_unassigned", F.col("owners_found") - F.col("owners_assigned"))
        .withColumn("routing_active", F.col("owners_assigned") > 0)
    )
