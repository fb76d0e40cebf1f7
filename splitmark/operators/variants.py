"""Existing variant calls annotated with control sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitmark import schema
from splitmark.session import written

RECORDS = "array<struct<part: int, offset: int, obs: bigint, sample_count: bigint>>"


def annotate(variants: DataFrame, controls: DataFrame, reach: int = 2, absolute_length: bool = False) -> DataFrame:
    """``vid`` with obs, obs_max, samples, samples_max: the control records at each offset around a variant's start, and its end where it
    has a length, in order, comma-joined (0 where there is none) and at most.

    ``variants``: vid, chr_idx, pos, svlen. Control records are laid out over the places that they are near, so a place asks once and not
    for each offset, and only what was found goes with a variant.
    """
    length = F.abs("svlen") if absolute_length else F.col("svlen")
    ends = F.filter(F.array(F.struct(F.lit(0).alias("part"), F.col("pos").alias("at")), F.struct(F.lit(1).alias("part"), (F.col("pos") + length).alias("at"))), lambda e: e["at"].isNotNull())
    asked = variants.select("vid", "chr_idx", F.explode(ends).alias("e")).select("vid", F.col("e.part").alias("part"), schema.xpos(F.col("chr_idx"), F.col("e.at")).alias("place"))
    offsets = list(range(-reach, reach + 1))
    laid = controls.select("id", F.col("obs").cast("bigint").alias("obs"), F.col("sample_count").cast("bigint").alias("sample_count"), F.explode(F.array(*[F.lit(o) for o in offsets])).alias("offset"))
    bands = written(laid.groupBy((F.col("id") - F.col("offset")).alias("place")).agg(F.collect_list(F.struct("offset", "obs", "sample_count")).alias("band")), "bands")
    rows = asked.join(bands, "place", "left").groupBy("vid").agg(F.collect_list(F.struct("part", "band")).alias("r"))
    record = lambda part, offset, obs, n: F.struct(part.alias("part"), offset.alias("offset"), F.coalesce(obs, F.lit(0)).alias("obs"), F.coalesce(n, F.lit(0)).alias("sample_count"))
    none = lambda part, offset: F.array(record(part, F.lit(offset), F.lit(0).cast("bigint"), F.lit(0).cast("bigint")))

    def around(x: Column) -> Column:
        """The records of one place, one of zeros at each offset that has none."""
        held = F.coalesce(F.transform(x["band"], lambda b: record(x["part"], b["offset"], b["obs"], b["sample_count"])), F.array().cast(RECORDS))
        lacking = [F.when(F.coalesce(F.array_contains(x["band"]["offset"], F.lit(o)), F.lit(False)), F.array().cast(RECORDS)).otherwise(none(x["part"], o)) for o in offsets]
        return F.concat(held, *lacking)

    listed = rows.select("vid", F.sort_array(F.flatten(F.transform("r", around))).alias("r"))
    text = lambda name: F.array_join(F.col(f"r.{name}").cast("array<string>"), ",")
    return listed.select("vid", text("obs").alias("obs"), F.array_max("r.obs").alias("obs_max"), text("sample_count").alias("samples"), F.array_max("r.sample_count").alias("samples_max"))
