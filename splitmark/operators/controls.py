"""Control tables: sites counted over many samples, merged, looked up and resumed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitmark import schema


@dataclass(frozen=True)
class ControlParams:
    min_obs: int = 3
    min_sample_obs: int = 3


def sites(observed: DataFrame) -> DataFrame:
    """Samples' observations merged by site: (id, chr, pos, sample_count, obs, max_obs, max_mapq)."""
    return observed.groupBy("chr", "chr_idx", "bp_pos").agg(F.sum("obs").alias("obs"), F.count("*").alias("sample_count"), F.max("obs").alias("max_obs"), F.max("max_mapq").alias("max_mapq")).select(
        schema.xpos(F.col("chr_idx"), F.col("bp_pos")).alias("id"), "chr", F.col("bp_pos").alias("pos"), "sample_count", "obs", "max_obs", "max_mapq"
    )


def control_sites(observed: DataFrame, params: ControlParams = ControlParams()) -> DataFrame:
    """Sites that are worth keeping as controls: (id, chr, pos, sample_count, obs)."""
    kept = sites(observed).where((F.col("obs") >= params.min_obs) & (F.col("max_obs") >= params.min_sample_obs) & (F.col("max_mapq") > 0))
    return kept.select("id", "chr", "pos", "sample_count", "obs")


def mapping_quality(observed: DataFrame) -> DataFrame:
    """(id, chr, pos, reads, min_mapq, max_mapq, mean_mapq, sd_mapq) of all reads at a site, over all samples of ``reads.site_counts``.

    Counts, sums and squares add up, so tables of several files give what one table of all reads gives. The deviation divides by one
    less than the reads; it is 0 for a single read.
    """
    n, s, q = F.sum("obs"), F.sum("mapq_sum"), F.sum("mapq_squares")
    sums = observed.groupBy("chr", "chr_idx", "bp_pos").agg(n.alias("n"), s.alias("s"), q.alias("q"), F.min("min_mapq").alias("min_mapq"), F.max("max_mapq").alias("max_mapq"))
    squares = F.col("q") - F.col("s").cast("double") * F.col("s") / F.col("n")
    spread = F.when(F.col("n") > 1, F.sqrt(F.greatest(squares, F.lit(0.0)) / (F.col("n") - 1))).otherwise(0.0)
    return sums.select(
        schema.xpos(F.col("chr_idx"), F.col("bp_pos")).alias("id"), "chr", F.col("bp_pos").alias("pos"), F.col("n").alias("reads"), "min_mapq", "max_mapq",
        F.round(F.col("s") / F.col("n"), 6).alias("mean_mapq"), F.round(spread, 6).alias("sd_mapq"),
    )


def combine(*tables: DataFrame) -> DataFrame:
    """Control tables merged by site; counts add up, of several references the largest in order of letters stays."""
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table, allowMissingColumns=True)
    known = [F.max("ref").alias("ref")] if "ref" in merged.columns else []
    return merged.groupBy("id", "chr", "pos").agg(F.sum("sample_count").alias("sample_count"), F.sum("obs").alias("obs"), *known)


def combine_observations(*tables: DataFrame) -> DataFrame:
    """All observations of the tables, one after another."""
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table, allowMissingColumns=True)
    return merged


def legacy_counts(reads: DataFrame) -> DataFrame:
    """(bp_id, obs, sample_count) from one row for each read end."""
    return reads.groupBy("bp_id").agg(F.count("*").alias("obs"), F.count_distinct("sample").alias("sample_count"))


def id_ranges(tables: DataFrame) -> DataFrame:
    """(db_id, low, high): the places that each table of a set covers."""
    return tables.groupBy("db_id").agg(F.min("id").alias("low"), F.max("id").alias("high"))


def frequency(sites: DataFrame, controls: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """``sites`` with ``frequency``: the samples that a site was seen in, over all control tables, 0 where none.

    ``excluded`` (id, n): what to take off, as from :func:`excluded_counts`.
    """
    summed = controls.groupBy("id").agg(F.sum("sample_count").alias("frequency"))
    found = sites.join(summed, "id", "left")
    if excluded is not None:
        found = found.join(excluded, "id", "left").withColumn("frequency", F.greatest(F.coalesce("frequency", F.lit(0)) - F.coalesce("n", F.lit(0)), F.lit(0))).drop("n")
    return found.withColumn("frequency", F.coalesce("frequency", F.lit(0)))


def excluded_counts(observed: DataFrame, samples: DataFrame) -> DataFrame:
    """(id, n): in how many of ``samples`` (one column) each site was observed."""
    named = observed.join(samples.distinct(), "sample", "left_semi")
    return named.groupBy(F.col("bp_id").alias("id")).agg(F.count_distinct("sample").alias("n"))


def records(sites: DataFrame, controls: DataFrame) -> DataFrame:
    """``sites`` with the summed control record; missing counts are 0."""
    summed = controls.groupBy("id").agg(F.sum("obs").alias("control_obs"), F.sum("sample_count").alias("control_samples"))
    return sites.join(summed, "id", "left").fillna(0, ["control_obs", "control_samples"])


def resume_points(controls: DataFrame) -> DataFrame:
    """(chr, pos): the highest place written for each contig."""
    return controls.groupBy("chr").agg(F.max("pos").alias("pos"))


def after_resume(regions: DataFrame, points: DataFrame) -> DataFrame:
    """Regions, or what is left of them, beyond the highest place that was written."""
    joined = regions.join(points.withColumnRenamed("pos", "done"), "chr", "left").where(F.col("done").isNull() | (F.col("stop") > F.col("done")))
    return joined.withColumn("start", F.greatest(F.col("start"), F.coalesce(F.col("done") + 1, F.col("start")))).drop("done")


def chunks(regions: DataFrame, size: int = 200_000, least: int = 500) -> DataFrame:
    """Regions cut into pieces of ``size``; pieces of ``least`` positions or fewer are left out."""
    cut = regions.withColumn("start", F.explode(F.sequence(F.col("start").cast("bigint"), F.col("stop").cast("bigint"), F.lit(size).cast("bigint"))))
    return cut.withColumn("stop", F.least(F.col("stop").cast("bigint"), F.col("start") + size - 1)).where(F.col("stop") - F.col("start") + 1 > least)
