"""Breakpoints of a sample that are rare in the controls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitmark import schema
from splitmark.functions import genomics as G
from splitmark.operators import controls, intervals, partners, reads
from splitmark.session import written


@dataclass(frozen=True)
class NovelParams:
    min_depth: int = 3
    max_frequency: int = 10
    min_mapped: int = 2  # reads with mapping quality 2 or more
    max_mate_chrs: int = 4
    min_median_quality: float = 15.0
    flank: int = 15


def site_reason(params: NovelParams = NovelParams()) -> Column:
    """Why a site is dropped, in order; null for a novel one. Needs obs, frequency, mapped and mate_chrs."""
    return (
        F.when(F.col("obs") < params.min_depth, "shallow")
        .when(F.col("frequency") > params.max_frequency, "common")
        .when(F.col("mapped") < params.min_mapped, "multimapped")
        .when(F.col("mate_chrs") > params.max_mate_chrs, "promiscuous")
    )


def with_site_reasons(observed: DataFrame, control: DataFrame, own: DataFrame | None = None, params: NovelParams = NovelParams()) -> DataFrame:
    """Observations with frequency and reason. Shallow sites go before the lookup, as they are most.

    ``own``: (bp_id, n) to take off, such as the sample's own part in the controls.
    """
    deep = observed.where(F.col("obs") >= params.min_depth).withColumnRenamed("bp_id", "id")
    return controls.frequency(deep, control, own).withColumn("reject_reason", site_reason(params))


def novel_sites(observed: DataFrame, control: DataFrame, own_counted: bool = True, params: NovelParams = NovelParams()) -> DataFrame:
    """(sample, id, chr, bp_pos, obs, frequency, sample_count) of novel sites.

    ``own_counted``: each sample is among the controls, so one is taken off where the site is one of them. ``sample_count`` is the
    frequency and the sample itself.
    """
    deep = observed.where((F.col("obs") >= params.min_depth) & (F.col("mapped") >= params.min_mapped) & (F.col("mate_chrs") <= params.max_mate_chrs)).withColumnRenamed("bp_id", "id")
    found = controls.frequency(deep, control)
    if own_counted:
        found = found.withColumn("frequency", F.greatest(F.col("frequency") - 1, F.lit(0)))
    kept = found.where(F.col("frequency") <= params.max_frequency)
    return kept.select("sample", "id", "chr", "bp_pos", "obs", "frequency", (F.col("frequency") + 1).alias("sample_count"))


def good_quality(sites: DataFrame, qualities: DataFrame, params: NovelParams = NovelParams()) -> DataFrame:
    """Sites whose clipped bases have a median quality of at least ``min_median_quality``."""
    return sites.join(qualities.where(F.col("median_quality") >= params.min_median_quality), ["sample", "chr", "bp_pos"], "left_semi")


def flanks(sites: DataFrame, reference: DataFrame, n: int = 15, bin_size: int = 32) -> DataFrame:
    """``sites`` (chr, pos, ...) with ``before`` and ``after``: n reference bases up to pos - 1, and from pos on.

    Each site asks for the few bins that its flanks touch; bases that the reference lacks are left out.
    """
    first = F.floor((F.col("pos") - n) / bin_size)
    asked = sites.withColumn("bin", F.explode(F.sequence(first, F.floor((F.col("pos") + n - 1) / bin_size)))).withColumn("bin", F.col("bin").cast("int"))
    keys = sites.columns
    got = asked.join(reference, ["chr", "bin"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "bases"))).alias("b"))
    whole = F.array_join(F.transform("b", lambda x: x["bases"]), "")
    offset = F.col("pos") - F.get("b", F.lit(0))["bin"] * bin_size
    return got.select(*keys, F.substring(whole, (offset - n + 1).cast("int"), F.lit(n)).alias("before"), F.substring(whole, (offset + 1).cast("int"), F.lit(n)).alias("after"))


def oriented(sites: DataFrame) -> DataFrame:
    """``opposing`` and ``same_side`` flanks; the sides swap where any read begins clipped there."""
    starts = F.col("start_clips") > 0
    return sites.withColumn("opposing", F.when(starts, F.col("before")).otherwise(F.col("after"))).withColumn("same_side", F.when(starts, F.col("after")).otherwise(F.col("before")))


def reference_reason(end: int = 5) -> Column:
    """homopolymer, unknown_bases or null, from ``opposing`` and ``same_side``."""
    homopolymer = G.is_homopolymer(F.col("same_side"), -end) | G.is_homopolymer(F.col("opposing"), end)
    unknown = F.col("opposing").endswith("NNN") | F.col("same_side").startswith("NNN")
    return F.when(homopolymer, "homopolymer").when(unknown, "unknown_bases")


def find_breakpoints(quiet: DataFrame, control: DataFrame, reference: DataFrame, exons: DataFrame, params: NovelParams = NovelParams(), own_counted: bool = True) -> DataFrame:
    """The whole search: one row for each sample and novel site, as ``report.output_rows`` takes it.

    ``quiet``: reads with their breakpoints, behind the noise gate and without duplicates, with bases and qualities. Sites have to be deep,
    rare, well mapped and with few mates' contigs, of good clip quality, and in reference sequence that is known and no homopolymer. A
    site's partner is sought with the consensus of the sample that agrees best there, the first by name of those; genes come with the
    distances to their nearest exons.
    """
    place = ["sample", "chr", "bp_pos"]
    observed = reads.site_counts(quiet).withColumn("bp_id", schema.xpos(F.col("chr_idx"), F.col("bp_pos")))
    novel = novel_sites(observed, control, own_counted, params).join(observed.select(*place, "start_clips"), place)
    good = good_quality(novel, reads.clip_qualities(quiet), params).withColumnRenamed("bp_pos", "pos")
    known = oriented(flanks(good, reference, params.flank)).where(reference_reason().isNull()).drop("before", "after", "same_side")
    agreed = reads.consensus(quiet).select("sample", "chr", F.col("bp_pos").alias("pos"), "bases", "score")
    found = written(known.join(agreed, ["sample", "chr", "pos"]), "found")
    best = found.groupBy("id", "chr").agg(F.min(F.struct((-F.col("score")).alias("score"), "sample", "bases", "opposing")).alias("b"))
    sites = best.select("id", "chr", "b.bases", "b.opposing", (-F.col("b.score")).alias("score"))
    chosen = partners.choose(partners.candidates(partners.queries(sites), partners.targets(sites)))
    placed = found.select(F.col("id").alias("partner"), F.concat_ws(":", "chr", F.col("pos").cast("string")).alias("text")).distinct()
    named = chosen.join(placed, "partner").select("id", F.col("text").alias("partner"))
    genes = intervals.genes_near(found.select("id", "chr", "pos").distinct(), exons)
    return found.select("id", "chr", "pos", "sample", "obs", "sample_count", "score", "bases").join(named, "id", "left").join(genes, "id", "left")


def merge_samples(found: DataFrame) -> DataFrame:
    """Sites of several samples as one row each: obs and samples summed, the first sample by name shown."""
    return found.groupBy("id", "chr", "bp_pos").agg(F.sum("obs").alias("obs"), F.count("*").alias("samples"), F.min("sample").alias("sample"), F.max("frequency").alias("frequency"))


def extended_regions(reads: DataFrame, existing: DataFrame, depth: int = 2) -> DataFrame:
    """Where more than ``depth`` mates of reads in ``existing`` gather outside of it: merged regions around the mates."""
    n = F.char_length("bases")
    mates = reads.select(F.col("mate_chr").alias("chr"), F.col("mate_start").alias("start"), (F.col("mate_start") + n).alias("stop"))
    # Both are looked at several times from here on; written, the reads are looked at once.
    deep = written(intervals.coverage(mates).where(F.col("depth") > depth).select("chr", "start", "stop"), "deep")
    outside = written(intervals.overlap_join(deep, existing.select("chr", "start", "stop"), how="left_anti"), "outside")
    return intervals.reduce(outside)
