"""Output tables: rows, report filters, links between sites, and summary statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splitmark.functions import genomics as G
from splitmark.operators import intervals


@dataclass(frozen=True)
class ReportParams:
    min_depth: int = 3
    max_samples: int = 10
    proximity: str = "none"  # close, adjacent or inside limit the distance to a coding sequence
    excluded: tuple[str, ...] = ()  # sample names, or patterns after a tilde


#: Largest distance to a coding sequence by class.
PROXIMITY = {"close": 500, "adjacent": 50, "inside": 0}


def output_rows(sites: DataFrame, sample_pattern: str | None = None) -> DataFrame:
    """The ten output columns. ``sites``: chr, pos, sample, obs, sample_count, score, bases, partner (``chr:pos`` or null), genes, cdsdist
    (arrays or null)."""
    return sites.select(
        "chr",
        F.col("pos").alias("start"),
        (F.col("pos") + 1).alias("end"),
        G.masked_sample(F.col("sample"), sample_pattern).alias("sample"),
        F.col("obs").alias("depth"),
        "sample_count",
        G.three_decimals(F.col("score") / F.char_length("bases")).alias("cscore"),
        F.coalesce("partner", F.lit("")).alias("partner"),
        F.array_join(F.coalesce("genes", F.array().cast("array<string>")), ",").alias("genes"),
        F.array_join(F.coalesce("cdsdist", F.array().cast("array<int>")).cast("array<string>"), ",").alias("cdsdist"),
    )


def report_filter(rows: DataFrame, params: ReportParams = ReportParams()) -> DataFrame:
    """Rows (depth, sample_count, sample, cdsdist array) that a report shows."""
    kept = rows.where((F.col("depth") > params.min_depth) & (F.col("sample_count") <= params.max_samples))
    literal = [e for e in params.excluded if not e.startswith("~")]
    if literal:
        kept = kept.where(~F.col("sample").isin(literal))
    for pattern in (e[1:] for e in params.excluded if e.startswith("~")):
        kept = kept.where(~F.col("sample").rlike(pattern))
    if params.proximity in PROXIMITY:
        most = PROXIMITY[params.proximity]
        kept = kept.where(F.exists("cdsdist", lambda d: (d >= 0) & (d <= most)))
    return kept


def sample_names(sites: DataFrame, observed: DataFrame, below: int = 5, most: int = 5) -> DataFrame:
    """(id, samples): the first ``most`` samples of sites seen in fewer than ``below``."""
    rare = sites.where(F.col("sample_count") < below).select("id")
    names = observed.select(F.col("bp_id").alias("id"), "sample").distinct().join(rare, "id", "left_semi")
    ranked = names.withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("sample"))).where(F.col("at") <= most)
    return ranked.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("sample")), ",").alias("samples"))


def secondary_sites(rows: DataFrame, domain: int = 1000) -> DataFrame:
    """Pairs of sites of one sample within ``domain`` on a contig: (sample, id, other, linked), linked where one is the other's partner.

    Sites are binned by ``domain``, and each looks at its own bin and the next, so a pair meets once.
    """
    bins = rows.withColumn("bin", F.floor(F.col("pos") / domain))
    left = bins.select("sample", "chr", "id", "pos", "partner", F.explode(F.array(F.col("bin"), F.col("bin") + 1)).alias("bin"), F.col("bin").alias("own"))
    right = bins.select("sample", "chr", F.col("id").alias("other"), F.col("pos").alias("other_pos"), F.col("partner").alias("other_partner"), "bin")
    pairs = left.join(right, ["sample", "chr", "bin"]).where((F.col("pos") < F.col("other_pos")) & (F.col("other_pos") - F.col("pos") <= domain))
    linked = F.coalesce(F.col("partner") == F.col("other"), F.lit(False)) | F.coalesce(F.col("other_partner") == F.col("id"), F.lit(False))
    return pairs.select("sample", "id", "other", linked.alias("linked"))


def with_metadata(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows with the user's tags and greyed marks by id; untagged rows get an empty tag and are not greyed."""
    return rows.join(marks, "id", "left").withColumns({"tag": F.coalesce("tag", F.lit("")), "greyed": F.coalesce("greyed", F.lit(False))})


def page(rows: DataFrame, number: int, size: int = 15) -> DataFrame:
    """A page of the report table, by position and sample."""
    return rows.orderBy("chr", "start", "sample").offset(number * size).limit(size)


def best_per_group(scores: DataFrame) -> DataFrame:
    """Of each id the best scored alignment, numbered along its contig: (id, chr, start, score, label), and ``stop`` where there is one."""
    more = [c for c in ("stop",) if c in scores.columns]
    order = F.struct((-F.col("score")).alias("score"), "chr", "start", *more)
    best = scores.groupBy("id").agg(F.min(order).alias("m")).select("id", "m.chr", "m.start", *[f"m.{c}" for c in more], (-F.col("m.score")).alias("score"))
    label = F.concat(F.lit("chr"), F.regexp_replace("chr", "^chr", ""), F.lit("_"), F.col("at").cast("string"))
    return intervals.numbered(best, ["chr"], "start", ("id",)).withColumn("label", label).drop("at")


def clip_depth(clips: DataFrame, least: int = 2) -> DataFrame:
    """(chr, start, depth) of clips by start, with ``least`` or more."""
    return clips.groupBy("chr", "start").agg(F.count("*").alias("depth")).where(F.col("depth") >= least)


def sample_totals(stats: DataFrame) -> DataFrame:
    """All counters summed by sample."""
    return stats.groupBy("sample").agg(*[F.sum(c).alias(c) for c in stats.columns if c != "sample"])


def histogram(values: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """(bucket, n): equal-width buckets between the smallest and the largest value, the largest in the last."""
    ends = values.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    placed = values.crossJoin(F.broadcast(ends))  # one row
    width = (F.col("high") - F.col("low")) / bins
    bucket = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(column) - F.col("low")) / width), F.lit(bins - 1)))
    return placed.groupBy(bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def per_megabase(counts: DataFrame, lengths: DataFrame) -> DataFrame:
    """(chr, n, per_mb) of counts by contig and contig lengths."""
    return counts.join(lengths, "chr").select("chr", "n", F.round(F.col("n") * 1e6 / F.col("length"), 6).alias("per_mb"))


def zipped(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Rows of two short lists side by side by position, such as files and sample names; the longer one's rest is left out."""
    number = lambda df, order: df.withColumn("at", F.row_number().over(Window.orderBy(order)))
    return number(a, order_a).join(number(b, order_b), "at").drop("at")
