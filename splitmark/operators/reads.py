"""Read-level operators: filters with reasons, breakpoint positions, noise, duplicates and observations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitmark import schema
from splitmark.functions import genomics as G
from splitmark.operators import intervals
from splitmark.session import written


@dataclass(frozen=True)
class ReadParams:
    """Thresholds of the read filter. ``None`` turns a rule off."""

    min_clip: int = 15  # strictly more clipped bases are needed
    drop_chimeric: bool = False
    max_mate_distance: int | None = 100_000
    low_quality: int = 12
    max_low_quality: int | None = 20  # more bases below ``low_quality`` drop a read
    adapter: str | None = "AGATC"
    adapter_gap: int = 10
    adapter_start_only: bool = False
    min_matched: int | None = 22
    proper_only: bool = False  # drops secondary, supplementary and improperly paired reads


#: The rules of the extractors that came before.
STRICT = ReadParams(min_clip=10, drop_chimeric=True, max_mate_distance=900, low_quality=20, max_low_quality=20, adapter_start_only=True, min_matched=None, proper_only=True)


def low_quality_count(cutoff: int) -> Column:
    return F.size(F.filter("quals", lambda q: q < cutoff))


def reject_reason(params: ReadParams = ReadParams()) -> Column:
    """Why a read is dropped, the first rule in order; null for one that is kept."""
    ops, gap_start = G.cigar_ops(F.col("cigar")), F.abs(F.col("mate_start") - F.col("aln_start"))
    gap_end = F.abs(F.col("mate_start") - F.col("aln_end"))
    reason = F.when(G.longest_end_clip(F.col("cigar")) <= params.min_clip, "unclipped")
    if params.drop_chimeric:
        reason = reason.when(F.col("chr") != F.col("mate_chr"), "chimeric")
    if params.proper_only:
        reason = reason.when(schema.flag(schema.SECONDARY) | schema.flag(schema.SUPPLEMENTARY) | ~schema.flag(schema.PROPER), "improper")
    if params.max_mate_distance is not None:
        reason = reason.when(gap_end > params.max_mate_distance, "anomalous")
    if params.max_low_quality is not None:
        reason = reason.when(low_quality_count(params.low_quality) > params.max_low_quality, "low_quality")
    if params.adapter:
        near = (gap_start if params.adapter_start_only else F.least(gap_start, gap_end)) < params.adapter_gap
        holds = F.col("bases").contains(params.adapter) | F.col("bases").contains(G.reverse_complement(F.lit(params.adapter)))
        lone = F.lit(False) if params.adapter_start_only else schema.flag(schema.PAIRED) & schema.flag(schema.MATE_UNMAPPED)
        reason = reason.when(~lone & near & holds, "adapter")
    if params.min_matched is not None:
        # The pattern holds wherever the rest does, and spares most reads the lists.
        both = F.col("cigar").rlike(r"\dS.*\dS") & (F.size(ops) > 2) & (G.first_op(ops) == "S") & (G.last_op(ops) == "S")
        reason = reason.when(both & (G.matched(ops) < params.min_matched), "contamination")
    return reason


def with_reasons(reads: DataFrame, params: ReadParams = ReadParams()) -> DataFrame:
    return reads.withColumn("reject_reason", reject_reason(params))


def interesting(reads: DataFrame, params: ReadParams = ReadParams()) -> DataFrame:
    return reads.where(reject_reason(params).isNull())


def reason_counts(reads: DataFrame, params: ReadParams = ReadParams(), by: tuple[str, ...] = ()) -> DataFrame:
    """Reads by reason, ``kept`` for those that pass."""
    return with_reasons(reads, params).groupBy(*by, F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def positions(reads: DataFrame) -> DataFrame:
    """Reads with the place of their breakpoint: the aligned start of a read that begins clipped, the aligned end of one that begins
    matched. Reads that begin otherwise have none."""
    first = F.regexp_extract("cigar", r"^\d+([A-Z=])", 1)
    side = F.when(first == "S", "start").when(first == "M", "end")
    placed = reads.withColumn("side", side).where("side is not null")
    return placed.withColumn("bp_pos", F.when(F.col("side") == "start", F.col("aln_start")).otherwise(F.col("aln_end"))).withColumn("bp_id", schema.xpos(F.col("chr_idx"), F.col("bp_pos")))


@dataclass(frozen=True)
class NoiseParams:
    behind: int = 247
    ahead: int = 249
    max_reads: int = 200
    max_positions: int = 10
    bin: int = 1 << 16  # a contig is cut into bins, each with a halo as wide as the frame


def noise_windows(reads: DataFrame, params: NoiseParams = NoiseParams()) -> DataFrame:
    """(sample, chr, pos, reads, clipped_positions, noisy) at every read start and end clip.

    Counts are first summed by position, so a frame's cost follows positions, not reads; bins with a halo let one contig be
    worked on by many tasks. Reads are looked at once, and every sum has a fixed size: at a place with two starts or more the read first
    in the file counts, of reads at the same place in it the one with the smaller operator.
    """
    op, order = F.regexp_extract("cigar", r"^\d+([A-Z=])", 1), F.coalesce("file_ord", F.lit(-(1 << 63)))
    start = F.struct(F.col("aln_start").alias("pos"), F.lit(1).cast("bigint").alias("n"), order.alias("order"), op.alias("op"))
    end = F.struct(F.col("aln_end").alias("pos"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("order"), F.lit(None).cast("string").alias("op"))
    ends = reads.select("sample", "chr", F.explode(F.when(F.col("cigar").rlike(r"^\d+M"), F.array(start, end)).otherwise(F.array(start))).alias("p")).select("sample", "chr", "p.*")
    first = lambda kind: F.min(F.when(kind, F.col("order")))
    places = ends.groupBy("sample", "chr", "pos").agg(F.sum("n").alias("n"), first(F.col("op") == "S").alias("s"), first(F.col("op").isNull() | (F.col("op") < "S")).alias("before"), first(F.col("op") > "S").alias("behind"))
    clipped = F.coalesce((F.col("n") >= 2) & (F.col("s") < F.coalesce("before", F.lit((1 << 63) - 1))) & (F.col("s") <= F.coalesce("behind", F.lit((1 << 63) - 1))), F.lit(False))
    places = places.select("sample", "chr", "pos", "n", clipped.cast("bigint").alias("clipped"))
    reach = max(params.behind, params.ahead)
    low, high = F.floor((F.col("pos") - reach) / params.bin), F.floor((F.col("pos") + reach) / params.bin)
    binned = places.withColumn("own", F.floor(F.col("pos") / params.bin)).withColumn("bin", F.explode(F.sequence(low, high)))
    frame = Window.partitionBy("sample", "chr", "bin").orderBy("pos").rangeBetween(-params.behind, params.ahead)
    found = binned.select("sample", "chr", "pos", "own", "bin", F.sum("n").over(frame).alias("reads"), F.sum("clipped").over(frame).alias("clipped_positions")).where("own = bin")
    return found.select("sample", "chr", "pos", "reads", "clipped_positions", ((F.col("reads") > params.max_reads) | (F.col("clipped_positions") > params.max_positions)).alias("noisy"))


def quiet(reads: DataFrame, windows: DataFrame) -> DataFrame:
    """Reads whose start and breakpoint both lie at places that aren't noisy. ``reads`` has ``bp_pos``."""
    # Written, as it is looked up twice and its size tells whether every task can have it whole.
    noisy = written(windows.where("noisy").select("sample", "chr", "pos"), "noisy")
    kept = reads.join(noisy.withColumnRenamed("pos", "aln_start"), ["sample", "chr", "aln_start"], "left_anti")
    return kept.join(noisy.withColumnRenamed("pos", "bp_pos"), ["sample", "chr", "bp_pos"], "left_anti")


def noise_regions(windows: DataFrame) -> DataFrame:
    """Runs of noisy places that directly follow each other in the list of places: (sample, chr, start, stop, places).

    A run that is still open at the end of a contig is closed there.
    """
    by = ["sample", "chr"]
    noisy = intervals.numbered(windows.select(*by, "pos", "noisy"), by, "pos").where("noisy").withColumnRenamed("at", "place")
    runs = intervals.numbered(noisy, by, "pos").withColumn("run", F.col("place") - F.col("at"))
    return runs.groupBy("sample", "chr", "run").agg(F.min("pos").alias("start"), F.max("pos").alias("stop"), F.count("*").alias("places")).drop("run")


def trailing_clips(reads: DataFrame, width: int = 500, size: int = 1 << 16) -> DataFrame:
    """Clipped reads that start within ``width`` before each start: (sample, chr, pos, clips). Contigs are cut into bins of ``size``, each
    with what lies within ``width`` before it."""
    counts = reads.groupBy("sample", "chr", F.col("aln_start").alias("pos")).agg(F.count("*").alias("n"))
    binned = counts.withColumn("own", F.floor(F.col("pos") / size)).withColumn("bin", F.explode(F.sequence("own", F.floor((F.col("pos") + width) / size))))
    frame = Window.partitionBy("sample", "chr", "bin").orderBy("pos").rangeBetween(-width, 0)
    found = binned.select("sample", "chr", "pos", "own", "bin", F.sum("n").over(frame).alias("clips"))
    return found.where("own = bin").select("sample", "chr", "pos", "clips")


def without_duplicates(reads: DataFrame) -> DataFrame:
    """Of reads at one breakpoint with the same unclipped start and end the first in the file stays.

    The choice is a minimum, so it is combined before the shuffle and a hot breakpoint does no harm.
    """
    start, end = G.unclipped(F.col("aln_start"), F.col("aln_end"), F.col("cigar"))
    rest = [c for c in reads.columns if c not in ("sample", "chr", "bp_pos", "file_ord")]
    kept = reads.groupBy("sample", "chr", "bp_pos", start.alias("u_start"), end.alias("u_end")).agg(F.min(F.struct("file_ord", *rest)).alias("r"))
    return kept.select("sample", "chr", "bp_pos", "r.*")


def observations(reads: DataFrame) -> DataFrame:
    """One row for each sample and breakpoint: counts, clips by side, mapping quality and mates.

    ``mate_xpos`` lists the mates' places, sorted, where there are two reads or more.
    """
    mates = F.sort_array(F.collect_list(schema.xpos(F.col("mate_chr_idx"), F.col("mate_start"))))
    found = reads.groupBy("sample", "chr", "chr_idx", "bp_pos").agg(
        F.count("*").alias("obs"),
        F.count_if(F.col("side") == "start").alias("start_clips"),
        F.count_if(F.col("side") == "end").alias("end_clips"),
        F.max("mapq").alias("max_mapq"),
        F.count_if(F.col("mapq") >= 2).alias("mapped"),
        F.count_distinct("mate_chr_idx").alias("mate_chrs"),
        mates.alias("mate_xpos"),
    )
    return found.withColumn("mate_xpos", F.when(F.col("obs") > 1, F.col("mate_xpos")).otherwise(F.array().cast("array<bigint>"))).withColumn("bp_id", schema.xpos(F.col("chr_idx"), F.col("bp_pos")))


def site_counts(reads: DataFrame) -> DataFrame:
    """As :func:`observations` without the lists: every aggregate has a fixed size. Mapping qualities come as what adds up over samples."""
    mapq = F.col("mapq").cast("bigint")
    return reads.groupBy("sample", "chr", "chr_idx", "bp_pos").agg(
        F.count("*").alias("obs"), F.count_if(F.col("side") == "start").alias("start_clips"), F.max("mapq").alias("max_mapq"), F.count_if(F.col("mapq") >= 2).alias("mapped"), F.count_distinct("mate_chr_idx").alias("mate_chrs"),
        F.min("mapq").alias("min_mapq"), F.sum(mapq).alias("mapq_sum"), F.sum(mapq * mapq).alias("mapq_squares"),
    )


def clip_qualities(reads: DataFrame, n: int = 15) -> DataFrame:
    """(sample, chr, bp_pos, median_quality) over the qualities of clipped bases, at most ``n`` of each read."""
    lead, tail = G.lead_clip(F.col("cigar")), G.tail_clip(F.col("cigar"))
    start = F.slice("quals", F.greatest(lead - n, F.lit(0)) + 1, F.least(lead, F.lit(n)))
    end = F.slice("quals", F.size("quals") - tail + 1, F.least(tail, F.lit(n)))
    taken = reads.select("sample", "chr", "bp_pos", F.explode(F.when(F.col("side") == "start", start).otherwise(end)).alias("q"))
    # An exact histogram first: its size is that of the quality alphabet, not of the reads.
    counts = taken.groupBy("sample", "chr", "bp_pos", "q").agg(F.count("*").alias("n"))
    return counts.groupBy("sample", "chr", "bp_pos").agg(F.expr("percentile(q, 0.5, n)").alias("median_quality"))


def consensus(reads: DataFrame, n: int = 15) -> DataFrame:
    """(sample, chr, bp_pos, bases, score, depth): at each clipped column the modal base, ties to the smaller letter; the score adds up
    the modal shares. End clips count from the breakpoint outwards, start clips end at it."""
    clip = G.clipped_bases(F.col("bases"), F.col("cigar"), F.col("side"), n)
    columns = reads.select("sample", "chr", "bp_pos", F.posexplode(F.split(F.when(F.col("side") == "start", F.reverse(clip)).otherwise(clip), "")).alias("at", "base")).where("base <> ''")
    counts = columns.groupBy("sample", "chr", "bp_pos", "at", "base").agg(F.count("*").alias("n"))
    modal = counts.groupBy("sample", "chr", "bp_pos", "at").agg(F.min(F.struct((-F.col("n")).alias("n"), "base")).alias("m"), F.sum("n").alias("total"))
    order = F.array_sort(F.collect_list(F.struct("at", F.col("m.base").alias("base"), (-F.col("m.n") / F.col("total")).alias("share"))))
    built = modal.groupBy("sample", "chr", "bp_pos").agg(order.alias("c"), F.max("total").alias("depth"))
    score = F.aggregate("c", F.lit(0.0), lambda s, c: s + c["share"])
    return built.select("sample", "chr", "bp_pos", F.array_join(F.transform("c", lambda c: c["base"]), "").alias("bases"), F.round(score, 9).alias("score"), "depth")


def quality_letters(quals: Column) -> Column:
    """Qualities as text, a letter each, counted from ``!``."""
    return F.array_join(F.transform(quals, lambda q: F.char(q + 33)), "")


def unmapped_pairs(reads: DataFrame, cutoff: int = 20, most: int = 4) -> DataFrame:
    """Pairs with at least one unmapped mate whose two reads both have ``most`` bases below ``cutoff`` at most: bases and qualities (the
    letters of a FASTQ file) of both.

    Mates meet by name; the second read is given reverse-complemented, as it was sequenced, and its qualities are turned with it. Names are
    looked at first, so bases and qualities of the many pairs that are mapped never move.
    """
    good = reads.where(schema.flag(schema.FIRST | schema.SECOND) & (low_quality_count(cutoff) <= most))
    unmapped = schema.UNMAPPED | schema.MATE_UNMAPPED
    lost = good.groupBy("sample", "read_name").agg(*[F.bool_or(schema.flag(bit)).alias(c) for bit, c in ((unmapped, "lost"), (schema.FIRST, "one"), (schema.SECOND, "two"))]).where("lost and one and two")
    named = written(lost.select("sample", "read_name"), "names")
    ends = written(good.join(named, ["sample", "read_name"], "left_semi").select("sample", "read_name", "flags", "bases", quality_letters(F.col("quals")).alias("quals")), "ends")
    side = lambda bit, n: ends.where(schema.flag(bit)).select("sample", "read_name", F.col("bases").alias(f"bases_{n}"), F.col("quals").alias(f"quals_{n}"), F.col("flags").alias(f"flags_{n}"))
    pairs = side(schema.FIRST, 1).join(side(schema.SECOND, 2), ["sample", "read_name"]).where(schema.flag(unmapped, "flags_1") | schema.flag(unmapped, "flags_2"))
    return pairs.select("sample", "read_name", "bases_1", "quals_1", G.reverse_complement(F.col("bases_2")).alias("bases_2"), F.reverse("quals_2").alias("quals_2"))


def fragments(reads: DataFrame) -> DataFrame:
    """(chr, start, stop) spanned by a read and its mate on the same contig, half-open; the read alone otherwise."""
    n = F.char_length("bases")
    same = F.col("chr") == F.col("mate_chr")
    low = F.when(same, F.least("aln_start", "mate_start")).otherwise(F.col("aln_start"))
    high = F.when(same, F.greatest(F.col("aln_end"), F.col("mate_start") + n - 1)).otherwise(F.col("aln_end"))
    return reads.select("chr", (low - 1).alias("start"), high.alias("stop"), "sample")
