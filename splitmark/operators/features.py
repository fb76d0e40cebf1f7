"""Read support and insert sizes around a breakpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitmark import schema
from splitmark.functions import genomics as G
from splitmark.operators import intervals

SUPPORT_TYPES = ("SUPPORT", "CONTRA", "NO_OVERLAP")


def support_type(pos: str = "pos") -> Column:
    """SUPPORT: soft-clipped at the very place; CONTRA: covers the place, clipped ends included; NO_OVERLAP otherwise. Read columns end
    in _b."""
    lead, tail = G.lead_clip(F.col("cigar_b")), G.tail_clip(F.col("cigar_b"))
    place = F.col(pos)
    supports = ((lead > 0) & (F.col("aln_start_b") == place)) | ((tail > 0) & (F.col("aln_end_b") == place))
    covers = (F.col("aln_start_b") - lead <= place) & (F.col("aln_end_b") + tail >= place)
    return F.when(supports, "SUPPORT").when(covers, "CONTRA").otherwise("NO_OVERLAP")


def _pair() -> Column:
    """Reads near a site that are mapped as well as their mates."""
    return schema.flag(schema.PAIRED, "flags_b") & ~schema.flag(schema.UNMAPPED | schema.MATE_UNMAPPED, "flags_b")


def _elsewhere() -> Column:
    return ~F.col("chr_b").eqNullSafe(F.col("mate_chr_b"))


def support_counts(near: DataFrame) -> DataFrame:
    """(id, support, features) of reads near sites, as from ``intervals.around``: counts by strand, pairing and mapping quality.

    ``paired``, ``mate_chrs`` and ``misoriented`` count reads mapped as well as their mates, ``chimeric`` all paired reads.
    """
    typed = near.withColumn("support", support_type("pos_a"))
    flags = "flags_b"
    orientation = G.orientation(flags, "aln_start_b", "aln_end_b", "mate_start_b", "insert_size_b")
    return typed.groupBy(F.col("id_a").alias("id"), "support").agg(
        F.count("*").alias("total"),
        F.count_if(~schema.flag(schema.REVERSE, flags)).alias("forward"),
        F.count_if(schema.flag(schema.REVERSE, flags)).alias("reverse"),
        F.count_if(_pair()).alias("paired"),
        F.count_if(schema.flag(schema.PAIRED, flags) & _elsewhere()).alias("chimeric"),
        F.count_if(F.col("mapq_b") == 0).alias("mapq0"),
        F.count_if(F.col("mapq_b") < 10).alias("low_mapq"),
        F.count_distinct(F.when(_pair(), F.col("mate_chr_b"))).alias("mate_chrs"),
        F.count_if(_pair() & (orientation != "FR")).alias("misoriented"),
        F.count_if((G.lead_clip(F.col("cigar_b")) > 0) | (G.tail_clip(F.col("cigar_b")) > 0)).alias("clipped"),
    )


def read_support(near: DataFrame) -> DataFrame:
    """:func:`support_counts` and ``top_chimeric``: of pairs, the reads whose mates lie on the commonest other contig."""
    counts = support_counts(near)
    # Counted by contig first.
    top = near.withColumn("support", support_type("pos_a")).where(_pair() & _elsewhere()).groupBy(F.col("id_a").alias("id"), "support", "mate_chr_b").agg(F.count("*").alias("n")).groupBy("id", "support").agg(F.max("n").alias("top_chimeric"))
    return counts.join(top, ["id", "support"], "left").fillna(0, ["top_chimeric"])


def support_table(near: DataFrame) -> DataFrame:
    """(id, SUPPORT, CONTRA, NO_OVERLAP): reads of each type, 0 where none."""
    typed = near.select(F.col("id_a").alias("id"), support_type("pos_a").alias("support"))
    return typed.groupBy("id").pivot("support", list(SUPPORT_TYPES)).count().fillna(0)


def insert_size_clusters(near: DataFrame, least: int = 4, fewest: int = 10) -> DataFrame:
    """(id, n_sizes, sd_ratio, mean_shift) over the positive insert sizes of paired reads near each site.

    The sizes are split in two where the squares within the parts add up to the least, equal sizes staying together. ``sd_ratio`` compares
    the spread of the parts with the whole spread, turned over where it exceeds 1. With fewer than ``fewest`` sizes, or where a part of the
    best split has fewer than ``least``, it is 1 and the shift 0. Sizes are counted first, so a window holds distinct sizes, not reads.
    """
    counts = near.where(schema.flag(schema.PAIRED, "flags_b") & (F.col("insert_size_b") > 0)).groupBy(F.col("id_a").alias("id"), F.col("insert_size_b").cast("bigint").alias("size")).agg(F.count("*").alias("c"))
    up = Window.partitionBy("id").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("id")
    sums = {"n": F.col("c"), "s": F.col("c") * F.col("size"), "q": F.col("c") * F.col("size") * F.col("size")}
    run = counts.select("id", *[F.sum(v).over(up).alias(k) for k, v in sums.items()], *[F.sum(v).over(all_).alias(f"{k}_all") for k, v in sums.items()])
    squares = lambda q, s, n: F.when(n > 0, q - s.cast("double") * s / n).otherwise(0.0)
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    m, t, r = F.col("n_all") - n, F.col("s_all") - s, F.col("q_all") - q
    parts = run.select("id", "n", "s", "n_all", "s_all", squares(q, s, n).alias("left"), squares(r, t, m).alias("right"), squares(F.col("q_all"), F.col("s_all"), F.col("n_all")).alias("whole"))
    best = parts.groupBy("id").agg(F.min(F.struct((F.col("n") == F.col("n_all")).alias("last"), (F.col("left") + F.col("right")).alias("within"), *[c for c in parts.columns if c != "id"])).alias("b")).select("id", "b.*")
    rest = F.col("n_all") - F.col("n")
    split = (F.col("n_all") >= fewest) & (F.least("n", rest) >= least)
    spread = F.sqrt(F.col("left") / (F.col("n") - 1) + F.col("right") / (rest - 1) + 1) / (F.sqrt(F.col("whole") / (F.col("n_all") - 1)) + 1)
    ratio = F.when(split, F.least(spread, 1 / spread)).otherwise(1.0)
    shift = F.when(split, F.abs((F.col("s_all") - F.col("s")) / rest - F.col("s") / F.col("n"))).otherwise(0.0)
    return best.select("id", F.col("n_all").alias("n_sizes"), F.round(ratio, 6).alias("sd_ratio"), F.round(shift, 6).alias("mean_shift"))


#: The columns of an annotated table, in order; those of the output table that it keeps, read support features and the names
#: that they have here, and insert sizes.
CORE = ("chr", "start", "sample", "depth", "sample_count", "cscore", "partner", "genes", "cdsdist")
SUPPORT_FEATURES = {
    "forward": "forward", "reverse": "reverse", "lowMapQ": "low_mapq", "multimapping": "mapq0", "numberOfMateChromosomes": "mate_chrs", "nonFROrientation": "misoriented", "softClipped": "clipped",
}
PREFIXES = {"sup": "SUPPORT", "nsup": "CONTRA"}
INSERT_FEATURES = {"insertSizeClusterMeanShift": "mean_shift", "insertSizeClusterSdRatio": "sd_ratio"}


def annotate_breakpoints(rows: DataFrame, reads: DataFrame, reach: int = 200, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """The rows of an output table with features of the reads around them, as the annotated table has them.

    Reads are those of the row's own sample, or all with ``by=()``. Where no read is near, counts are 0, the shift 0 and the ratio 1.
    Repeated rows stay; the places are looked at once.
    """
    key = F.concat_ws("\t", "sample", "chr", F.col("start").cast("string"))
    sites = rows.select(key.alias("id"), "sample", "chr", F.col("start").alias("pos")).distinct()
    near = intervals.around(sites, reads, reach, by)
    of = lambda kind, c: F.max(F.when(F.col("support") == kind, F.col(c)))
    wide = [of(kind, c).alias(f"{prefix}_{name}") for prefix, kind in PREFIXES.items() for name, c in SUPPORT_FEATURES.items()]
    support = support_counts(near).groupBy("id").agg(*wide)
    sizes = insert_size_clusters(near).select("id", *[F.col(c).alias(name) for name, c in INSERT_FEATURES.items()])
    joined = rows.select(*CORE, key.alias("id")).join(support, "id", "left").join(sizes, "id", "left")
    found = [c for c in support.columns if c != "id"]
    return joined.fillna(0, found).fillna({"insertSizeClusterMeanShift": 0.0, "insertSizeClusterSdRatio": 1.0}).select(*CORE, *found, *INSERT_FEATURES)
