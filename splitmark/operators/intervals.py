"""Closed-interval algebra over (chr, start, stop), by bins, so that every join is an equi-join.

An interval is copied into each bin that it touches. A pair is reported only in the first bin that both touch, so no duplicates need
to be removed. Windows that run along a contig work bin by bin first and then over one row per bin or island.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitmark.session import written

BIN = 1 << 14


def _bins(low: Column, high: Column, size: int) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def overlap_join(a: DataFrame, b: DataFrame, reach: int = 0, size: int = BIN, how: str = "inner", by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows on one contig whose intervals share a position, or come within ``reach``. Columns get the suffixes _a and _b.

    ``how``: inner, or left_anti for the rows of ``a`` without a partner (under their own names). ``by``: columns that both must agree in.
    """
    left = a.select(*[F.col(c).alias(f"{c}_a") for c in a.columns]).withColumn("low_a", F.col("start_a") - reach).withColumn("high_a", F.col("stop_a") + reach)
    left = left.withColumn("bin", F.explode(_bins(F.col("low_a"), F.col("high_a"), size)))
    right = b.select(*[F.col(c).alias(f"{c}_b") for c in b.columns]).withColumn("bin_b", F.explode(_bins(F.col("start_b"), F.col("stop_b"), size)))
    meets = (F.col("chr_a") == F.col("chr_b")) & (F.col("bin") == F.col("bin_b")) & (F.col("low_a") <= F.col("stop_b")) & (F.col("high_a") >= F.col("start_b"))
    for c in by:
        meets = meets & (F.col(f"{c}_a") == F.col(f"{c}_b"))
    if how == "left_anti":
        keys = [f"{c}_a" for c in a.columns]
        met = left.join(right, meets, "left_semi").select(*[F.col(k).alias(c) for k, c in zip(keys, a.columns, strict=True)]).distinct()
        return a.join(met, [a[c].eqNullSafe(met[c]) for c in a.columns], "left_anti")
    once = F.col("bin") == F.greatest(F.floor(F.col("low_a") / size), F.floor(F.col("start_b") / size))
    return left.join(right, meets & once).drop("bin", "bin_b", "low_a", "high_a")


def _islands(rows: DataFrame, by: list[str]) -> DataFrame:
    """Overlapping intervals merged within each group of ``by``; intervals that only touch stay apart."""
    order = Window.partitionBy(*by).orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.select(*by, "start", "stop", F.when(before >= F.col("start"), 0).otherwise(1).alias("fresh"))
    numbered = marked.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def reduce(regions: DataFrame, size: int = BIN) -> DataFrame:
    """Overlapping regions merged: (chr, start, stop).

    Regions are merged within the bins that they start in. Those of a bin that begin within the reach of earlier bins belong to the last
    merged region that began there; only one row for each bin runs along a contig to tell both.
    """
    local = _islands(regions.select("chr", F.floor(F.col("start") / size).alias("bin"), "start", "stop"), ["chr", "bin"])
    earlier = Window.partitionBy("chr").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    reached = local.groupBy("chr", "bin").agg(F.max("stop").alias("last")).select("chr", "bin", F.max("last").over(earlier).alias("reached"))
    joined = local.join(reached, ["chr", "bin"])
    marked = joined.withColumn("head", F.when(F.col("reached").isNull() | (F.col("reached") < F.col("start")), F.col("start")))
    heads = marked.groupBy("chr", "bin").agg(F.max("head").alias("head")).select("chr", "bin", F.max("head").over(earlier).alias("before"))
    named = marked.join(heads, ["chr", "bin"]).withColumn("head", F.coalesce("head", "before"))
    return named.groupBy("chr", "head").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("head")


def numbered(rows: DataFrame, by: list[str], pos: str, ties: tuple[str, ...] = (), size: int = BIN) -> DataFrame:
    """``rows`` with ``at``: their number from 0 by ``pos`` and ``ties`` within each group of ``by``.

    Rows are numbered within bins; to that is added what the bins before hold, so one row for each bin runs along a contig.
    """
    binned = rows.withColumn("_bin", F.floor(F.col(pos) / size))
    earlier = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = binned.groupBy(*by, "_bin").agg(F.count("*").alias("n"))
    before = counts.select(*by, "_bin", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_bin").orderBy(pos, *ties)
    own = binned.withColumn("at", F.row_number().over(inside) - 1).join(before, [*by, "_bin"])
    return own.withColumn("at", F.col("at") + F.col("_before")).drop("_bin", "_before")


def coverage(regions: DataFrame, size: int = BIN) -> DataFrame:
    """(chr, start, stop, depth): segments of constant depth above 0, from running sums of starts and stops.

    The sum runs within bins; what a bin begins with is a running sum over one row for each bin.
    """
    ends = F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("stop") + 1).alias("pos"), F.lit(-1).alias("d")))
    places = regions.select("chr", F.explode(ends).alias("e")).select("chr", "e.*").groupBy("chr", "pos").agg(F.sum("d").alias("d"))
    steps = written(places, "steps").withColumn("bin", F.floor(F.col("pos") / size))
    per_bin = steps.groupBy("chr", "bin").agg(F.sum("d").alias("d"), F.min("pos").alias("first"))
    along = Window.partitionBy("chr").orderBy("bin")
    base = per_bin.select("chr", "bin", (F.sum("d").over(along) - F.col("d")).alias("base"), F.lead("first").over(along).alias("next_first"))
    inside = Window.partitionBy("chr", "bin").orderBy("pos")
    run = steps.select("chr", "bin", "pos", F.sum("d").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("sum"), F.lead("pos").over(inside).alias("next"))
    joined = run.join(base, ["chr", "bin"]).select("chr", F.col("pos").alias("start"), (F.coalesce("next", "next_first") - 1).alias("stop"), (F.col("sum") + F.col("base")).alias("depth"))
    return joined.where("depth > 0")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positions in both, as merged regions."""
    pairs = overlap_join(reduce(a), reduce(b))
    return pairs.select(F.col("chr_a").alias("chr"), F.greatest("start_a", "start_b").alias("start"), F.least("stop_a", "stop_b").alias("stop"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positions of ``a`` that aren't in ``b``, as merged regions."""
    whole = reduce(a)
    cut = overlap_join(whole, reduce(b)).select(F.col("chr_a").alias("chr"), F.col("start_a").alias("a_start"), F.col("stop_a").alias("a_stop"), F.col("start_b").alias("start"), F.col("stop_b").alias("stop"))
    order = Window.partitionBy("chr", "a_start").orderBy("start")
    gaps = cut.select("chr", F.coalesce(F.lag("stop").over(order) + 1, F.col("a_start")).alias("start"), (F.col("start") - 1).alias("stop"))
    tails = cut.groupBy("chr", "a_start", "a_stop").agg((F.max("stop") + 1).alias("start")).select("chr", "start", F.col("a_stop").alias("stop"))
    untouched = whole.join(cut.select("chr", F.col("a_start").alias("start")).distinct(), ["chr", "start"], "left_anti")
    return gaps.unionByName(tails).where("start <= stop").unionByName(untouched.select("chr", "start", "stop"))


def _running(steps: DataFrame, values: list[str], size: int) -> DataFrame:
    """``steps`` (chr, pos, values; one row for each place) with the values summed along the contig up to each place.

    The sums run within bins; what a bin begins with is a running sum over one row for each bin.
    """
    binned = steps.withColumn("bin", F.floor(F.col("pos") / size))
    along = Window.partitionBy("chr").orderBy("bin")
    base = binned.groupBy("chr", "bin").agg(*[F.sum(v).alias(v) for v in values]).select("chr", "bin", *[(F.sum(v).over(along) - F.col(v)).alias(f"{v}_base") for v in values])
    inside = Window.partitionBy("chr", "bin").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = binned.select("chr", "bin", "pos", *values, *[F.sum(v).over(inside).alias(f"{v}_run") for v in values])
    return run.join(base, ["chr", "bin"]).select("chr", "pos", *values, *[(F.col(f"{v}_run") + F.col(f"{v}_base")).alias(f"{v}_sum") for v in values])


def overlap_counts(a: DataFrame, b: DataFrame, least: int = 0, size: int = BIN) -> DataFrame:
    """Rows of ``a`` by ``rid`` with how many of ``b`` they overlap, those with more than ``least``.

    No pair is made: a region overlaps those of ``b`` that start up to its end, less those that end before its start, and both are running
    counts along the contig. Regions that end before they start, of which that doesn't hold, are joined.
    """
    key, straight = ["rid", "chr", "start", "stop"], F.col("start") <= F.col("stop")
    places = lambda df, **n: df.where(straight).select("chr", F.explode(F.array(*[F.struct(F.col(c).alias("pos"), *[F.lit(int(c == v)).cast("bigint").alias(k) for k, v in n.items()]) for c in ("start", "stop")])).alias("p")).select("chr", "p.*")
    steps = places(b, starts="start", stops="stop").unionByName(places(a, starts=None, stops=None)).groupBy("chr", "pos").agg(F.sum("starts").alias("starts"), F.sum("stops").alias("stops"))
    run = written(_running(steps, ["starts", "stops"], size), "overlaps")
    behind = run.select("chr", F.col("pos").alias("stop"), F.col("starts_sum").alias("begun"))
    before = run.select("chr", F.col("pos").alias("start"), (F.col("stops_sum") - F.col("stops")).alias("over"))
    counted = a.where(straight).select(*key).join(behind, ["chr", "stop"]).join(before, ["chr", "start"]).select(*key, (F.col("begun") - F.col("over")).alias("n"))
    pairs = overlap_join(a.where(~straight), b, size=size).unionByName(overlap_join(a.where(straight), b.where(~straight), size=size))
    joined = pairs.select(*[F.col(f"{c}_a").alias(c) for c in key], F.lit(1).cast("bigint").alias("n"))
    return counted.where("n > 0").unionByName(joined).groupBy(*key).agg(F.sum("n").alias("overlaps")).where(F.col("overlaps") > least)


def nearest(sites: DataFrame, features: DataFrame, reach: int) -> DataFrame:
    """(sites' columns, name, distance): of each site the nearest feature within ``reach``, 0 inside, ties to the smaller name.

    ``sites``: chr, pos and an ``id``; ``features``: chr, start, stop, name.
    """
    near = overlap_join(sites.withColumn("start", F.col("pos")).withColumn("stop", F.col("pos")), features, reach)
    gap = F.greatest(F.col("start_b") - F.col("pos_a"), F.col("pos_a") - F.col("stop_b"), F.lit(0))
    best = near.groupBy(F.col("id_a").alias("id")).agg(F.min(F.struct(gap.alias("distance"), F.col("name_b").alias("name"))).alias("m"))
    return best.select("id", "m.name", "m.distance")


def genes_near(sites: DataFrame, exons: DataFrame, reach: int = 5000) -> DataFrame:
    """(id, genes, cdsdist): all genes whose span comes within ``reach`` of a site, by name, and of each the distance to its nearest exon's
    ends, 0 where an exon touches the site or a neighbouring position. Sites without a gene are left out.

    ``sites``: id, chr, pos; ``exons``: gene, chr, start, stop.
    """
    spans = exons.groupBy("gene", "chr").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    near = overlap_join(sites.select("id", "chr", "pos", F.col("pos").alias("start"), F.col("pos").alias("stop")), spans, reach)
    met = near.select(F.col("id_a").alias("id"), F.col("pos_a").alias("pos"), F.col("gene_b").alias("gene"), F.col("chr_b").alias("chr")).join(exons.select("gene", "chr", "start", "stop"), ["gene", "chr"])
    inside = (F.col("start") <= F.col("pos") + 1) & (F.col("stop") >= F.col("pos") - 1)
    gap = F.when(inside, 0).otherwise(F.least(F.abs(F.col("start") - F.col("pos")), F.abs(F.col("stop") - F.col("pos"))))
    nearest_exon = met.groupBy("id", "gene").agg(F.min(gap).cast("int").alias("distance"))
    listed = nearest_exon.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("gene", "distance"))).alias("g"))
    return listed.select("id", F.col("g.gene").alias("genes"), F.col("g.distance").alias("cdsdist"))


def in_regions(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """Reads that overlap any of the regions, once each."""
    cols = reads.columns
    placed = reads.withColumn("start", F.col("aln_start")).withColumn("stop", F.col("aln_end"))
    hits = overlap_join(placed, reduce(regions)).select(*[F.col(f"{c}_a").alias(c) for c in cols])
    return hits.dropDuplicates(["sample", "read_name", "file_ord"])


def around(sites: DataFrame, reads: DataFrame, reach: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Reads (suffix _b) within ``reach`` of each site (suffix _a), of those that agree in the columns ``by``."""
    placed = reads.withColumn("start", F.col("aln_start")).withColumn("stop", F.col("aln_end"))
    return overlap_join(sites.withColumn("start", F.col("pos")).withColumn("stop", F.col("pos")), placed, reach, by=by)
