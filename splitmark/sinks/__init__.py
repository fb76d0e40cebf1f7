"""Outputs: tables, text formats and report data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitmark.operators.features import CORE, INSERT_FEATURES, PREFIXES, SUPPORT_FEATURES

#: The columns of the output table, in order.
COLUMNS = ("chr", "start", "end", "sample", "depth", "sample_count", "cscore", "partner", "genes", "cdsdist")


def write_tsv(rows: DataFrame, path: str) -> None:
    """The output table with its header."""
    rows.select(*COLUMNS).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def bed_rows(sites: DataFrame, reach: int = 100) -> DataFrame:
    """(chr, start, stop, sample): ``reach`` positions around each site."""
    return sites.select("chr", (F.col("start") - reach).alias("start"), (F.col("start") + reach).alias("stop"), "sample")


def write_bed(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("sep", "\t").csv(path)


def json_rows(rows: DataFrame) -> DataFrame:
    """One JSON object a row (column ``json``), genes and distances as lists: what a report page loads."""
    split = lambda c: F.filter(F.split(c, ","), lambda v: v != "")
    listed = rows.withColumns({"genes": split("genes"), "cdsdist": F.transform(split("cdsdist"), lambda v: v.cast("int"))})
    return listed.select(F.to_json(F.struct(*COLUMNS)).alias("json"))


def gene_json(exons: DataFrame) -> DataFrame:
    """One JSON object a gene: its name, contig, span and exons in order."""
    listed = exons.groupBy("gene", "chr").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("exons"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    return listed.select("gene", F.to_json(F.struct("gene", "chr", "start", "stop", "exons")).alias("json"))


def write_controls(sites: DataFrame, observed: DataFrame, samples: DataFrame, path: str) -> None:
    """A control database: sites and observations by contig, sorted by place, and the samples. A contig is cut into as many ranges of
    places as its rows ask for, so the largest isn't one task's."""
    sites.repartitionByRange("chr", "id").sortWithinPartitions("chr", "id").write.mode("overwrite").partitionBy("chr").parquet(f"{path}/breakpoint")
    observed.repartitionByRange("chr", "bp_id").sortWithinPartitions("chr", "bp_id").write.mode("overwrite").partitionBy("chr").parquet(f"{path}/breakpoint_observation")
    samples.write.mode("append").parquet(f"{path}/sample")


def fastq_rows(pairs: DataFrame, mate: int) -> DataFrame:
    """(read_name, value): the four lines of one read of each pair, from ``reads.unmapped_pairs``."""
    lines = F.concat_ws("\n", F.concat(F.lit("@"), F.col("read_name"), F.lit(f" /{mate}")), f"bases_{mate}", F.lit("+"), f"quals_{mate}")
    return pairs.select("read_name", lines.alias("value"))


def write_fastq(pairs: DataFrame, path: str) -> None:
    """Two folders of gzipped FASTQ, mates in the same order: pairs are dealt and sorted by name alike for both."""
    for mate in (1, 2):
        fastq_rows(pairs, mate).repartitionByRange("read_name").sortWithinPartitions("read_name").select("value").write.mode("overwrite").option("compression", "gzip").text(f"{path}/r{mate}")


def vcf_lines(variants: DataFrame, annotated: DataFrame) -> DataFrame:
    """The records (column ``value``) with the control counts appended to INFO."""
    f = F.split("line", "\t")
    info = F.concat_ws(";", F.get(f, F.lit(7)), F.concat(F.lit("CONTROL_OBS="), "obs"), F.concat(F.lit("CONTROL_OBS_MAX="), F.col("obs_max").cast("string")), F.concat(F.lit("CONTROL_SC="), "samples"), F.concat(F.lit("CONTROL_SC_MAX="), F.col("samples_max").cast("string")))
    return variants.join(annotated, "vid").select("vid", F.array_join(F.concat(F.slice(f, 1, 7), F.array(info), F.slice(f, 9, 1_000_000)), "\t").alias("value"))


def write_reads(reads: DataFrame, path: str) -> None:
    """Reads by contig and ranges of starts, sorted, so that a region scan skips most files and row groups."""
    reads.repartitionByRange("chr", "aln_start").sortWithinPartitions("chr", "aln_start").write.mode("overwrite").partitionBy("chr").parquet(path)


def write_features(rows: DataFrame, path: str) -> None:
    """The annotated table of ``features.annotate_breakpoints`` with its header."""
    rows.select(*CORE, *[f"{p}_{f}" for p in PREFIXES for f in SUPPORT_FEATURES], *INSERT_FEATURES).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def label_rows(best: DataFrame) -> DataFrame:
    """(node_id, custom_label) of ``report.best_per_group``."""
    return best.select(F.col("id").alias("node_id"), F.col("label").alias("custom_label"))


def label_bed(best: DataFrame) -> DataFrame:
    """(chr, start, stop, label) of labelled alignments, one position less on either side; ``best`` has ``stop``."""
    return best.select(F.concat(F.lit("chr"), F.regexp_replace("chr", "^chr", "")).alias("chr"), (F.col("start") + 1).alias("start"), (F.col("stop") - 1).alias("stop"), "label")


def write_labels(best: DataFrame, csv: str, bed: str) -> None:
    """Labels of graph nodes as a table with a header, and their places as BED."""
    label_rows(best).write.mode("overwrite").option("header", True).csv(csv)
    write_bed(label_bed(best), bed)


def write_statistics(counts: DataFrame, path: str) -> None:
    """Counts by sample and reason (``reads.reason_counts`` by sample) as a table with a header."""
    counts.select("sample", "reason", "n").write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
