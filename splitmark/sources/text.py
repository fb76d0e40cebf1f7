"""Text formats: SAM, BED, TSV, VCF and FASTA, read with Spark's own readers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from splitmark import schema
from splitmark.functions import genomics as G


def _contig(names: F.Column) -> F.Column:
    return F.regexp_replace(names, "^chr", "")


def sam(spark: SparkSession, path: str, sample: str | None = None, multi: bool = False) -> DataFrame:
    """Reads of SAM text. The sample is the header's; several samples are refused unless ``multi``, which takes each read group's."""
    lines = spark.read.text(path).withColumn("file_ord", F.monotonically_increasing_id())
    field = lambda name: F.regexp_extract("value", rf"\t{name}:([^\t]*)", 1)
    named = lines.where(F.col("value").startswith("@RG")).select(field("ID").alias("group"), field("SM").alias("named")).groupBy("group").agg(F.max("named").alias("named"))
    samples = [r[0] for r in named.where("named <> ''").select("named").distinct().orderBy("named").limit(3).collect()]
    if len(samples) > 1 and not multi and sample is None:
        raise ValueError(f"several samples: {', '.join(samples[:2])}{', ...' if len(samples) > 2 else ''}")
    f = F.split("value", "\t")
    get = lambda i: F.get(f, F.lit(i))
    group = F.regexp_extract("value", r"\tRG:Z:([^\t]+)", 1)
    rows = lines.where(~F.col("value").startswith("@") & (F.col("value") != ""))
    own = F.lit(sample if sample else samples[0] if samples else "unknown")
    if multi and samples and not sample:
        rows, own = rows.withColumn("group", group).join(named, "group", "left"), F.col("named")
    ops = G.cigar_ops(get(5))
    spanned = F.aggregate(ops, F.lit(0), lambda s, o: s + F.when(o["op"].isin("M", "D", "N", "=", "X"), o["len"]).otherwise(0))
    start, mate = get(3).cast("int"), F.when(get(6) == "=", get(2)).otherwise(get(6))
    quals = F.transform(F.split(get(10), ""), lambda c: F.ascii(c) - 33)
    return rows.select(
        own.alias("sample"), get(0).alias("read_name"), "file_ord", get(1).cast("int").alias("flags"), _contig(get(2)).alias("chr"), schema.contig_index(get(2)).alias("chr_idx"),
        start.alias("aln_start"), (start + spanned - 1).alias("aln_end"), get(4).cast("int").alias("mapq"), get(5).alias("cigar"), get(9).alias("bases"), quals.alias("quals"),
        _contig(mate).alias("mate_chr"), schema.contig_index(mate).alias("mate_chr_idx"), get(7).cast("int").alias("mate_start"), get(8).cast("int").alias("insert_size"),
    )


def bed(spark: SparkSession, path: str) -> DataFrame:
    """Closed intervals (chr, start, stop, extra) of a BED file, whose starts count from 0 and whose ends are open."""
    rows = spark.read.text(path).where("value <> '' and not value rlike '^(#|track|browser)'")
    f = F.split("value", "\t")
    return rows.select(_contig(F.get(f, F.lit(0))).alias("chr"), (F.get(f, F.lit(1)).cast("int") + 1).alias("start"), F.get(f, F.lit(2)).cast("int").alias("stop"), F.get(f, F.lit(3)).alias("extra"))


def tsv(spark: SparkSession, path: str, header: bool = True, columns: str | None = None) -> DataFrame:
    """A table of text columns, or with the types of ``columns``; the first column is never taken for a number."""
    reader = spark.read.option("sep", "\t").option("header", header)
    return (reader.schema(columns) if columns else reader).csv(path)


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """(vid, chr, chr_idx, pos, svlen, info, line) of a VCF file's records, numbered in order of reading."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    f = F.split("value", "\t")
    info = F.str_to_map(F.get(f, F.lit(7)), F.lit(";"), F.lit("="))
    return rows.select(F.monotonically_increasing_id().alias("vid"), _contig(F.get(f, F.lit(0))).alias("chr"), schema.contig_index(F.get(f, F.lit(0))).alias("chr_idx"), F.get(f, F.lit(1)).cast("int").alias("pos"), info["SVLEN"].try_cast("int").alias("svlen"), info.alias("info"), F.col("value").alias("line"))


def vcf_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(chr, length) of a VCF header's major contigs."""
    rows = spark.read.text(path).where(F.col("value").startswith("##contig"))
    found = rows.select(_contig(F.regexp_extract("value", "ID=([^,>]+)", 1)).alias("chr"), F.regexp_extract("value", r"length=(\d+)", 1).try_cast("int").alias("length"))
    return found.where(schema.is_major(F.col("chr")))


def fasta(spark: SparkSession, path: str, bin_size: int = 32) -> DataFrame:
    """(chr, bin, bases) of a FASTA file, one row for each ``bin_size`` bases; positions count from 0 within a contig.

    Lines are placed within the block of the file that they were read from, blocks after one another by one row for each block and
    contig, so a contig is as many tasks as it has blocks. A contig without bases gives no row.
    """
    split = ["file", "block"]
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", r"\s+$", "").alias("line")
    )
    order = Window.partitionBy(*split).orderBy("n")
    head = F.col("line").startswith(">")
    length = F.when(head, 0).otherwise(F.char_length("line")).cast("bigint")
    marked = lines.withColumns({"part": F.count_if(head).over(order), "len": length})
    # part 0 of a block goes on with the contig of the block before
    inside = Window.partitionBy(*split, "part").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = marked.withColumn("at", F.coalesce(F.sum("len").over(inside), F.lit(0)))
    parts = marked.groupBy(*split, "part").agg(F.max(F.when(head, F.regexp_extract("line", r"^>\s*(\S*)", 1))).alias("name"), F.sum("len").alias("len"))
    along = Window.partitionBy("file").orderBy("block", "part")
    records = parts.withColumn("record", F.count("name").over(along)).where("record > 0")
    before = Window.partitionBy("file", "record").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    named = records.select(*split, "part", "record", F.max("name").over(Window.partitionBy("file", "record")).alias("name"), F.coalesce(F.sum("len").over(before), F.lit(0)).alias("offset"))
    pieces = placed.where("len > 0").join(named, [*split, "part"]).select("file", "record", "name", "line", "len", (F.col("at") + F.col("offset")).alias("at"))
    bins = F.sequence(F.floor(F.col("at") / bin_size), F.floor((F.col("at") + F.col("len") - 1) / bin_size))
    cut = pieces.withColumn("bin", F.explode(bins)).withColumn("from", F.greatest(F.col("bin") * bin_size - F.col("at"), F.lit(0)))
    to = F.least((F.col("bin") + 1) * bin_size - F.col("at"), F.col("len"))
    bits = cut.select("file", "record", "name", "bin", (F.col("at") + F.col("from")).alias("at"), F.substring("line", (F.col("from") + 1).cast("int"), (to - F.col("from")).cast("int")).alias("bases"))
    joined = bits.groupBy("file", "record", "name", "bin").agg(F.array_sort(F.collect_list(F.struct("at", "bases"))).alias("b"))
    return joined.select(_contig(F.col("name")).alias("chr"), F.col("bin").cast("int").alias("bin"), F.upper(F.array_join(F.transform("b", lambda x: x["bases"]), "")).alias("bases"))


def exons(spark: SparkSession, path: str) -> DataFrame:
    """A gene table (gene, chr, start, stop, strand) of tab-separated text with a header."""
    return tsv(spark, path, columns="gene string, chr string, start int, stop int, strand string").withColumn("chr", _contig(F.col("chr")))


def gene_list(spark: SparkSession, path: str) -> DataFrame:
    """(gene): the names of a text file, one a line, without blanks around them; empty lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias("gene")).where("gene <> ''")


def pedigree(spark: SparkSession, path: str) -> DataFrame:
    """(family, sample, father, mother, sex, phenotype) of a pedigree file; ``0`` stands for an unknown parent, which is null here."""
    f = F.split(F.trim("value"), r"\s+")
    get = lambda i: F.get(f, F.lit(i))
    rows = spark.read.text(path).where("trim(value) <> '' and not value like '#%'")
    parent = lambda i, name: F.when(get(i) != "0", get(i)).alias(name)
    return rows.select(get(0).alias("family"), get(1).alias("sample"), parent(2, "father"), parent(3, "mother"), get(4).try_cast("int").alias("sex"), get(5).alias("phenotype"))


def zipped_tsv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """The rows of all tables with a header in zip files, with ``member``, the table's name. ``columns``: what is taken of them, by name;
    a column that a table lacks is null. One task holds one zip file, and one table of it at a time."""
    wanted = spark.createDataFrame([], columns).columns

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in sorted(n for n in archive.namelist() if not n.endswith("/")):
                        with archive.open(member) as table:
                            rows = pd.read_csv(table, sep="\t", dtype=str, keep_default_na=False)
                        yield pd.DataFrame({c: rows[c] if c in rows else pd.Series([None] * len(rows), dtype=object) for c in wanted}).assign(member=member)

    text = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, ", ".join(f"`{c}` string" for c in [*wanted, "member"]))
    types = spark.createDataFrame([], columns).schema
    return text.select("member", *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in types])


def gene_regions(wanted: DataFrame, exon_table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(regions, missing): the span of each wanted gene, and the names that aren't in the table."""
    spans = exon_table.groupBy("gene", "chr").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return spans.join(wanted.select("gene").distinct(), "gene", "left_semi"), wanted.select("gene").distinct().join(spans, "gene", "left_anti")


def named_regions(spark: SparkSession, values: list[str], contigs: DataFrame | None = None) -> DataFrame:
    """Regions of a command line: ``chr:from-to``, a contig's name (its whole length, from ``contigs``), or the path of a BED file."""
    found = spark.createDataFrame([], "chr string, start int, stop int")
    for value in values:
        if value.endswith(".bed"):
            found = found.unionByName(bed(spark, value).select("chr", "start", "stop"))
        elif ":" in value:
            name, span = value.split(":")
            low, high = span.replace(",", "").split("-")
            found = found.unionByName(spark.range(1).select(_contig(F.lit(name)).alias("chr"), F.lit(int(low)).alias("start"), F.lit(int(high)).alias("stop")))
        elif contigs is not None:
            found = found.unionByName(contigs.where(F.col("chr") == value.removeprefix("chr")).select("chr", F.lit(1).alias("start"), F.col("length").alias("stop")))
    return found


def control_paths(spark: SparkSession, named: Sequence[str] = (), folder: str | None = None) -> list[str]:
    """Tables of sites of the control databases that are named (patterns are allowed), or else of all ``*.db`` in ``folder``, or else of
    all in the folder that the session names in ``spark.splitmark.databases``; in order of their names, each once."""
    folder = folder or spark.conf.get("spark.splitmark.databases", None)
    if not named and not folder:
        raise ValueError("neither a control database nor a folder of them is given")
    found = set()
    for pattern in named or [f"{folder.rstrip('/')}/*.db"]:
        place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        matches = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
        if not matches:
            raise ValueError(f"no control database at {pattern}")
        found.update(m.getPath().toString() for m in matches)
    return [f"{path}/breakpoint" for path in sorted(found)]


def control_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Control tables of several folders as one, with ``db_id`` for where each row came from."""
    found = None
    for number, path in enumerate(paths):
        table = spark.read.parquet(path).withColumn("db_id", F.lit(number))
        found = table if found is None else found.unionByName(table, allowMissingColumns=True)
    if found is None:
        raise ValueError("no control table is given")
    return found


def region_scan(reads: DataFrame, chr_name: str, low: int, high: int) -> DataFrame:
    """Reads that overlap a region; both bounds reach the Parquet scan."""
    return reads.where((F.col("chr") == chr_name) & (F.col("aln_start") <= high) & (F.col("aln_end") >= low))
