"""Reads, genes, regions and a reference sequence projected from the driver's tables.

None of those tables holds reads, so each relation is written once, in SQL that Spark and DuckDB read alike; the queries build
DataFrames from it and the oracles begin with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

READS_SQL = """
p_line AS (
  SELECT CAST(l_orderkey AS BIGINT) ok, CAST(l_partkey AS BIGINT) pk, CAST(l_suppkey AS BIGINT) sk, CAST(l_linenumber AS BIGINT) ln, CAST(l_quantity AS BIGINT) q
  FROM lineitem),
p_hash AS (
  SELECT *, md5(concat_ws('|', CAST(ok AS STRING), CAST(pk AS STRING), CAST(sk AS STRING), CAST(ln AS STRING), CAST(q AS STRING))) h,
    CASE WHEN q <= 28 THEN 10000 + q * 16 ELSE 20000 + q * 100 END + CASE WHEN sk % 50 = (ln * 7 + q) % 50 THEN 5 ELSE 0 END pos,
    CASE WHEN pk % 23 = 0 OR pk % 19 = 0 OR pk % 29 = 0 THEN 20 ELSE 16 + (ok * 7 + pk * 3) % 15 END clip
  FROM p_line),
p_cigar AS (
  SELECT *,
    CASE WHEN pk % 23 = 0 THEN '80M' WHEN pk % 19 = 0 THEN '10S70M' WHEN pk % 29 = 0 THEN '25S20M35S' WHEN q % 2 = 0 THEN concat(CAST(clip AS STRING), 'S', CAST(80 - clip AS STRING), 'M') ELSE concat(CAST(80 - clip AS STRING), 'M', CAST(clip AS STRING), 'S') END cigar,
    CASE WHEN pk % 31 = 0 THEN 25 ELSE ok % 10 END low_quals,
    CASE WHEN ok % 11 = 0 THEN 1 + pk % 7 ELSE ln END mate_ln,
    CASE WHEN pk % 37 = 0 THEN pos + 500000 WHEN pk % 7 = 3 AND ok % 3 = 0 THEN pos + 3 ELSE pos + 300 + ok % 50 END mate_pos,
    substr(translate(md5(concat('c', CAST(ln AS STRING), '_', CAST(CASE WHEN q % 2 = 0 THEN q - 1 ELSE q + 1 END AS STRING))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 30) clip_bases,
    concat(translate(h, '0123456789abcdef', 'ACGTACGTACGTACGT'), translate(md5(h), '0123456789abcdef', 'ACGTACGTACGTACGT')) other_bases
  FROM p_hash),
p_place AS (
  SELECT *,
    CASE WHEN cigar LIKE '%S' AND cigar <> '25S20M35S' THEN pos - 79 + clip ELSE pos END aln_start,
    CASE WHEN cigar = '80M' THEN pos + 79 WHEN cigar = '10S70M' THEN pos + 69 WHEN cigar = '25S20M35S' THEN pos + 19 WHEN cigar LIKE '%S' THEN pos ELSE pos + 79 - clip END aln_end,
    CASE WHEN pk % 53 = 0 THEN concat(substr(other_bases, 1, 10), 'AGATC', substr(other_bases, 16, CAST(65 - clip AS INT))) ELSE substr(other_bases, 1, CAST(80 - clip AS INT)) END body
  FROM p_cigar),
reads AS (
  SELECT concat('S', CAST(sk % 50 AS STRING)) AS sample, h AS read_name, ok * 8 + ln AS file_ord,
    CAST(1 + CASE WHEN ok % 13 = 0 THEN 0 ELSE 2 END + CASE WHEN sk % 41 = 0 THEN 8 ELSE 0 END + CASE WHEN pk % 2 = 0 THEN 16 ELSE 0 END + CASE WHEN pk % 3 = 0 THEN 32 ELSE 0 END
      + CASE WHEN ln % 2 = 0 THEN 64 ELSE 128 END + CASE WHEN pk % 43 = 0 THEN 256 ELSE 0 END + CASE WHEN pk % 47 = 0 THEN 2048 ELSE 0 END AS INT) AS flags,
    CAST(ln AS STRING) AS chr, CAST(ln AS INT) AS chr_idx, CAST(aln_start AS INT) AS aln_start, CAST(aln_end AS INT) AS aln_end,
    CAST(CASE WHEN pk % 17 = 0 THEN 0 WHEN pk % 13 = 0 THEN 1 ELSE 20 + ok % 41 END AS INT) AS mapq, cigar,
    CASE WHEN cigar LIKE '%S' AND cigar <> '25S20M35S' THEN concat(body, substr(clip_bases, 1, CAST(clip AS INT))) ELSE concat(substr(clip_bases, CAST(31 - clip AS INT), CAST(clip AS INT)), body) END AS bases,
    CAST(low_quals AS INT) AS low_quals, CAST(ok % 5 AS INT) AS qual_step,
    CAST(mate_ln AS STRING) AS mate_chr, CAST(mate_ln AS INT) AS mate_chr_idx, CAST(mate_pos AS INT) AS mate_start,
    CAST(CASE WHEN mate_ln = ln THEN mate_pos - aln_start + 80 + CASE WHEN ok % 4 = 0 THEN 400 + pk % 90 ELSE 0 END ELSE 0 END AS INT) AS insert_size
  FROM p_place)"""

#: Base qualities: the first ``low_quals`` of 80 are poor, the others good; one text for each engine.
QUALS_SPARK = "transform(sequence(1, 80), i -> CASE WHEN i <= low_quals THEN 5 ELSE 28 + qual_step END)"
QUALS_DUCK = "list_transform(range(1, 81), lambda i: CASE WHEN i <= low_quals THEN 5 ELSE 28 + qual_step END)"

REGIONS_SQL = """
regions_a AS (
  SELECT CAST(o_orderkey AS BIGINT) AS rid, CAST(1 + o_custkey % 7 AS STRING) AS chr, CAST(floor(o_totalprice) AS INT) AS start, CAST(floor(o_totalprice) + o_orderkey % 400 AS INT) AS stop FROM orders),
regions_b AS (
  SELECT CAST(c_custkey AS BIGINT) AS rid, CAST(1 + c_custkey % 7 AS STRING) AS chr, CAST(floor(abs(c_acctbal) * 40) AS INT) AS start, CAST(floor(abs(c_acctbal) * 40) + 50 + c_custkey % 900 AS INT) AS stop FROM customer)"""

EXONS_SQL = """
exons AS (
  SELECT concat('G', CAST(q AS STRING), '_', CAST(ln AS STRING)) AS gene, CAST(ln AS STRING) AS chr, CAST(20000 + q * 250 + e * 60 AS INT) AS start, CAST(20000 + q * 250 + e * 60 + 25 AS INT) AS stop, CASE WHEN q % 2 = 0 THEN '+' ELSE '-' END AS strand
  FROM (SELECT DISTINCT CAST(l_linenumber AS BIGINT) ln, CAST(l_quantity AS BIGINT) q FROM lineitem WHERE CAST(l_quantity AS BIGINT) % 3 = 0) g, (SELECT CAST(r_regionkey AS BIGINT) e FROM region WHERE r_regionkey < 3) x)"""

REFERENCE_SQL = """
ref_seq AS (
  SELECT CAST(ln AS STRING) AS chr, CAST(a * 50 + b AS INT) AS bin, translate(md5(concat('r', CAST(ln AS STRING), '_', CAST(a * 50 + b AS STRING))), '0123456789abcdef', 'AAGTACGTACATACGG') AS bases
  FROM (SELECT DISTINCT CAST(l_linenumber AS BIGINT) ln FROM lineitem) c, (SELECT CAST(n_nationkey AS BIGINT) a FROM nation) x, (SELECT DISTINCT CAST(l_quantity AS BIGINT) - 1 b FROM lineitem) y)"""


def relation(spark: SparkSession, sf_dir: str, parts: tuple[str, ...], name: str) -> DataFrame:
    """A relation of the texts above over the tables of ``sf_dir``, without registering anything in the session."""
    used = [t for t in TABLES if any(f"FROM {t}" in part for part in parts)]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    text = ", ".join(parts)
    for t in used:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(f"WITH {text} SELECT * FROM {name}", **tables)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with the qualities of ``QUALS_SPARK``, made of two runs rather than by a function called for each base."""
    low = F.greatest(F.coalesce("low_quals", F.lit(0)), F.lit(0))
    quals = F.concat(F.array_repeat(F.lit(5), low), F.array_repeat(28 + F.col("qual_step"), 80 - low))
    return relation(spark, sf_dir, (READS_SQL,), "reads").withColumn("quals", quals).drop("low_quals", "qual_step")


def regions(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    return relation(spark, sf_dir, (REGIONS_SQL,), f"regions_{which}")


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, (EXONS_SQL,), "exons")


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chr, bin, bases): 32 bases to a bin."""
    return relation(spark, sf_dir, (REFERENCE_SQL,), "ref_seq")


#: The same reads for an oracle.
READS_ORACLE = READS_SQL.replace("\nreads AS (", "\nraw_reads AS (", 1) + f",\nreads AS (SELECT * EXCLUDE (low_quals, qual_step), {QUALS_DUCK} AS quals FROM raw_reads)"
