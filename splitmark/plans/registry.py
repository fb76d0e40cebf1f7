"""All queries by name, each with the SQL text that gives the same rows in DuckDB.

A query reads its relations from ``sources.projection`` and applies operators; its oracle begins with the same relations in SQL and
says what the result means, without the operators' plans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitmark import schema, sinks
from splitmark.functions import genomics as G
from splitmark.operators import controls, features, intervals, novel, partners, reads, report, variants
from splitmark.session import written
from splitmark.sources import projection
from splitmark.sources.projection import EXONS_SQL, READS_ORACLE, REFERENCE_SQL, REGIONS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


# --- SQL that several oracles share ---------------------------------------------------------------------------------------------

_CLIP = "coalesce(list_max(list_transform(regexp_extract_all(cigar, '(\\d+)S', 1), lambda x: CAST(x AS INT))), 0)"
_MATCHED = "coalesce(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)M', 1), lambda x: CAST(x AS INT))), 0)"
_ADAPTER = "(contains(bases, 'AGATC') OR contains(bases, 'GATCT'))"
_LOW = "len(list_filter(quals, lambda x: x < {}))"
_LEAD = "coalesce(try_cast(regexp_extract(cigar, '^(\\d+)S', 1) AS INT), 0)"
_TAIL = "coalesce(try_cast(regexp_extract(cigar, '(\\d+)S$', 1) AS INT), 0)"
_REASON = f"""CASE WHEN {_CLIP} <= 15 THEN 'unclipped' WHEN abs(mate_start - aln_end) > 100000 THEN 'anomalous' WHEN {_LOW.format(12)} > 20 THEN 'low_quality'
    WHEN NOT ((flags & 1) <> 0 AND (flags & 8) <> 0) AND least(abs(mate_start - aln_start), abs(mate_start - aln_end)) < 10 AND {_ADAPTER} THEN 'adapter'
    WHEN len(regexp_extract_all(cigar, '\\d+[A-Z]')) > 2 AND regexp_matches(cigar, '^\\d+S') AND cigar LIKE '%S' AND {_MATCHED} < 22 THEN 'contamination' ELSE 'kept' END"""

_REASONED = f"WITH {READS_ORACLE}, reasoned AS (SELECT *, {_REASON} AS reason FROM reads)"
_PLACED = f"""{_REASONED}, placed AS (
  SELECT *, CASE WHEN regexp_matches(cigar, '^\\d+S') THEN 'start' ELSE 'end' END AS side, CASE WHEN regexp_matches(cigar, '^\\d+S') THEN aln_start ELSE aln_end END AS bp_pos
  FROM reasoned WHERE reason = 'kept' AND regexp_matches(cigar, '^\\d+[SM]'))"""
_WINDOWS = f"""{_PLACED}, starts AS (
  SELECT sample, chr, aln_start AS pos, count(*) AS n, CASE WHEN count(*) >= 2 AND arg_min(regexp_extract(cigar, '^\\d+([A-Z])', 1), (file_ord, regexp_extract(cigar, '^\\d+([A-Z])', 1))) = 'S' THEN 1 ELSE 0 END AS clipped FROM reasoned WHERE reason = 'kept' GROUP BY 1, 2, 3),
places AS (
  SELECT sample, chr, pos, sum(n) AS n, sum(clipped) AS clipped FROM (
    SELECT * FROM starts UNION ALL SELECT DISTINCT sample, chr, aln_end, 0, 0 FROM reasoned WHERE reason = 'kept' AND regexp_matches(cigar, '^\\d+M')) GROUP BY 1, 2, 3),
windows AS (
  SELECT sample, chr, pos, CAST(sum(n) OVER w AS BIGINT) AS reads, CAST(sum(clipped) OVER w AS BIGINT) AS clipped_positions, sum(n) OVER w > 200 OR sum(clipped) OVER w > 10 AS noisy
  FROM places WINDOW w AS (PARTITION BY sample, chr ORDER BY pos RANGE BETWEEN 247 PRECEDING AND 249 FOLLOWING))"""
_QUIET = f"""{_WINDOWS}, calm AS (
  SELECT p.* FROM placed p WHERE NOT EXISTS (SELECT 1 FROM windows w WHERE w.noisy AND w.sample = p.sample AND w.chr = p.chr AND w.pos = p.aln_start)
    AND NOT EXISTS (SELECT 1 FROM windows w WHERE w.noisy AND w.sample = p.sample AND w.chr = p.chr AND w.pos = p.bp_pos)),
  quiet AS (SELECT * FROM calm QUALIFY row_number() OVER (PARTITION BY sample, chr, bp_pos, aln_start - {_LEAD}, aln_end + {_TAIL} ORDER BY file_ord, read_name) = 1)"""
_SITES = f"""{_QUIET}, observed AS (
  SELECT sample, chr, chr_idx, bp_pos, CAST(chr_idx AS BIGINT) * 1000000000 + bp_pos AS bp_id, count(*) AS obs, count(*) FILTER (side = 'start') AS start_clips, count(*) FILTER (side = 'end') AS end_clips, max(mapq) AS max_mapq,
    count(*) FILTER (mapq >= 2) AS mapped, count(DISTINCT mate_chr_idx) AS mate_chrs FROM quiet GROUP BY sample, chr, chr_idx, bp_pos),
controls AS (
  SELECT bp_id AS id, chr, bp_pos AS pos, count(*) AS sample_count, CAST(sum(obs) AS BIGINT) AS obs FROM observed GROUP BY bp_id, chr, bp_pos HAVING sum(obs) >= 3 AND max(obs) >= 3 AND max(max_mapq) > 0)"""


# --- relations that several queries share ---------------------------------------------------------------------------------------


#: What most queries need of a read; bases and qualities are asked for by name.
LIGHT = [c for c in (part.split()[0] for part in schema.READS.split(", ")) if c not in ("bases", "quals")]


def _kept(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Reads that pass the filter."""
    return reads.interesting(projection.reads(spark, sf_dir)).select(*LIGHT, *more)


def _placed(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return reads.positions(_kept(spark, sf_dir, *more))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.noise_windows(_kept(spark, sf_dir))


def _quiet(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Reads behind the noise gate, without duplicates; the filtered reads are written once for windows and gate."""
    kept = written(_kept(spark, sf_dir, *more), "reads")
    return reads.without_duplicates(reads.quiet(reads.positions(kept), reads.noise_windows(kept)))


def _site_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations by sample and site, written once: the table that controls and novel sites are both made of."""
    return written(reads.site_counts(_quiet(spark, sf_dir)).withColumn("bp_id", schema.xpos(F.col("chr_idx"), F.col("bp_pos"))), "observed")


def _controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controls.control_sites(_site_counts(spark, sf_dir))


# --- reads ----------------------------------------------------------------------------------------------------------------------


@query("read_filter_reasons", f"{_REASONED} SELECT reason, count(*) AS n FROM reasoned GROUP BY reason")
def read_filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.reason_counts(projection.reads(spark, sf_dir))


@query("run_stats", f"{_REASONED} SELECT sample, reason, count(*) AS n FROM reasoned GROUP BY sample, reason")
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.reason_counts(projection.reads(spark, sf_dir), by=("sample",))


@query(
    "read_filter_strict",
    f"""WITH {READS_ORACLE} SELECT read_name, CASE WHEN {_CLIP} <= 10 THEN 'unclipped' WHEN chr <> mate_chr THEN 'chimeric'
      WHEN (flags & 256) <> 0 OR (flags & 2048) <> 0 OR (flags & 2) = 0 THEN 'improper' WHEN abs(mate_start - aln_end) > 900 THEN 'anomalous'
      WHEN {_LOW.format(20)} > 20 THEN 'low_quality' WHEN abs(mate_start - aln_start) < 10 AND {_ADAPTER} THEN 'adapter' ELSE 'kept' END AS reason FROM reads""",
)
def read_filter_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.with_reasons(projection.reads(spark, sf_dir), reads.STRICT).select("read_name", F.coalesce("reject_reason", F.lit("kept")).alias("reason"))


@query("low_quality_reads", f"WITH {READS_ORACLE} SELECT sample, count(*) FILTER ({_LOW.format(20)} > 20) AS low, count(*) AS n FROM reads GROUP BY sample")
def low_quality_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.reads(spark, sf_dir).groupBy("sample").agg(F.count_if(reads.low_quality_count(20) > 20).alias("low"), F.count("*").alias("n"))


@query("region_scan", f"WITH {READS_ORACLE} SELECT read_name, sample, aln_start, aln_end FROM reads WHERE chr = '3' AND aln_start <= 10200 AND aln_end >= 10100")
def region_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from splitmark.sources.text import region_scan as scan

    return scan(projection.reads(spark, sf_dir), "3", 10_100, 10_200).select("read_name", "sample", "aln_start", "aln_end")


@query("fragment_intervals", f"WITH {READS_ORACLE} SELECT read_name, chr, CASE WHEN chr = mate_chr THEN least(aln_start, mate_start) ELSE aln_start END - 1 AS start, CASE WHEN chr = mate_chr THEN greatest(aln_end, mate_start + length(bases) - 1) ELSE aln_end END AS stop FROM reads")
def fragment_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = projection.reads(spark, sf_dir)
    return reads.fragments(rows.withColumn("sample", F.col("read_name"))).select(F.col("sample").alias("read_name"), "chr", "start", "stop")


_PAIRS = f"""WITH {READS_ORACLE}, named AS (SELECT sample, concat(sample, '_', CAST(file_ord // 16 AS STRING)) AS pair, flags, bases, array_to_string(list_transform(quals, lambda x: chr(x + 33)), '') AS letters, {_LOW.format(20)} AS low FROM reads)
    SELECT a.sample, a.pair AS read_name, a.bases AS bases_1, a.letters AS quals_1, reverse(translate(b.bases, 'ACGTN', 'TGCAN')) AS bases_2, reverse(b.letters) AS quals_2 FROM named a JOIN named b ON a.sample = b.sample AND a.pair = b.pair
    WHERE (a.flags & 64) <> 0 AND (b.flags & 128) <> 0 AND ((a.flags & 12) <> 0 OR (b.flags & 12) <> 0) AND a.low <= 4 AND b.low <= 4"""


@query("unmapped_pairs", _PAIRS)
def unmapped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = projection.reads(spark, sf_dir).withColumn("read_name", F.concat("sample", F.lit("_"), F.floor(F.col("file_ord") / 16).cast("string")))
    return reads.unmapped_pairs(named)


@query("fastq_records", f"""WITH pairs AS ({_PAIRS}) SELECT read_name, 1 AS mate, concat('@', read_name, ' /1', chr(10), bases_1, chr(10), '+', chr(10), quals_1) AS value FROM pairs
    UNION ALL SELECT read_name, 2, concat('@', read_name, ' /2', chr(10), bases_2, chr(10), '+', chr(10), quals_2) FROM pairs""")
def fastq_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = written(unmapped_pairs(spark, sf_dir), "pairs")
    both = [sinks.fastq_rows(pairs, mate).select("read_name", F.lit(mate).alias("mate"), "value") for mate in (1, 2)]
    return both[0].unionByName(both[1])


@query("soft_clip_positions", f"{_PLACED} SELECT sample, chr, bp_pos, side, count(*) AS n, min(file_ord) AS first_ord FROM placed GROUP BY 1, 2, 3, 4")
def soft_clip_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).groupBy("sample", "chr", "bp_pos", "side").agg(F.count("*").alias("n"), F.min("file_ord").alias("first_ord"))


@query("noise_windows", f"{_WINDOWS} SELECT * FROM windows")
def noise_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir)


@query(
    "noise_regions",
    f"""{_WINDOWS}, m AS (SELECT *, row_number() OVER w - sum(CAST(noisy AS INT)) OVER w AS run FROM windows WINDOW w AS (PARTITION BY sample, chr ORDER BY pos))
    SELECT sample, chr, min(pos) AS start, max(pos) AS stop, count(*) AS places FROM m WHERE noisy GROUP BY sample, chr, run""",
)
def noise_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.noise_regions(_windows(spark, sf_dir))


@query("trailing_clips", f"{_REASONED}, c AS (SELECT sample, chr, aln_start AS pos, count(*) AS n FROM reasoned WHERE reason = 'kept' GROUP BY 1, 2, 3) SELECT sample, chr, pos, CAST(sum(n) OVER (PARTITION BY sample, chr ORDER BY pos RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS BIGINT) AS clips FROM c")
def trailing_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.trailing_clips(reads.interesting(projection.reads(spark, sf_dir)))


_DEDUPED = f"""{_PLACED}, deduped AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY sample, chr, bp_pos, aln_start - {_LEAD}, aln_end + {_TAIL} ORDER BY file_ord, read_name) = 1)"""


@query("dedupe_reads", f"{_DEDUPED} SELECT sample, chr, bp_pos, file_ord, read_name, side, mapq FROM deduped")
def dedupe_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.without_duplicates(_placed(spark, sf_dir)).select("sample", "chr", "bp_pos", "file_ord", "read_name", "side", "mapq")


@query(
    "sample_observations",
    f"""{_SITES}, m AS (SELECT sample, chr, bp_pos, array_to_string(list_sort(list(CAST(mate_chr_idx AS BIGINT) * 1000000000 + mate_start)), ',') AS mates, count(*) AS n FROM quiet GROUP BY 1, 2, 3)
    SELECT o.sample, o.chr, o.bp_pos, o.obs, o.start_clips, o.end_clips, o.max_mapq, o.mapped, o.mate_chrs, CASE WHEN m.n > 1 THEN m.mates ELSE '' END AS mates FROM observed o JOIN m USING (sample, chr, bp_pos)""",
)
def sample_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reads.observations(_quiet(spark, sf_dir))
    return found.select("sample", "chr", "bp_pos", "obs", "start_clips", "end_clips", "max_mapq", "mapped", "mate_chrs", F.array_join(F.col("mate_xpos").cast("array<string>"), ",").alias("mates"))


_CLIPPED = f"CASE WHEN side = 'start' THEN substr(bases, greatest({_LEAD} - 15, 0) + 1, least({_LEAD}, 15)) ELSE substr(bases, length(bases) - {_TAIL} + 1, least({_TAIL}, 15)) END"


@query("clipped_bases", f"{_PLACED} SELECT read_name, side, {_CLIPPED} AS clip, reverse(translate({_CLIPPED}, 'ACGTN', 'TGCAN')) AS complement FROM placed")
def clipped_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    clip = G.clipped_bases(F.col("bases"), F.col("cigar"), F.col("side"))
    return _placed(spark, sf_dir, "bases").select("read_name", "side", clip.alias("clip"), G.reverse_complement(clip).alias("complement"))


@query("clip_qualities", f"""{_PLACED}, q AS (SELECT sample, chr, bp_pos, unnest(CASE WHEN side = 'start' THEN list_slice(quals, greatest({_LEAD} - 15, 0) + 1, greatest({_LEAD} - 15, 0) + least({_LEAD}, 15)) ELSE list_slice(quals, len(quals) - {_TAIL} + 1, len(quals) - {_TAIL} + least({_TAIL}, 15)) END) AS q FROM placed)
    SELECT sample, chr, bp_pos, quantile_cont(q, 0.5) AS median_quality FROM q GROUP BY 1, 2, 3""")
def clip_qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.clip_qualities(_placed(spark, sf_dir, "quals"))


_CONSENSUS = f"""{_QUIET}, clip AS (SELECT sample, chr, bp_pos, CASE WHEN side = 'start' THEN reverse({_CLIPPED}) ELSE {_CLIPPED} END AS c FROM quiet),
  col AS (SELECT sample, chr, bp_pos, i - 1 AS spot, substr(c, i, 1) AS base FROM clip, range(1, 16) t(i) WHERE i <= length(c)),
  cnt AS (SELECT sample, chr, bp_pos, spot, base, count(*) AS n FROM col GROUP BY ALL),
  modal AS (SELECT sample, chr, bp_pos, spot, arg_min(base, (-n, base)) AS base, max(n) AS n, sum(n) AS total FROM cnt GROUP BY 1, 2, 3, 4),
  consensus AS (SELECT sample, chr, bp_pos, string_agg(base, '' ORDER BY spot) AS bases, round(sum(n / total), 9) AS score, CAST(max(total) AS BIGINT) AS depth FROM modal GROUP BY 1, 2, 3)"""


@query("consensus_bases", f"{_CONSENSUS} SELECT * FROM consensus")
def consensus_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.consensus(_quiet(spark, sf_dir, "bases"))


@query("read_geometry", f"""WITH {READS_ORACLE} SELECT read_name, aln_start - {_LEAD} AS u_start, aln_end + {_TAIL} AS u_end, (flags & 16) <> 0 AS reverse_strand, (flags & 1) <> 0 AS paired, CASE WHEN ((flags & 16) <> 0) = ((flags & 32) <> 0) THEN 'TANDEM' WHEN CASE WHEN (flags & 16) = 0 THEN insert_size > 0 ELSE mate_start < aln_end END THEN 'FR' ELSE 'RF' END AS orientation,
    {_CLIP} AS longest, CAST({_MATCHED} AS INT) AS matched, CAST(chr_idx AS BIGINT) * 1000000000 + aln_start AS xpos FROM reads""")
def read_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = G.unclipped(F.col("aln_start"), F.col("aln_end"), F.col("cigar"))
    ops = G.cigar_ops(F.col("cigar"))
    return projection.reads(spark, sf_dir).select("read_name", start.alias("u_start"), end.alias("u_end"), schema.flag(schema.REVERSE).alias("reverse_strand"), schema.flag(schema.PAIRED).alias("paired"), G.orientation("flags", "aln_start", "aln_end", "mate_start", "insert_size").alias("orientation"), G.longest_clip(ops).alias("longest"), G.matched(ops).alias("matched"), schema.xpos(F.col("chr_idx"), F.col("aln_start")).alias("xpos"))


# --- controls -------------------------------------------------------------------------------------------------------------------


@query("control_build", f"{_SITES} SELECT id, chr, pos, sample_count, obs FROM controls")
def control_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _controls(spark, sf_dir)


@query("control_frequency", f"{_SITES} SELECT o.sample, o.bp_id AS id, o.obs, CAST(coalesce(c.sample_count, 0) AS BIGINT) AS frequency FROM observed o LEFT JOIN controls c ON c.id = o.bp_id")
def control_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = _site_counts(spark, sf_dir)
    return controls.frequency(observed.select("sample", F.col("bp_id").alias("id"), "obs"), controls.control_sites(observed))


@query("exclude_samples_frequency", f"""{_SITES}, x AS (SELECT bp_id AS id, count(DISTINCT sample) AS n FROM observed WHERE sample IN ('S1', 'S2', 'S3') GROUP BY bp_id)
    SELECT c.id, greatest(c.sample_count - coalesce(x.n, 0), 0) AS frequency FROM controls c LEFT JOIN x USING (id)""")
def exclude_samples_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = _site_counts(spark, sf_dir)
    table = controls.control_sites(observed)
    named = spark.createDataFrame([("S1",), ("S2",), ("S3",)], "sample string")
    return controls.frequency(table.select("id"), table, controls.excluded_counts(observed, named))


@query("control_records", f"{_SITES} SELECT o.sample, o.bp_id AS id, CAST(coalesce(c.obs, 0) AS BIGINT) AS control_obs, CAST(coalesce(c.sample_count, 0) AS BIGINT) AS control_samples FROM observed o LEFT JOIN controls c ON c.id = o.bp_id")
def control_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = _site_counts(spark, sf_dir)
    return controls.records(observed.select("sample", F.col("bp_id").alias("id")), controls.control_sites(observed)).select("sample", "id", "control_obs", "control_samples")


_HALVES = f"""{_SITES}, half AS (SELECT CAST(substr(sample, 2) AS INT) % 2 AS db_id, bp_id AS id, chr, bp_pos AS pos, count(*) AS sample_count, sum(obs) AS obs FROM observed GROUP BY 1, 2, 3, 4)"""


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two control tables, of samples with even and odd numbers, told apart by ``db_id``."""
    observed = _site_counts(spark, sf_dir)
    return observed.groupBy((F.substring("sample", 2, 9).cast("int") % 2).alias("db_id"), F.col("bp_id").alias("id"), "chr", F.col("bp_pos").alias("pos")).agg(F.count("*").alias("sample_count"), F.sum("obs").alias("obs"))


@query("combine_controls", f"{_HALVES} SELECT id, chr, pos, CAST(sum(sample_count) AS BIGINT) AS sample_count, CAST(sum(obs) AS BIGINT) AS obs FROM half GROUP BY 1, 2, 3")
def combine_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = _halves(spark, sf_dir)
    return controls.combine(half.where("db_id = 0").drop("db_id"), half.where("db_id = 1").drop("db_id"))


@query("control_ranges", f"{_HALVES} SELECT db_id, min(id) AS low, max(id) AS high FROM half GROUP BY db_id")
def control_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controls.id_ranges(_halves(spark, sf_dir))


@query("mapping_quality_sites", f"{_QUIET} SELECT CAST(chr_idx AS BIGINT) * 1000000000 + bp_pos AS id, chr, bp_pos AS pos, count(*) AS reads, min(mapq) AS min_mapq, max(mapq) AS max_mapq, round(avg(mapq), 6) AS mean_mapq, round(coalesce(stddev_samp(mapq), 0), 6) AS sd_mapq FROM quiet GROUP BY chr, chr_idx, bp_pos")
def mapping_quality_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controls.mapping_quality(_site_counts(spark, sf_dir))


@query("observation_count", f"{_SITES} SELECT count(*) AS n FROM observed")
def observation_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _site_counts(spark, sf_dir).agg(F.count("*").alias("n"))


@query("combine_observations", f"{_SITES} SELECT sample, bp_id, obs FROM observed WHERE CAST(substr(sample, 2) AS INT) % 2 = 0 UNION ALL SELECT sample, bp_id, obs FROM observed WHERE CAST(substr(sample, 2) AS INT) % 2 = 1")
def combine_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = _site_counts(spark, sf_dir).select("sample", "bp_id", "obs")
    odd = F.substring("sample", 2, 9).cast("int") % 2 == 1
    return controls.combine_observations(observed.where(~odd), observed.where(odd))


@query("legacy_counts", f"{_PLACED} SELECT CAST(chr_idx AS BIGINT) * 1000000000 + bp_pos AS bp_id, count(*) AS obs, count(DISTINCT sample) AS sample_count FROM placed GROUP BY 1")
def legacy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controls.legacy_counts(_placed(spark, sf_dir))


@query("resume_points", f"{_SITES} SELECT chr, max(pos) AS pos FROM controls GROUP BY chr")
def resume_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controls.resume_points(_controls(spark, sf_dir))


@query("resume_regions", f"WITH {REGIONS_SQL}, done AS (SELECT chr, max(start) AS pos FROM regions_b GROUP BY chr) SELECT rid, chr, greatest(start, coalesce(pos + 1, start)) AS start, stop FROM regions_a LEFT JOIN done USING (chr) WHERE pos IS NULL OR stop > pos")
def resume_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = projection.regions(spark, sf_dir, "b").groupBy("chr").agg(F.max("start").alias("pos"))
    return controls.after_resume(projection.regions(spark, sf_dir, "a"), done).select("rid", "chr", "start", "stop")


@query("region_chunks", f"WITH {REGIONS_SQL}, w AS (SELECT chr, min(start) AS lo, max(stop) AS hi FROM regions_a GROUP BY chr) SELECT chr, s AS start, least(s + 199999, hi) AS stop FROM w, LATERAL (SELECT unnest(range(CAST(lo AS BIGINT), CAST(hi AS BIGINT) + 1, 200000)) AS s) WHERE least(s + 199999, hi) - s + 1 > 500")
def region_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = projection.regions(spark, sf_dir, "a").groupBy("chr").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return controls.chunks(whole).select("chr", "start", "stop")


@query("streamed_sites", f"{_SITES} SELECT chr, CAST(bp_pos AS BIGINT) AS pos, count(*) AS sample_count, CAST(sum(obs) AS BIGINT) AS obs, max(obs) AS max_obs FROM observed GROUP BY chr, bp_pos")
def streamed_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    from splitmark.streaming.sites import replay

    return replay(_site_counts(spark, sf_dir).select("chr", "sample", F.col("bp_pos").alias("pos"), "obs"))


# --- novel sites ----------------------------------------------------------------------------------------------------------------


@query("novel_breakpoints", f"""{_SITES}, n AS (SELECT o.*, greatest(coalesce(c.sample_count, 0) - 1, 0) AS frequency FROM observed o LEFT JOIN controls c ON c.id = o.bp_id)
    SELECT sample, bp_id AS id, chr, bp_pos, obs, CAST(frequency AS BIGINT) AS frequency, CAST(frequency + 1 AS BIGINT) AS sample_count FROM n WHERE obs >= 3 AND mapped >= 2 AND mate_chrs <= 4 AND frequency <= 10""")
def novel_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = _site_counts(spark, sf_dir)
    return novel.novel_sites(observed, controls.control_sites(observed))


@query("site_reasons", f"""{_SITES} SELECT CASE WHEN coalesce(c.sample_count, 0) > 10 THEN 'common' WHEN mapped < 2 THEN 'multimapped' WHEN mate_chrs > 4 THEN 'promiscuous' ELSE 'novel' END AS reason, count(*) AS n
    FROM observed o LEFT JOIN controls c ON c.id = o.bp_id WHERE o.obs >= 3 GROUP BY 1""")
def site_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = _site_counts(spark, sf_dir)
    found = novel.with_site_reasons(observed, controls.control_sites(observed))
    return found.groupBy(F.coalesce("reject_reason", F.lit("novel")).alias("reason")).agg(F.count("*").alias("n"))


_NOVEL = f"""{_SITES}, novel AS (SELECT o.sample, o.chr, o.bp_pos, o.bp_id AS id, o.obs, greatest(coalesce(c.sample_count, 0) - 1, 0) AS frequency FROM observed o LEFT JOIN controls c ON c.id = o.bp_id
    WHERE o.obs >= 3 AND mapped >= 2 AND mate_chrs <= 4 AND greatest(coalesce(c.sample_count, 0) - 1, 0) <= 10)"""


@query("merged_samples", f"{_NOVEL} SELECT id, chr, bp_pos, CAST(sum(obs) AS BIGINT) AS obs, count(*) AS samples, min(sample) AS sample, CAST(max(frequency) AS BIGINT) AS frequency FROM novel GROUP BY 1, 2, 3")
def merged_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return novel.merge_samples(novel_breakpoints(spark, sf_dir))


@query("base_quality_sites", f"""{_SITES}, q AS (SELECT sample, chr, bp_pos, unnest(CASE WHEN side = 'start' THEN list_slice(quals, greatest({_LEAD} - 15, 0) + 1, greatest({_LEAD} - 15, 0) + least({_LEAD}, 15)) ELSE list_slice(quals, len(quals) - {_TAIL} + 1, len(quals) - {_TAIL} + least({_TAIL}, 15)) END) AS q FROM quiet),
    g AS (SELECT sample, chr, bp_pos FROM q GROUP BY 1, 2, 3 HAVING quantile_cont(q, 0.5) >= 28.5) SELECT sample, chr, bp_pos, obs FROM observed SEMI JOIN g USING (sample, chr, bp_pos)""")
def base_quality_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quiet(spark, sf_dir, "quals")
    return novel.good_quality(reads.site_counts(rows), reads.clip_qualities(rows), novel.NovelParams(min_median_quality=28.5)).select("sample", "chr", "bp_pos", "obs")


_HOMO = "(CASE WHEN length({0}) > 0 THEN list_max(list_transform(['A', 'C', 'G', 'T', 'N'], lambda b: length({0}) - length(replace(upper({0}), b, '')))) / length({0}) ELSE 0 END > 0.8 OR (length({1}) = 5 AND replace({1}, left({1}, 1), '') = ''))"
_FLANKS = f"""{_SITES.replace("WITH ", "WITH " + REFERENCE_SQL + ", ", 1)}, genome AS (SELECT chr, string_agg(bases, '' ORDER BY bin) AS g FROM ref_seq GROUP BY chr),
    site AS (SELECT bp_id AS id, chr, bp_pos AS pos, CAST(sum(start_clips) AS BIGINT) AS start_clips FROM observed GROUP BY 1, 2, 3),
    flank AS (SELECT id, chr, pos, start_clips, substr(g, pos - 14, 15) AS before, substr(g, pos + 1, 15) AS after FROM site JOIN genome USING (chr)),
    sided AS (SELECT *, CASE WHEN start_clips > 0 THEN before ELSE after END AS opposing, CASE WHEN start_clips > 0 THEN after ELSE before END AS same_side FROM flank)"""


def _flanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads.observations(_quiet(spark, sf_dir)).groupBy(F.col("bp_id").alias("id"), "chr", F.col("bp_pos").alias("pos")).agg(F.sum("start_clips").alias("start_clips"))
    return novel.oriented(novel.flanks(rows, projection.reference(spark, sf_dir)))


@query("reference_flanks", f"{_FLANKS} SELECT id, opposing, same_side FROM sided")
def reference_flanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flanked(spark, sf_dir).select("id", "opposing", "same_side")


@query("reference_filters", f"""{_FLANKS} SELECT id, CASE WHEN {_HOMO.format("same_side", "right(same_side, 5)")} OR {_HOMO.format("opposing", "left(opposing, 5)")} THEN 'homopolymer' WHEN opposing LIKE '%NNN' OR same_side LIKE 'NNN%' THEN 'unknown_bases' ELSE 'kept' END AS reason FROM sided""")
def reference_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flanked(spark, sf_dir).select("id", F.coalesce(novel.reference_reason(), F.lit("kept")).alias("reason"))


#: Partners of the sites in ``pt`` (id, chr, bases, opposing, score): pairs, then each site's choice (rk, picked).
_PAIR_SQL = """pc AS (SELECT * FROM pt WHERE score > 10 AND length(bases) >= 14),
    pq AS (SELECT id, chr, 'plain' AS orientation, left(bases, 14) AS seq FROM pc UNION ALL SELECT id, chr, 'reversed', left(reverse(bases), 14) FROM pc UNION ALL SELECT id, chr, 'complement', left(reverse(translate(bases, 'ACGTN', 'TGCAN')), 14) FROM pc),
    tg AS (SELECT DISTINCT id, chr, seq FROM (SELECT id, chr, left(opposing, 14) AS seq FROM pt UNION ALL SELECT id, chr, left(reverse(opposing), 14) FROM pt) WHERE length(seq) = 14),
    nr AS (SELECT a.seq, b.seq AS other, levenshtein(a.seq, b.seq) AS cost FROM (SELECT DISTINCT seq FROM pq) a JOIN (SELECT DISTINCT seq FROM tg) b ON levenshtein(a.seq, b.seq) <= 2),
    rare AS (SELECT nr.seq FROM nr JOIN tg ON tg.seq = nr.other GROUP BY nr.seq HAVING count(*) <= 7),
    pairs AS (SELECT pq.id, pq.chr, pq.orientation, tg.id AS partner, tg.chr AS partner_chr, min(nr.cost) AS cost FROM pq JOIN nr USING (seq) JOIN rare USING (seq) JOIN tg ON tg.seq = nr.other WHERE pq.id <> tg.id GROUP BY 1, 2, 3, 4, 5)"""
_CHOICE_SQL = """one AS (SELECT id, chr, partner, partner_chr, min(cost) AS cost FROM pairs GROUP BY 1, 2, 3, 4),
    ch AS (SELECT * FROM one QUALIFY rank() OVER (PARTITION BY id ORDER BY cost) = 1),
    rk AS (SELECT a.*, CASE WHEN b.id IS NULL THEN 1 ELSE 0 END AS one_way FROM ch a LEFT JOIN ch b ON b.id = a.partner AND b.partner = a.id),
    picked AS (SELECT id, partner, CAST(cost AS INT) AS cost FROM rk QUALIFY row_number() OVER (PARTITION BY id ORDER BY one_way, chr <> partner_chr, abs(partner - id), partner) = 1)"""
_PARTNER_SITES = f"""{_SITES}, p AS (
    SELECT id, chr, pos, CASE WHEN pos < 11000 THEN CASE WHEN pos % 16 >= 5 THEN (pos - 10005) // 16 ELSE (pos - 10000) // 16 END ELSE (pos - 20000) // 100 END AS q FROM controls),
    ps AS (SELECT id, chr, CASE WHEN q % 2 = 0 THEN q - 1 ELSE q + 1 END AS nq, q FROM p),
    pt AS (SELECT id, chr, substr(translate(md5(concat('c', chr, '_', CAST(nq AS STRING))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 15) AS bases, substr(translate(md5(concat('c', chr, '_', CAST(q AS STRING))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 15) AS opposing, 15.0 AS score FROM ps),
    {_PAIR_SQL}"""


def _partner_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped and opposing sequences of control sites as the projection names them, and their partner candidates."""
    pos = F.col("pos")
    near = F.when(pos % 16 >= 5, F.floor((pos - 10_005) / 16)).otherwise(F.floor((pos - 10_000) / 16))
    sites = _controls(spark, sf_dir).withColumn("q", F.when(pos < 11_000, near).otherwise(F.floor((pos - 20_000) / 100)))
    made = lambda q: F.substring(F.translate(F.md5(F.concat(F.lit("c"), "chr", F.lit("_"), q.cast("string"))), "0123456789abcdef", "ACGTACGTACGTACGT"), 1, 15)
    known = sites.select("id", "chr", made(F.when(F.col("q") % 2 == 0, F.col("q") - 1).otherwise(F.col("q") + 1)).alias("bases"), made(F.col("q")).alias("opposing"), F.lit(15.0).alias("score"))
    known = written(known, "sites")
    return partners.candidates(partners.queries(known), partners.targets(known))


@query("partner_pairs", f"{_PARTNER_SITES} SELECT id, orientation, partner, CAST(cost AS INT) AS cost FROM pairs")
def partner_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _partner_pairs(spark, sf_dir).select("id", "orientation", "partner", "cost")


@query("partner_choice", f"{_PARTNER_SITES}, {_CHOICE_SQL} SELECT * FROM picked")
def partner_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partners.choose(_partner_pairs(spark, sf_dir))


# --- intervals ------------------------------------------------------------------------------------------------------------------

_ISLANDS = """(SELECT chr, min(start) AS start, max(stop) AS stop FROM (SELECT *, sum(fresh) OVER (PARTITION BY chr ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT chr, start, stop, CASE WHEN max(stop) OVER (PARTITION BY chr ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start THEN 0 ELSE 1 END AS fresh FROM {}) f) g GROUP BY chr, island)"""
_REDUCED = f"WITH {REGIONS_SQL}, ra AS {_ISLANDS.format('regions_a')}, rb AS {_ISLANDS.format('regions_b')}"


@query("region_reduce", f"{_REDUCED} SELECT chr, start, stop FROM ra")
def region_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.reduce(projection.regions(spark, sf_dir, "a"))


@query("region_coverage", f"""WITH {REGIONS_SQL}, e AS (SELECT chr, pos, sum(d) AS d FROM (SELECT chr, start AS pos, 1 AS d FROM regions_b UNION ALL SELECT chr, stop + 1, -1 FROM regions_b) GROUP BY 1, 2),
    r AS (SELECT chr, pos AS start, lead(pos) OVER w - 1 AS stop, sum(d) OVER w AS depth FROM e WINDOW w AS (PARTITION BY chr ORDER BY pos)) SELECT chr, start, stop, CAST(depth AS BIGINT) AS depth FROM r WHERE depth > 0""")
def region_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.coverage(projection.regions(spark, sf_dir, "b"))


@query("region_intersect", f"{_REDUCED} SELECT ra.chr, greatest(ra.start, rb.start) AS start, least(ra.stop, rb.stop) AS stop FROM ra JOIN rb ON ra.chr = rb.chr AND ra.start <= rb.stop AND ra.stop >= rb.start")
def region_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.intersect(projection.regions(spark, sf_dir, "a"), projection.regions(spark, sf_dir, "b"))


@query("region_subtract", f"""{_REDUCED}, c AS (SELECT ra.chr, ra.start AS a_start, ra.stop AS a_stop, rb.start, rb.stop FROM ra JOIN rb ON ra.chr = rb.chr AND ra.start <= rb.stop AND ra.stop >= rb.start),
    g AS (SELECT chr, coalesce(lag(stop) OVER (PARTITION BY chr, a_start ORDER BY start) + 1, a_start) AS start, start - 1 AS stop FROM c UNION ALL SELECT chr, max(stop) + 1, a_stop FROM c GROUP BY chr, a_start, a_stop)
    SELECT * FROM g WHERE start <= stop UNION ALL SELECT * FROM ra WHERE NOT EXISTS (SELECT 1 FROM rb WHERE ra.chr = rb.chr AND ra.start <= rb.stop AND ra.stop >= rb.start)""")
def region_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.subtract(projection.regions(spark, sf_dir, "a"), projection.regions(spark, sf_dir, "b"))


@query("overlap_counts", f"WITH {REGIONS_SQL} SELECT a.rid, a.chr, a.start, a.stop, count(*) AS overlaps FROM regions_a a JOIN regions_b b ON a.chr = b.chr AND a.start <= b.stop AND a.stop >= b.start GROUP BY 1, 2, 3, 4 HAVING count(*) > 1")
def overlap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlap_counts(projection.regions(spark, sf_dir, "a"), projection.regions(spark, sf_dir, "b"), 1)


@query("regions_without_overlap", f"WITH {REGIONS_SQL} SELECT rid, chr, start, stop FROM regions_a a WHERE NOT EXISTS (SELECT 1 FROM regions_b b WHERE a.chr = b.chr AND a.start <= b.stop AND a.stop >= b.start)")
def regions_without_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlap_join(projection.regions(spark, sf_dir, "a"), projection.regions(spark, sf_dir, "b"), how="left_anti")


@query("reads_in_regions", f"WITH {READS_ORACLE}, {REGIONS_SQL} SELECT read_name, sample FROM reads r WHERE EXISTS (SELECT 1 FROM regions_b b WHERE r.chr = b.chr AND r.aln_start <= b.stop AND r.aln_end >= b.start)")
def reads_in_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = projection.reads(spark, sf_dir).select("sample", "read_name", "file_ord", "chr", "aln_start", "aln_end")
    return intervals.in_regions(rows, projection.regions(spark, sf_dir, "b")).select("read_name", "sample")


@query("nearest_feature", f"""{_SITES.replace("WITH ", "WITH " + EXONS_SQL + ", ", 1)}, d AS (SELECT c.id, e.gene AS name, greatest(e.start - c.pos, c.pos - e.stop, 0) AS distance FROM controls c JOIN exons e ON e.chr = c.chr AND c.pos - 5000 <= e.stop AND c.pos + 5000 >= e.start)
    SELECT id, arg_min(name, (distance, name)) AS name, min(distance) AS distance FROM d GROUP BY id""")
def nearest_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.nearest(_controls(spark, sf_dir).select("id", "chr", "pos"), projection.exons(spark, sf_dir).withColumnRenamed("gene", "name"), 5000)


@query("gene_lookup", f"""WITH {EXONS_SQL}, w AS (SELECT concat('G', CAST(3 * i AS STRING), '_', CAST(1 + i % 9 AS STRING)) AS gene FROM range(1, 20) t(i)), s AS (SELECT gene, chr, min(start) AS start, max(stop) AS stop FROM exons GROUP BY gene, chr)
    SELECT gene, chr, start, stop FROM w LEFT JOIN s USING (gene)""")
def gene_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from splitmark.sources.text import gene_regions

    wanted = spark.range(1, 20).select(F.concat(F.lit("G"), (3 * F.col("id")).cast("string"), F.lit("_"), (1 + F.col("id") % 9).cast("string")).alias("gene"))
    found, missing = gene_regions(wanted, projection.exons(spark, sf_dir))
    return found.select("gene", "chr", "start", "stop").unionByName(missing, allowMissingColumns=True)


@query("extended_regions", f"""WITH {READS_ORACLE}, {REGIONS_SQL}, m AS (SELECT mate_chr AS chr, mate_start AS start, mate_start + length(bases) AS stop FROM reads),
    e AS (SELECT chr, pos, sum(d) AS d FROM (SELECT chr, start AS pos, 1 AS d FROM m UNION ALL SELECT chr, stop + 1, -1 FROM m) GROUP BY 1, 2),
    c AS (SELECT chr, start, stop FROM (SELECT chr, pos AS start, lead(pos) OVER w - 1 AS stop, sum(d) OVER w AS depth FROM e WINDOW w AS (PARTITION BY chr ORDER BY pos)) WHERE depth > 2),
    o AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM regions_b b WHERE c.chr = b.chr AND c.start <= b.stop AND c.stop >= b.start)) SELECT chr, CAST(start AS INT) AS start, CAST(stop AS INT) AS stop FROM {_ISLANDS.format("o")}""")
def extended_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return novel.extended_regions(projection.reads(spark, sf_dir), projection.regions(spark, sf_dir, "b"))


# --- annotation -----------------------------------------------------------------------------------------------------------------

_VARIANTS = "variants AS (SELECT CAST(o_orderkey AS BIGINT) AS vid, CAST(1 + o_custkey % 7 AS INT) AS chr_idx, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 10000 + (o_orderkey % 28) * 16 ELSE 22900 + (o_orderkey % 22) * 100 END AS INT) AS pos, CASE WHEN o_orderkey % 3 = 0 THEN CAST(16 * (o_orderkey % 5) AS INT) END AS svlen FROM orders)"


@query("vcf_band_annotate", f"""{_SITES.replace("WITH ", "WITH " + _VARIANTS + ", ", 1)}, a AS (SELECT vid, chr_idx, 0 AS part, pos AS spot FROM variants UNION ALL SELECT vid, chr_idx, 1, pos + svlen FROM variants WHERE svlen IS NOT NULL),
    k AS (SELECT vid, part, o, coalesce(c.obs, 0) AS obs, coalesce(c.sample_count, 0) AS sc FROM a CROSS JOIN (SELECT unnest(range(-2, 3)) AS o) LEFT JOIN controls c ON c.id = CAST(chr_idx AS BIGINT) * 1000000000 + spot + o)
    SELECT vid, string_agg(CAST(obs AS STRING), ',' ORDER BY part, o) AS obs, CAST(max(obs) AS BIGINT) AS obs_max, string_agg(CAST(sc AS STRING), ',' ORDER BY part, o) AS samples, CAST(max(sc) AS BIGINT) AS samples_max FROM k GROUP BY vid""")
def vcf_band_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.annotate(projection.relation(spark, sf_dir, (_VARIANTS,), "variants"), _controls(spark, sf_dir))


_SUPPORT = f"CASE WHEN ({_LEAD} > 0 AND aln_start = s.pos) OR ({_TAIL} > 0 AND aln_end = s.pos) THEN 'SUPPORT' WHEN aln_start - {_LEAD} <= s.pos AND aln_end + {_TAIL} >= s.pos THEN 'CONTRA' ELSE 'NO_OVERLAP' END AS support"
_NEAR = f"""{_SITES}, site AS (SELECT id, chr, pos FROM controls), near AS (
    SELECT s.id, s.pos, r.*, {_SUPPORT} FROM site s JOIN reads r ON r.chr = s.chr AND r.aln_start <= s.pos + 200 AND r.aln_end >= s.pos - 200)"""
#: Reads mapped as well as their mates, and of those the ones whose reverse read doesn't end behind the forward read's start.
_PAIR = "((flags & 1) <> 0 AND (flags & 12) = 0)"
_MISORIENTED = f"({_PAIR} AND (((flags & 16) <> 0) = ((flags & 32) <> 0) OR NOT CASE WHEN (flags & 16) = 0 THEN insert_size > 0 ELSE mate_start < aln_end END))"
_END_CLIPPED = f"({_LEAD} > 0 OR {_TAIL} > 0)"


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _controls(spark, sf_dir).select("id", "chr", "pos")
    return intervals.around(sites, projection.reads(spark, sf_dir).drop("quals", "bases"), 200)


@query("read_support_features", f"""{_NEAR}, top AS (SELECT id, support, max(n) AS n FROM (SELECT id, support, mate_chr, count(*) AS n FROM near WHERE {_PAIR} AND chr <> mate_chr GROUP BY 1, 2, 3) GROUP BY 1, 2),
    f AS (SELECT id, support, count(*) AS total, count(*) FILTER ((flags & 16) = 0) AS forward, count(*) FILTER ((flags & 16) <> 0) AS reverse, count(*) FILTER ({_PAIR}) AS paired, count(*) FILTER ((flags & 1) <> 0 AND chr <> mate_chr) AS chimeric,
      count(*) FILTER (mapq = 0) AS mapq0, count(*) FILTER (mapq < 10) AS low_mapq, count(DISTINCT CASE WHEN {_PAIR} THEN mate_chr END) AS mate_chrs, count(*) FILTER ({_MISORIENTED}) AS misoriented,
      count(*) FILTER ({_END_CLIPPED}) AS clipped FROM near GROUP BY 1, 2)
    SELECT f.*, coalesce(top.n, 0) AS top_chimeric FROM f LEFT JOIN top USING (id, support)""")
def read_support_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.read_support(_near(spark, sf_dir))


@query("support_table", f"{_NEAR} SELECT id, count(*) FILTER (support = 'SUPPORT') AS SUPPORT, count(*) FILTER (support = 'CONTRA') AS CONTRA, count(*) FILTER (support = 'NO_OVERLAP') AS NO_OVERLAP FROM near GROUP BY id")
def support_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.support_table(_near(spark, sf_dir))


#: Two parts of the insert sizes in ``near``, by site (x).
_SIZES = """c AS (SELECT id, CAST(insert_size AS BIGINT) AS size, count(*) AS c FROM near WHERE (flags & 1) <> 0 AND insert_size > 0 GROUP BY 1, 2),
    r AS (SELECT id, sum(c) OVER up AS n, sum(c * size) OVER up AS s, sum(c * size * size) OVER up AS q, sum(c) OVER a AS n_all, sum(c * size) OVER a AS s_all, sum(c * size * size) OVER a AS q_all
      FROM c WINDOW up AS (PARTITION BY id ORDER BY size ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY id)),
    p AS (SELECT *, CAST(q AS DOUBLE) - CAST(s AS DOUBLE) * s / n AS l, CASE WHEN n < n_all THEN CAST(q_all - q AS DOUBLE) - CAST(s_all - s AS DOUBLE) * (s_all - s) / (n_all - n) ELSE 0 END AS rt, CAST(q_all AS DOUBLE) - CAST(s_all AS DOUBLE) * s_all / n_all AS whole FROM r),
    b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY n = n_all, l + rt, n) = 1),
    v AS (SELECT *, n_all >= 10 AND least(n, n_all - n) >= 4 AS split FROM b),
    x AS (SELECT *, CASE WHEN split THEN sqrt(l / (n - 1) + rt / (n_all - n - 1) + 1) / (sqrt(whole / (n_all - 1)) + 1) ELSE 1 END AS spread FROM v)"""


@query("insert_size_clusters", f"""{_NEAR}, {_SIZES}
    SELECT id, CAST(n_all AS BIGINT) AS n_sizes, round(least(spread, 1 / spread), 6) AS sd_ratio, CASE WHEN split THEN round(abs((s_all - s) / (n_all - n) - s / n), 6) ELSE 0.0 END AS mean_shift FROM x""")
def insert_size_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.insert_size_clusters(_near(spark, sf_dir))


# --- reports --------------------------------------------------------------------------------------------------------------------

_ROWS = f"""{_NOVEL.replace("WITH ", "WITH " + EXONS_SQL + ", ", 1)}, dist AS (SELECT n.sample, n.id, min(greatest(e.start - n.bp_pos, n.bp_pos - e.stop, 0)) AS d FROM novel n JOIN exons e ON e.chr = n.chr AND n.bp_pos - 5000 <= e.stop AND n.bp_pos + 5000 >= e.start GROUP BY 1, 2),
    rows_ AS (SELECT n.sample, n.id, n.chr, n.bp_pos AS pos, n.obs AS depth, CAST(n.frequency + 1 AS BIGINT) AS sample_count, coalesce(d.d, -1) AS cds FROM novel n LEFT JOIN dist d USING (sample, id))"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Novel sites with the distance to the nearest exon, -1 where none is near."""
    found = novel_breakpoints(spark, sf_dir).select("sample", "id", "chr", F.col("bp_pos").alias("pos"), F.col("obs").alias("depth"), "sample_count")
    near = intervals.nearest(found.select("id", "chr", "pos").distinct(), projection.exons(spark, sf_dir).withColumnRenamed("gene", "name"), 5000)
    return found.join(near.select("id", F.col("distance").alias("cds")), "id", "left").fillna(-1, ["cds"])


@query("report_filter", f"{_ROWS} SELECT sample, id, depth, sample_count, cds FROM rows_ WHERE depth > 3 AND sample_count <= 10 AND sample <> 'S1' AND NOT regexp_matches(sample, '^S4') AND cds >= 0 AND cds <= 500")
def report_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("cdsdist", F.array("cds"))
    return report.report_filter(rows, report.ReportParams(proximity="close", excluded=("S1", "~^S4"))).select("sample", "id", "depth", "sample_count", "cds")


@query("distance_class", f"{_ROWS} SELECT CASE WHEN cds < 0 THEN 'none' WHEN cds = 0 THEN 'inside' WHEN cds < 50 THEN 'adjacent' WHEN cds < 500 THEN 'close' ELSE 'far' END AS class, count(*) AS n FROM rows_ GROUP BY 1")
def distance_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).groupBy(G.distance_class(F.col("cds")).alias("class")).agg(F.count("*").alias("n"))


@query("sample_names", f"""{_SITES}, r AS (SELECT o.bp_id AS id, o.sample, row_number() OVER (PARTITION BY o.bp_id ORDER BY o.sample) AS spot FROM observed o JOIN controls c ON c.id = o.bp_id WHERE c.sample_count < 5)
    SELECT id, string_agg(sample, ',' ORDER BY sample) AS samples FROM r WHERE spot <= 5 GROUP BY id""")
def sample_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = _site_counts(spark, sf_dir)
    return report.sample_names(controls.control_sites(observed), observed)


_FOUND = f"""{_SITES.replace("WITH ", "WITH " + EXONS_SQL + ", " + REFERENCE_SQL + ", ", 1)}, {_CONSENSUS[len(_QUIET) + 2 :]},
    q AS (SELECT sample, chr, bp_pos, unnest(CASE WHEN side = 'start' THEN list_slice(quals, greatest({_LEAD} - 15, 0) + 1, greatest({_LEAD} - 15, 0) + least({_LEAD}, 15)) ELSE list_slice(quals, len(quals) - {_TAIL} + 1, len(quals) - {_TAIL} + least({_TAIL}, 15)) END) AS q FROM quiet),
    good AS (SELECT sample, chr, bp_pos FROM q GROUP BY 1, 2, 3 HAVING quantile_cont(q, 0.5) >= 15),
    nov AS (SELECT o.sample, o.chr, o.bp_pos AS pos, o.bp_id AS id, o.obs, o.start_clips, greatest(coalesce(c.sample_count, 0) - 1, 0) AS frequency FROM observed o JOIN good USING (sample, chr, bp_pos) LEFT JOIN controls c ON c.id = o.bp_id
      WHERE o.obs >= 3 AND mapped >= 2 AND mate_chrs <= 4 AND greatest(coalesce(c.sample_count, 0) - 1, 0) <= 10),
    genome AS (SELECT chr, string_agg(bases, '' ORDER BY bin) AS g FROM ref_seq GROUP BY chr),
    sided AS (SELECT n.*, CASE WHEN start_clips > 0 THEN substr(g, pos - 14, 15) ELSE substr(g, pos + 1, 15) END AS opposing, CASE WHEN start_clips > 0 THEN substr(g, pos + 1, 15) ELSE substr(g, pos - 14, 15) END AS same_side FROM nov n JOIN genome USING (chr)),
    kept AS (SELECT s.*, c.bases, c.score FROM sided s JOIN consensus c ON c.sample = s.sample AND c.chr = s.chr AND c.bp_pos = s.pos
      WHERE NOT ({_HOMO.format("same_side", "right(same_side, 5)")} OR {_HOMO.format("opposing", "left(opposing, 5)")}) AND opposing NOT LIKE '%NNN' AND same_side NOT LIKE 'NNN%'),
    pt AS (SELECT id, chr, bases, opposing, score FROM kept QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, sample) = 1), {_PAIR_SQL}, {_CHOICE_SQL},
    spans AS (SELECT gene, chr, min(start) AS start, max(stop) AS stop FROM exons GROUP BY 1, 2),
    met AS (SELECT DISTINCT k.id, k.pos, s.gene, s.chr FROM kept k JOIN spans s ON s.chr = k.chr AND s.start <= k.pos + 5000 AND s.stop >= k.pos - 5000),
    gd AS (SELECT id, m.gene, min(CASE WHEN e.start <= pos + 1 AND e.stop >= pos - 1 THEN 0 ELSE least(abs(e.start - pos), abs(e.stop - pos)) END) AS distance FROM met m JOIN exons e ON e.gene = m.gene AND e.chr = m.chr GROUP BY 1, 2),
    gl AS (SELECT id, string_agg(gene, ',' ORDER BY gene) AS genes, string_agg(CAST(distance AS STRING), ',' ORDER BY gene) AS cdsdist FROM gd GROUP BY id),
    found AS (SELECT k.*, CASE WHEN p.partner IS NULL THEN '' ELSE concat(CAST(p.partner // 1000000000 AS STRING), ':', CAST(p.partner % 1000000000 AS STRING)) END AS partner, coalesce(gl.genes, '') AS genes, coalesce(gl.cdsdist, '') AS cdsdist FROM kept k LEFT JOIN picked p USING (id) LEFT JOIN gl USING (id))"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Novel sites of all samples from their reads to partners and genes; the control table is counted from the same reads."""
    quiet = written(_quiet(spark, sf_dir, "bases", "quals"), "quiet")
    observed = reads.site_counts(quiet).withColumn("bp_id", schema.xpos(F.col("chr_idx"), F.col("bp_pos")))
    return novel.find_breakpoints(quiet, controls.control_sites(observed), projection.reference(spark, sf_dir), projection.exons(spark, sf_dir))


@query("find_breakpoints", f"{_FOUND} SELECT id, sample, obs, CAST(frequency + 1 AS BIGINT) AS sample_count, bases, partner, genes, cdsdist FROM found")
def find_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda c: F.coalesce(F.array_join(F.col(c).cast("array<string>"), ","), F.lit("")).alias(c)
    return _found(spark, sf_dir).select("id", "sample", "obs", "sample_count", "bases", F.coalesce("partner", F.lit("")).alias("partner"), joined("genes"), joined("cdsdist"))


@query("output_table", f"""{_FOUND} SELECT chr, pos AS start, pos + 1 AS end, regexp_extract(sample, '^S(\\d+)$', 1) AS sample, obs AS depth, CAST(frequency + 1 AS BIGINT) AS sample_count, round_even(score / length(bases), 3) AS cscore, partner, genes, cdsdist FROM found""")
def output_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.output_rows(_found(spark, sf_dir), r"S(\d+)")


_FEATURES = {"forward": "(flags & 16) = 0", "reverse": "(flags & 16) <> 0", "lowMapQ": "mapq < 10", "multimapping": "mapq = 0", "nonFROrientation": _MISORIENTED, "softClipped": _END_CLIPPED}
_FEATURE_SQL = ", ".join(
    [f"count(*) FILTER (support = '{kind}' AND {rule}) AS {prefix}_{name}" for prefix, kind in features.PREFIXES.items() for name, rule in _FEATURES.items()]
    + [f"count(DISTINCT CASE WHEN support = '{kind}' AND {_PAIR} THEN mate_chr END) AS {prefix}_numberOfMateChromosomes" for prefix, kind in features.PREFIXES.items()]
)
_FEATURE_ROWS = ", ".join(f"coalesce({p}_{f}, 0) AS {p}_{f}" for p in features.PREFIXES for f in features.SUPPORT_FEATURES)


@query("annotated_breakpoints", f"""{_FOUND}, rows_ AS (SELECT concat(sample, '|', CAST(id AS STRING)) AS id, chr, pos AS start, sample, obs AS depth, CAST(frequency + 1 AS BIGINT) AS sample_count, round_even(score / length(bases), 3) AS cscore, partner, genes, cdsdist FROM found),
    near AS (SELECT s.id, r.*, {_SUPPORT.replace("s.pos", "s.start")} FROM rows_ s JOIN reads r ON r.sample = s.sample AND r.chr = s.chr AND r.aln_start <= s.start + 200 AND r.aln_end >= s.start - 200),
    counted AS (SELECT id, {_FEATURE_SQL} FROM near GROUP BY id), {_SIZES}
    SELECT w.* EXCLUDE (id), {_FEATURE_ROWS}, CASE WHEN x.split THEN round(abs((x.s_all - x.s) / (x.n_all - x.n) - x.s / x.n), 6) ELSE 0.0 END AS insertSizeClusterMeanShift, coalesce(round(least(x.spread, 1 / x.spread), 6), 1.0) AS insertSizeClusterSdRatio
    FROM rows_ w LEFT JOIN counted USING (id) LEFT JOIN x USING (id)""")
def annotated_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(report.output_rows(_found(spark, sf_dir)), "rows")
    return features.annotate_breakpoints(rows, projection.reads(spark, sf_dir).drop("quals", "bases"))


@query("genes_near", f"""{_SITES.replace("WITH ", "WITH " + EXONS_SQL + ", ", 1)}, spans AS (SELECT gene, chr, min(start) AS start, max(stop) AS stop FROM exons GROUP BY 1, 2),
    met AS (SELECT c.id, c.pos, s.gene, s.chr FROM controls c JOIN spans s ON s.chr = c.chr AND s.start <= c.pos + 5000 AND s.stop >= c.pos - 5000),
    gd AS (SELECT id, m.gene, min(CASE WHEN e.start <= pos + 1 AND e.stop >= pos - 1 THEN 0 ELSE least(abs(e.start - pos), abs(e.stop - pos)) END) AS distance FROM met m JOIN exons e ON e.gene = m.gene AND e.chr = m.chr GROUP BY 1, 2)
    SELECT id, string_agg(gene, ',' ORDER BY gene) AS genes, string_agg(CAST(distance AS STRING), ',' ORDER BY gene) AS cdsdist FROM gd GROUP BY id""")
def genes_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intervals.genes_near(_controls(spark, sf_dir), projection.exons(spark, sf_dir))
    return found.select("id", F.array_join("genes", ",").alias("genes"), F.array_join(F.col("cdsdist").cast("array<string>"), ",").alias("cdsdist"))


@query("bed_rows", f"{_NOVEL} SELECT chr, bp_pos - 100 AS start, bp_pos + 100 AS stop, sample FROM novel")
def bed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.bed_rows(novel_breakpoints(spark, sf_dir).withColumnRenamed("bp_pos", "start"))


@query("secondary_sites", f"""{_NOVEL}, p AS (SELECT sample, chr, id, bp_pos AS pos, CASE WHEN obs % 2 = 0 THEN id + 16 END AS partner FROM novel)
    SELECT a.sample, a.id, b.id AS other, coalesce(a.partner = b.id, false) OR coalesce(b.partner = a.id, false) AS linked FROM p a JOIN p b ON a.sample = b.sample AND a.chr = b.chr AND a.pos < b.pos AND b.pos - a.pos <= 1000""")
def secondary_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = novel_breakpoints(spark, sf_dir).select("sample", "chr", "id", F.col("bp_pos").alias("pos"), F.when(F.col("obs") % 2 == 0, F.col("id") + 16).alias("partner"))
    return report.secondary_sites(rows)


@query("site_metadata", f"""{_SITES} SELECT id, coalesce(CASE WHEN pos % 3 = 0 THEN concat('t', CAST(pos % 7 AS STRING)) END, '') AS tag, pos % 3 = 0 AND pos % 2 = 0 AS greyed FROM controls""")
def site_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _controls(spark, sf_dir)
    marks = sites.where("pos % 3 = 0").select("id", F.concat(F.lit("t"), (F.col("pos") % 7).cast("string")).alias("tag"), (F.col("pos") % 2 == 0).alias("greyed"))
    return report.with_metadata(sites.select("id"), marks)


@query("event_sizes", f"""{_NOVEL}, p AS (SELECT sample, id, CASE WHEN obs % 3 > 0 THEN bp_pos + CASE WHEN obs % 3 = 1 THEN 120 ELSE 2400 END END - bp_pos AS size FROM novel) SELECT sample, id, abs(size) AS size, CASE WHEN size IS NULL THEN 'none' WHEN abs(size) > 1000 THEN 'large' ELSE 'small' END AS text FROM p""")
def event_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = novel_breakpoints(spark, sf_dir)
    partner = F.when(F.col("obs") % 3 > 0, F.concat("chr", F.lit(":"), (F.col("bp_pos") + F.when(F.col("obs") % 3 == 1, 120).otherwise(2400)).cast("string")))
    size = G.event_size(F.col("bp_pos"), partner, F.col("chr"))
    return rows.select("sample", "id", size.alias("size"), G.event_text(size).alias("text"))


@query("clip_depth_by_start", f"{_PLACED} SELECT chr, aln_start AS start, count(*) AS depth FROM placed GROUP BY 1, 2 HAVING count(*) >= 2")
def clip_depth_by_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.clip_depth(_placed(spark, sf_dir).select("chr", F.col("aln_start").alias("start")))


@query("best_per_group", """WITH s AS (SELECT CAST(l_partkey % 500 AS BIGINT) AS id, CAST(l_linenumber AS STRING) AS chr, CAST(l_suppkey * 10 + l_orderkey % 10 AS BIGINT) AS start, CAST(l_extendedprice * 100 AS BIGINT) AS score FROM lineitem),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, chr, start) = 1)
    SELECT *, concat('chr', chr, '_', CAST(row_number() OVER (PARTITION BY chr ORDER BY start, id) - 1 AS STRING)) AS label FROM b""")
def best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("CAST(l_partkey % 500 AS BIGINT) id", "CAST(l_linenumber AS STRING) chr", "CAST(l_suppkey * 10 + l_orderkey % 10 AS BIGINT) start", "CAST(round(l_extendedprice * 100) AS BIGINT) score")
    return report.best_per_group(rows)


_STATS = f"{_REASONED}, stats AS (SELECT sample, chr, count(*) FILTER (reason = 'kept') AS interesting, count(*) FILTER (reason = 'anomalous') AS anomalous, count(*) FILTER (reason = 'low_quality') AS low_quality FROM reasoned GROUP BY 1, 2)"


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads.with_reasons(projection.reads(spark, sf_dir))
    count = lambda r: F.count_if(F.coalesce("reject_reason", F.lit("kept")) == r)
    return rows.groupBy("sample", "chr").agg(count("kept").alias("interesting"), count("anomalous").alias("anomalous"), count("low_quality").alias("low_quality"))


@query("sample_totals", f"{_STATS} SELECT sample, CAST(sum(interesting) AS BIGINT) AS interesting, CAST(sum(anomalous) AS BIGINT) AS anomalous, CAST(sum(low_quality) AS BIGINT) AS low_quality FROM stats GROUP BY sample")
def sample_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sample_totals(_stats(spark, sf_dir).drop("chr"))


@query("sample_stats_median", f"{_STATS}, t AS (SELECT sample, sum(interesting) AS v FROM stats GROUP BY sample) SELECT CAST(quantile_cont(v, 0.5) AS DOUBLE) AS median, count(*) FILTER (v > 500) AS outliers FROM t")
def sample_stats_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sample_totals(_stats(spark, sf_dir).drop("chr")).agg(F.expr("percentile(interesting, 0.5)").alias("median"), F.count_if(F.col("interesting") > 500).alias("outliers"))


@query("sample_histogram", f"{_STATS}, t AS (SELECT sample, CAST(sum(interesting) AS BIGINT) AS v FROM stats GROUP BY sample), e AS (SELECT min(v) AS lo, max(v) AS hi FROM t) SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / 100)), 99) END AS INT) AS bucket, count(*) AS n FROM t, e GROUP BY 1")
def sample_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.histogram(report.sample_totals(_stats(spark, sf_dir).drop("chr")), "interesting")


@query("per_mb_density", f"{_SITES}, n AS (SELECT chr, count(*) AS n FROM controls GROUP BY chr) SELECT chr, n, round(n * 1e6 / (CAST(chr AS INT) * 100000), 6) AS per_mb FROM n")
def per_mb_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = spark.range(1, 8).select(F.col("id").cast("string").alias("chr"), (F.col("id") * 100_000).alias("length"))
    return report.per_megabase(_controls(spark, sf_dir).groupBy("chr").agg(F.count("*").alias("n")), lengths)


@query("sample_sets", f"{_SITES}, listed AS (SELECT concat('S', CAST(i AS STRING)) AS sample FROM range(0, 20) t(i)), s AS (SELECT DISTINCT sample FROM observed) SELECT sample, 'in' AS side FROM s SEMI JOIN listed USING (sample) UNION ALL SELECT sample, 'out' FROM s ANTI JOIN listed USING (sample)")
def sample_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.range(20).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("sample"))
    seen = _site_counts(spark, sf_dir).select("sample").distinct()
    return seen.join(listed, "sample", "left_semi").withColumn("side", F.lit("in")).unionByName(seen.join(listed, "sample", "left_anti").withColumn("side", F.lit("out")))


@query("zipped_lists", "WITH a AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS spot FROM nation), b AS (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS spot FROM region) SELECT n_name, r_name FROM a JOIN b USING (spot)")
def zipped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = spark.read.parquet(f"{sf_dir}/nation.parquet"), spark.read.parquet(f"{sf_dir}/region.parquet")
    return report.zipped(a, b, "n_nationkey", "r_regionkey").select("n_name", "r_name")


@query("report_page", f"{_NOVEL} SELECT chr, bp_pos AS start, sample FROM novel ORDER BY chr, bp_pos, sample LIMIT 15 OFFSET 15")
def report_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.page(novel_breakpoints(spark, sf_dir).select("chr", F.col("bp_pos").alias("start"), "sample"), 1)


@query("contig_names", "WITH c AS (SELECT unnest(['1', 'chr2', 'chrX', 'Y', 'MT', 'GL0001', 'chrUn_1', '22', '23']) AS name) SELECT name, regexp_replace(name, '^chr', '') AS bare, CASE WHEN regexp_matches(regexp_replace(name, '^chr', ''), '^([1-9]|1[0-9]|2[0-2])$') THEN CAST(regexp_replace(name, '^chr', '') AS INT) WHEN regexp_replace(name, '^chr', '') = 'X' THEN 23 WHEN regexp_replace(name, '^chr', '') = 'Y' THEN 24 WHEN regexp_replace(name, '^chr', '') IN ('M', 'MT') THEN 25 END AS idx FROM c")
def contig_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in ("1", "chr2", "chrX", "Y", "MT", "GL0001", "chrUn_1", "22", "23")])).alias("name"))
    return names.select("name", F.regexp_replace("name", "^chr", "").alias("bare"), schema.contig_index(F.col("name")).alias("idx"))
