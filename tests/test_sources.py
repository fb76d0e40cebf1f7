"""Text sources, sinks and the streaming build."""

import json
import random
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from splitmark import sinks
from splitmark.operators import report
from splitmark.sources import text
from splitmark.streaming.sites import absorb, release, streamed_sites

SAM = "@HD\tVN:1.6\n@RG\tID:a\tSM:one\nr1\t99\tchr1\t100\t60\t5S10M\t=\t300\t210\tACGTACGTACGTACG\tIIIIIIIIIIIIIII\tRG:Z:a\nr2\t99\tX\t200\t0\t4M2D6M\tchr2\t50\t0\tACGTACGTAC\t!!!!!!!!!!\n"


def write(tmp_path, name, content):
    path = tmp_path / name
    path.write_text(content)
    return str(path)


def test_sam(spark, tmp_path):
    rows = text.sam(spark, write(tmp_path, "a.sam", SAM)).orderBy("read_name").collect()
    assert [(r["sample"], r["chr"], r["chr_idx"], r["aln_end"], r["mate_chr"]) for r in rows] == [("one", "1", 1, 109, "1"), ("one", "X", 23, 211, "2")]
    assert rows[0]["quals"] == [40] * 15
    assert rows[1]["quals"][0] == 0


def test_several_samples_are_refused(spark, tmp_path):
    path = write(tmp_path, "b.sam", SAM.replace("@RG\tID:a", "@RG\tID:b\tSM:two\n@RG\tID:a"))
    with pytest.raises(ValueError, match="several samples"):
        text.sam(spark, path)
    assert {r["sample"] for r in text.sam(spark, path, multi=True).collect()} == {"one", None}


def test_bed(spark, tmp_path):
    rows = text.bed(spark, write(tmp_path, "a.bed", "track x\nchr1\t99\t200\tS1\n2\t0\t5\n")).orderBy("chr").collect()
    assert [tuple(r) for r in rows] == [("1", 100, 200, "S1"), ("2", 1, 5, None)]


def test_vcf(spark, tmp_path):
    path = write(tmp_path, "a.vcf", "##contig=<ID=chr1,length=1000>\n##contig=<ID=GL01,length=10>\n#CHROM\nchr1\t50\t.\tA\tT\t.\tPASS\tSVLEN=-30;X=1\tGT\t0/1\n")
    assert [tuple(r) for r in text.vcf_contigs(spark, path).collect()] == [("1", 1000)]
    calls = text.vcf(spark, path)
    row = calls.first()
    assert (row["chr"], row["pos"], row["svlen"]) == ("1", 50, -30)
    counts = calls.select("vid", F.lit("1,0").alias("obs"), F.lit(1).alias("obs_max"), F.lit("2,0").alias("samples"), F.lit(2).alias("samples_max"))
    fields = sinks.vcf_lines(calls, counts).first()["value"].split("\t")
    assert fields[7] == "SVLEN=-30;X=1;CONTROL_OBS=1,0;CONTROL_OBS_MAX=1;CONTROL_SC=2,0;CONTROL_SC_MAX=2"
    assert fields[8:] == ["GT", "0/1"]


def test_fasta(spark, tmp_path):
    rows = text.fasta(spark, write(tmp_path, "a.fa", ">chr1 first\nacgt\nACGT\n>2\nTT\n"), 4).orderBy("chr", "bin").collect()
    assert [tuple(r) for r in rows] == [("1", 0, "ACGT"), ("1", 1, "ACGT"), ("2", 0, "TT")]


def test_fasta_does_not_depend_on_blocks(spark, tmp_path):
    draw = random.Random(3)
    genome = {f"c{i}": "".join(draw.choices("acgtN", k=n)) for i, n in enumerate([1, 700, 0, 64, 333, 12])}
    text_of = "".join(f">{name} about\n" + "".join(bases[i : i + 61] + "\n" for i in range(0, len(bases), 61)) for name, bases in genome.items())
    path = write(tmp_path, "b.fa", text_of)
    wanted = {(n, i // 32): b[i : i + 32].upper() for n, b in genome.items() for i in range(0, len(b), 32)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("97", "256", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = text.fasta(spark, path).collect()
            assert len(rows) == len(wanted)
            assert {(r["chr"], r["bin"]): r["bases"] for r in rows} == wanted
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_gene_lists_pedigrees_and_zipped_tables(spark, tmp_path):
    assert [r["gene"] for r in text.gene_list(spark, write(tmp_path, "genes.txt", " A \n\nB\n")).orderBy("gene").collect()] == ["A", "B"]
    rows = text.pedigree(spark, write(tmp_path, "a.ped", "#family\nF1 child dad mum 1 2\nF1\tdad\t0\t0\t1\t1\n")).orderBy("sample").collect()
    assert [tuple(r) for r in rows] == [("F1", "child", "dad", "mum", 1, "2"), ("F1", "dad", None, None, 1, "1")]
    for name, tables in {"one.zip": {"s1.tsv": "sample\tinteresting\tnoisy\nS1\t5\t1\nS1\tx\t2\n", "s2.tsv": "sample\tnoisy\n"}, "two.zip": {"s3.tsv": "noisy\tsample\n7\tS3\n"}}.items():
        with zipfile.ZipFile(tmp_path / name, "w") as archive:
            for member, content in tables.items():
                archive.writestr(member, content)
    found = text.zipped_tsv(spark, str(tmp_path / "*.zip"), "sample string, interesting long, noisy long").orderBy("noisy").collect()
    assert [tuple(r) for r in found] == [("s1.tsv", "S1", 5, 1), ("s1.tsv", "S1", None, 2), ("s3.tsv", "S3", None, 7)]


def test_control_databases_are_found_by_name_pattern_or_folder(spark, tmp_path):
    for name in ("a.db", "b.db", "other"):
        (tmp_path / name).mkdir()
    tails = lambda paths: [p.split("/")[-2] for p in paths]
    assert tails(text.control_paths(spark, [f"{tmp_path}/oth*", f"{tmp_path}/a.db", f"{tmp_path}/a*"])) == ["a.db", "other"]
    assert tails(text.control_paths(spark, folder=str(tmp_path))) == ["a.db", "b.db"]
    with pytest.raises(ValueError, match="no control database"):
        text.control_paths(spark, [f"{tmp_path}/c.db"])
    with pytest.raises(ValueError, match="neither"):
        text.control_paths(spark)
    spark.conf.set("spark.splitmark.databases", str(tmp_path))
    try:
        assert tails(text.control_paths(spark)) == ["a.db", "b.db"]
    finally:
        spark.conf.unset("spark.splitmark.databases")


def test_labels_and_statistics_are_written(spark, tmp_path):
    scores = spark.createDataFrame([(1, "1", 50, 60, 9), (1, "1", 70, 90, 3), (2, "chr1", 20, 40, 4), (3, "1", 90_000, 90_010, 1)], "id long, chr string, start int, stop int, score long")
    best = report.best_per_group(scores)
    sinks.write_labels(best, str(tmp_path / "labels"), str(tmp_path / "places"))
    back = spark.read.option("header", True).csv(str(tmp_path / "labels")).orderBy("node_id").collect()
    assert [tuple(r) for r in back] == [("1", "chr1_0"), ("2", "chr1_0"), ("3", "chr1_1")]
    assert ("chr1", "51", "59", "chr1_0") in [tuple(r) for r in text.tsv(spark, str(tmp_path / "places"), header=False).collect()]
    sinks.write_statistics(spark.createDataFrame([("S", "kept", 4)], "sample string, reason string, n long"), str(tmp_path / "stats"))
    assert tuple(text.tsv(spark, str(tmp_path / "stats")).first()) == ("S", "kept", "4")


def test_genes_and_regions(spark, tmp_path):
    table = text.exons(spark, write(tmp_path, "genes.tsv", "gene\tchr\tstart\tstop\tstrand\nA\tchr1\t10\t20\t+\nA\tchr1\t40\t50\t+\n"))
    found, missing = text.gene_regions(spark.createDataFrame([("A",), ("B",)], "gene string"), table)
    assert [tuple(r) for r in found.select("gene", "chr", "start", "stop").collect()] == [("A", "1", 10, 50)]
    assert [r["gene"] for r in missing.collect()] == ["B"]
    contigs = spark.createDataFrame([("7", 99)], "chr string, length int")
    rows = text.named_regions(spark, ["chr1:1,000-2,000", "chr7", write(tmp_path, "m.bed", "3\t0\t9\n")], contigs).orderBy("chr").collect()
    assert [tuple(r) for r in rows] == [("1", 1000, 2000), ("3", 1, 9), ("7", 1, 99)]
    gene = json.loads(sinks.gene_json(table).first()["json"])
    assert [e["start"] for e in gene["exons"]] == [10, 40]


ROW = ("1", 5, 6, "S", 4, 2, 0.996, "2:77", "A,B", "0,-1")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([ROW], "chr string, start int, end int, sample string, depth int, sample_count int, cscore double, partner string, genes string, cdsdist string")
    sinks.write_tsv(rows, str(tmp_path / "out"))
    back = text.tsv(spark, str(tmp_path / "out"))
    assert tuple(back.columns) == sinks.COLUMNS
    assert back.first()["partner"] == "2:77"
    assert json.loads(sinks.json_rows(rows).first()["json"])["cdsdist"] == [0, -1]
    sinks.write_bed(sinks.bed_rows(rows), str(tmp_path / "bed"))
    assert text.tsv(spark, str(tmp_path / "bed"), header=False).first()["_c1"] == "-95"
    pairs = spark.createDataFrame([("p", "ACG", "IIH", "TTT", "!+I")], "read_name string, bases_1 string, quals_1 string, bases_2 string, quals_2 string")
    sinks.write_fastq(pairs, str(tmp_path / "fq"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "fq/r2")).collect()] == ["@p /2", "TTT", "+", "!+I"]


def test_control_tables_come_back_with_their_number(spark, tmp_path):
    sites = spark.createDataFrame([(1_000_000_005, "1", 5, 2, 9)], "id long, chr string, pos int, sample_count long, obs long")
    seen = spark.createDataFrame([(1_000_000_005, "1", "S", 9)], "bp_id long, chr string, sample string, obs long")
    sinks.write_controls(sites, seen, spark.createDataFrame([("S", "/x", "")], "id string, source string, sex string"), str(tmp_path / "db"))
    table = text.control_tables(spark, [str(tmp_path / "db/breakpoint")] * 2)
    assert sorted(r["db_id"] for r in table.collect()) == [0, 1]


def test_sites_leave_behind_the_slowest_sample():
    state = {"at": {}, "open": {}, "line": -1}

    def released(*rows):
        absorb(state, pd.DataFrame(rows, columns=["sample", "pos", "obs"]))
        return release(state, ["A", "B"])

    assert released(("A", 10, 3), ("A", 20, 1)) == []
    assert released(("B", 10, 4)) == [(10, 2, 7, 4)]
    assert released(("B", 5, 9)) == []
    assert released(("A", 99, 0), ("B", 99, 0)) == [(20, 1, 1, 1)]


def test_streamed_sites(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("1", "A", 10, 3), ("1", "B", 10, 4), ("1", "A", 30, 2), ("1", "B", 40, 1), ("1", "A", 10**9, 0), ("1", "B", 10**9, 0)]
    spark.createDataFrame(rows, "chr string, sample string, pos long, obs long").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("chr string, sample string, pos long, obs long").parquet(source)
    run = streamed_sites(stream, ["A", "B"]).writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "ck")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.table("streamed").collect())) == [("1", 10, 2, 7, 4), ("1", 30, 1, 2, 2), ("1", 40, 1, 1, 1)]
