"""What grows with the tables: rows that a step makes, and how often it looks at its input."""

import random
from collections import Counter

import pytest

from splitmark import schema
from splitmark.operators import intervals, novel, reads, variants
from splitmark.sources import projection

REGION = "rid long, chr string, start int, stop int"


@pytest.fixture
def pairs_made(monkeypatch):
    """Rows of every interval join from here on."""
    made, join = [], intervals.overlap_join
    monkeypatch.setattr(intervals, "overlap_join", lambda *args, **named: made.append((found := join(*args, **named)).count()) or found)
    return made


def test_overlaps_are_counted_without_pairs(spark, pairs_made):
    a, b = ([(i, "1", 100, 200) for i in range(n)] for n in (300, 200))
    rows = intervals.overlap_counts(spark.createDataFrame(a, REGION), spark.createDataFrame(b, REGION), 1).collect()
    assert [r["overlaps"] for r in rows] == [200] * 300
    assert sum(pairs_made) == 0


@pytest.mark.parametrize("size", [64, 1 << 14])
@pytest.mark.parametrize("least", [0, 3])
def test_overlap_counts_of_odd_regions(spark, size, least):
    """Repeated rows, nulls, empty contigs, and regions that end before they start."""
    rng = random.Random(3)

    def regions(n):
        made = [(i // 2 if rng.random() < 0.3 else i, rng.choice("123"), p := rng.randrange(-300, 2000), p + rng.choice([0, 1, 5, 60, 700, -4, -300])) for i in range(n)]
        return made + made[:5] + [(900, None, 1, 2), (901, "1", None, 5), (902, "2", 5, None), (903, "9", 1, 9)]

    a, b, wanted = regions(60), regions(80), Counter()
    for x in a:
        for y in b:
            if None not in x + y and x[1] == y[1] and x[2] <= y[3] and x[3] >= y[2]:
                wanted[x] += 1
    got = intervals.overlap_counts(spark.createDataFrame(a, REGION), spark.createDataFrame(b, REGION), least, size).collect()
    assert {tuple(r)[:4]: r["overlaps"] for r in got} == {k: n for k, n in wanted.items() if n > least}
    assert len(got) == len({tuple(r)[:4] for r in got})


def scans(df, column):
    """How often the executed plan reads a table that holds ``column``."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum("FileScan" in line and column in line for line in text.splitlines())


def test_coverage_reads_its_regions_once(spark, tmp_path):
    spark.createDataFrame([(1, "1", 5, 9), (2, "1", 7, 20_000)], REGION).write.parquet(str(tmp_path / "r"))
    found = intervals.coverage(spark.read.parquet(str(tmp_path / "r")))
    assert scans(found, "stop") == 0  # once, for the steps that were written
    assert sorted((r["start"], r["stop"], r["depth"]) for r in found.collect()) == [(5, 6, 1), (7, 9, 2), (10, 20_000, 1)]


def read_file(spark, path, *changes):
    read = dict(sample="S", read_name="r", file_ord=0, flags=3, chr="1", chr_idx=1, aln_start=1000, aln_end=1059, mapq=30, cigar="20S60M", bases="C" * 80, quals=[30] * 80, mate_chr="1", mate_chr_idx=1, mate_start=1300, insert_size=400)
    spark.createDataFrame([read | c for c in changes], schema.READS).write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_mates_are_read_once_before_regions_merge(spark, tmp_path):
    rows = read_file(spark, tmp_path / "r", *[{"read_name": str(i)} for i in range(3)])
    found = novel.extended_regions(rows, spark.createDataFrame([], REGION))
    assert scans(found, "mate_start") == 0
    assert [(r["start"], r["stop"]) for r in found.collect()] == [(1300, 1380)]


def test_windows_read_their_reads_once(spark, tmp_path):
    """At a place with several starts the first in the file tells whether it is clipped; of equals the smaller operator."""
    places = {1000: [(2, "80M"), (1, "20S60M")], 2000: [(1, "80M"), (2, "20S60M")], 3000: [(1, "20S60M")], 4000: [(1, "80M"), (1, "20S60M")], 5000: [(1, "20S60M"), (1, "20S60M")], 6000: [(1, "80="), (1, "20S60M")], 7000: [(1, "*"), (1, "20S60M")], 8000: [(None, "80M"), (1, "20S60M")], 9000: [(1, "80X"), (1, "20S60M")]}
    rows = read_file(spark, tmp_path / "r", *[{"aln_start": p, "aln_end": p + 79, "file_ord": order, "cigar": c} for p, held in places.items() for order, c in held])
    found = reads.noise_windows(rows)
    assert scans(found, "aln_start") == 1
    clipped = {r["pos"]: r["clipped_positions"] for r in found.collect()}
    assert {p: clipped[p] for p in places} == {1000: 1, 2000: 0, 3000: 0, 4000: 0, 5000: 1, 6000: 0, 7000: 0, 8000: 0, 9000: 1}
    assert set(clipped) == set(places) | {p + 79 for p in (1000, 2000, 4000, 8000)}


def test_only_lost_pairs_keep_their_bases(spark, tmp_path):
    pairs = [("lost", 65 + 8, 129), ("mapped", 65, 129), ("lone", 65 + 8, 65), ("poor", 65 + 8, 129)]
    rows = read_file(spark, tmp_path / "r", *[{"read_name": name, "flags": f, "quals": [5 if name == "poor" else 30] * 80} for name, *both in pairs for f in both])
    found = reads.unmapped_pairs(rows)
    assert scans(found, "mate_start") == scans(found, "cigar") == scans(found, "quals:array") == 0
    assert [(r["read_name"], r["quals_1"]) for r in found.collect()] == [("lost", "?" * 80)]


def test_projected_qualities_are_those_of_the_text(spark, sf_dir):
    made = projection.reads(spark, sf_dir).select("read_name", "quals")
    text = projection.relation(spark, sf_dir, (projection.READS_SQL,), "reads").selectExpr("read_name", f"{projection.QUALS_SPARK} AS quals")
    assert made.exceptAll(text).count() == text.exceptAll(made).count() == 0
    assert "lambdafunction" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_variants_ask_once_for_each_place(spark):
    """Rows that go into the lookup: one for each end of a variant, whatever the reach."""
    calls = spark.createDataFrame([(i, 1, 1000 + i, 3 if i % 2 else None) for i in range(100)], "vid long, chr_idx int, pos int, svlen int")
    table = spark.createDataFrame([(1_000_001_001, 7, 2), (1_000_001_004, 5, 1)], "id long, obs long, sample_count long")
    found = variants.annotate(calls, table)
    assert {r["vid"]: (r["obs"], r["samples_max"]) for r in found.collect() if r["vid"] in (0, 1, 50)} == {0: ("0,0,0,7,0", 2), 1: ("0,0,7,0,0,0,0,5,0,0", 2), 50: ("0,0,0,0,0", 0)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1
