"""Small hand-made cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitmark import schema
from splitmark.functions import genomics as G
from splitmark.operators import controls, features, intervals, novel, partners, reads, report, variants


def one(spark, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])


def value(spark, column, **columns):
    return one(spark, **columns).select(column.alias("v")).first()["v"]


READ = dict(sample="S", read_name="r", file_ord=0, flags=3, chr="1", chr_idx=1, aln_start=1000, aln_end=1059, mapq=30, cigar="20S60M", bases="C" * 80, quals=[30] * 80, mate_chr="1", mate_chr_idx=1, mate_start=1300, insert_size=400)


def read_table(spark, *changes):
    return spark.createDataFrame([READ | c for c in changes], schema.READS)


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({}, None),
        ({"cigar": "15S65M"}, "unclipped"),
        ({"cigar": "16S64M"}, None),
        ({"cigar": "80M"}, "unclipped"),
        ({"mate_start": 101_060}, "anomalous"),
        ({"mate_start": 101_059}, None),
        ({"quals": [11] * 21 + [30] * 59}, "low_quality"),
        ({"quals": [11] * 20 + [12] * 60}, None),
        ({"mate_start": 1001, "bases": "C" * 30 + "AGATC" + "C" * 45}, "adapter"),
        ({"mate_start": 1001, "bases": "C" * 30 + "GATCT" + "C" * 45}, "adapter"),
        ({"mate_start": 1000, "flags": 9, "bases": "C" * 30 + "AGATC" + "C" * 45}, None),
        ({"cigar": "25S20M35S"}, "contamination"),
        ({"cigar": "25S22M33S"}, None),
        ({"mate_chr": "2"}, None),
    ],
)
def test_read_filter(spark, change, reason):
    assert reads.with_reasons(read_table(spark, change)).first()["reject_reason"] == reason


def test_chimeric_reads_go_only_when_asked(spark):
    row = reads.with_reasons(read_table(spark, {"mate_chr": "2"}), reads.ReadParams(drop_chimeric=True)).first()
    assert row["reject_reason"] == "chimeric"


def test_reads_with_the_same_unclipped_ends_count_once(spark):
    table = read_table(spark, {"file_ord": 2, "read_name": "b"}, {"file_ord": 1, "read_name": "a"}, {"file_ord": 3, "read_name": "c", "cigar": "21S59M"})
    kept = reads.without_duplicates(reads.positions(table)).collect()
    assert sorted(r["read_name"] for r in kept) == ["a", "c"]


@pytest.mark.parametrize(("cigar", "side", "clip"), [("20S4M", "start", "FGHIJKLMNOPQRST"), ("4M20S", "end", "EFGHIJKLMNOPQRS"), ("3S21M", "start", "ABC"), ("21M3S", "end", "VWX")])
def test_clipped_bases(spark, cigar, side, clip):
    assert value(spark, G.clipped_bases(F.col("b"), F.col("c"), F.col("s")), b="ABCDEFGHIJKLMNOPQRSTUVWX", c=cigar, s=side) == clip


def test_flanks_swap_with_start_clips(spark):
    reference = spark.createDataFrame([("1", 0, "AAAAAAAATTTTTTTT")], "chr string, bin int, bases string")
    sites = spark.createDataFrame([("1", 8, 1), ("1", 8, 0)], "chr string, pos int, start_clips int")
    rows = {r["start_clips"]: r for r in novel.oriented(novel.flanks(sites, reference, 8, 16)).collect()}
    assert (rows[0]["opposing"], rows[0]["same_side"]) == ("TTTTTTTT", "AAAAAAAA")
    assert (rows[1]["opposing"], rows[1]["same_side"]) == ("AAAAAAAA", "TTTTTTTT")


def test_merged_sites_add_up(spark):
    observed = spark.createDataFrame([("A", "1", 1, 100, 4, 30), ("B", "1", 1, 100, 7, 20)], "sample string, chr string, chr_idx int, bp_pos int, obs long, max_mapq int")
    row = controls.control_sites(observed).first()
    assert (row["obs"], row["sample_count"], row["id"]) == (11, 2, 1_000_000_100)


def test_sites_without_mapping_quality_go(spark):
    observed = spark.createDataFrame([("A", "1", 1, 100, 9, 0)], "sample string, chr string, chr_idx int, bp_pos int, obs long, max_mapq int")
    assert controls.control_sites(observed).count() == 0


def test_place_round_trip(spark):
    assert value(spark, schema.xpos(F.lit(23), F.lit(31243730))) == 23_031_243_730
    chr_idx, pos = schema.xpos_parts(F.col("x"))
    assert tuple(one(spark, x=23_031_243_730).select(chr_idx, pos).first()) == (23, 31_243_730)


@pytest.mark.parametrize(("bases", "end", "yes"), [("AAAAAAAAAC", 5, True), ("ACGTACGTAC", 5, False), ("AAAAACGTCG", 5, True), ("CGTCGAAAAA", -5, True), ("CGTCGAAAAA", 5, False), ("", 5, False)])
def test_homopolymer(spark, bases, end, yes):
    assert value(spark, G.is_homopolymer(F.col("b"), end), b=bases) is yes


@pytest.mark.parametrize(("distance", "name"), [(-1, "none"), (0, "inside"), (49, "adjacent"), (50, "close"), (499, "close"), (500, "far")])
def test_distance_class(spark, distance, name):
    assert value(spark, G.distance_class(F.col("d")), d=distance) == name


def random_regions(seed, n, span=3000):
    rng = random.Random(seed)
    return [(i, rng.choice("12"), a := rng.randrange(span), a + rng.randrange(60)) for i in range(n)]


SCHEMA = "rid long, chr string, start int, stop int"


def covered(regions):
    return {(c, p) for _, c, a, b in regions for p in range(a, b + 1)}


def of(rows):
    return [(0, r["chr"], r["start"], r["stop"]) for r in rows.collect()]


@pytest.mark.parametrize("size", [64, 1 << 14])
def test_interval_algebra_against_sets_of_positions(spark, size):
    a, b = random_regions(1, 60), random_regions(2, 60)
    left, right = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    merged = of(intervals.reduce(left, size))
    assert covered(merged) == covered(a)
    for x, y in itertools.combinations(merged, 2):
        assert x[1] != y[1] or x[3] < y[2] or y[3] < x[2]
    assert covered(of(intervals.intersect(left, right))) == covered(a) & covered(b)
    assert covered(of(intervals.subtract(left, right))) == covered(a) - covered(b)
    depth = {}
    for r in intervals.coverage(left, size).collect():
        for p in range(r["start"], r["stop"] + 1):
            assert (r["chr"], p) not in depth
            depth[r["chr"], p] = r["depth"]
    wanted = {}
    for _, c, x, y in a:
        for p in range(x, y + 1):
            wanted[c, p] = wanted.get((c, p), 0) + 1
    assert depth == wanted
    pairs = {(r["rid_a"], r["rid_b"]) for r in intervals.overlap_join(left, right, size=size).collect()}
    assert pairs == {(i, j) for i, c, s, e in a for j, d, t, f in b if c == d and s <= f and e >= t}
    alone = {r["rid"] for r in intervals.overlap_join(left, right, size=size, how="left_anti").collect()}
    assert alone == {i for i, *_ in a} - {i for i, _ in pairs}


def test_noise_does_not_depend_on_bins(spark):
    rng = random.Random(5)
    table = read_table(spark, *[{"file_ord": i, "read_name": str(i), "aln_start": (p := rng.randrange(1, 4000)), "aln_end": p + 59, "cigar": rng.choice(["20S60M", "60M20S"])} for i in range(400)])
    small, large = (sorted(map(tuple, reads.noise_windows(table, reads.NoiseParams(max_reads=30, bin=size)).collect())) for size in (512, 1 << 20))
    assert small == large
    assert any(r[-1] for r in small)


@pytest.mark.parametrize("size", [3, 50, 1 << 14])
def test_numbers_along_a_contig_do_not_depend_on_bins(spark, size):
    rng = random.Random(11)
    places = [(c, rng.randrange(0, 400), i) for c in "ab" for i in range(120)]
    got = {(r["c"], r["i"]): r["at"] for r in intervals.numbered(spark.createDataFrame(places, "c string, p int, i int"), ["c"], "p", ("i",), size).collect()}
    wanted = {(c, i): n for name in "ab" for n, (c, _, i) in enumerate(sorted(x for x in places if x[0] == name))}
    assert got == wanted


def test_noisy_runs_and_trailing_clips_against_a_plain_pass(spark):
    rng = random.Random(7)
    marks = {c: [(p, rng.random() < 0.6) for p in sorted(rng.sample(range(60_000), 90))] for c in "12"}
    table = spark.createDataFrame([("S", c, p, noisy) for c, rows in marks.items() for p, noisy in rows], "sample string, chr string, pos int, noisy boolean")
    wanted = []
    for c, rows in marks.items():
        for noisy, run in itertools.groupby(rows, key=lambda r: r[1]):
            run = [p for p, _ in run]
            wanted += [(c, run[0], run[-1], len(run))] if noisy else []
    assert sorted((r["chr"], r["start"], r["stop"], r["places"]) for r in reads.noise_regions(table).collect()) == sorted(wanted)
    starts = [rng.randrange(0, 3000) for _ in range(200)]
    clipped = spark.createDataFrame([("S", "1", p) for p in starts], "sample string, chr string, aln_start int")
    for size in (64, 501, 1 << 16):
        got = {r["pos"]: r["clips"] for r in reads.trailing_clips(clipped, 500, size).collect()}
        assert got == {p: sum(p - 500 <= q <= p for q in starts) for p in starts}


@pytest.mark.parametrize(
    ("start", "end", "cigar", "kind"),
    [
        (100, 159, "20S60M", "SUPPORT"),
        (101, 160, "20S60M", "CONTRA"),
        (99, 158, "20S60M", "CONTRA"),
        (120, 179, "20S60M", "CONTRA"),
        (121, 180, "20S60M", "NO_OVERLAP"),
        (41, 100, "60M20S", "SUPPORT"),
        (21, 80, "60M20S", "CONTRA"),
        (20, 79, "60M20S", "NO_OVERLAP"),
        (100, 179, "80M", "CONTRA"),
        (20, 99, "80M", "NO_OVERLAP"),
        (100, 119, "25S20M35S", "SUPPORT"),
    ],
)
def test_reads_support_a_breakpoint_only_at_their_clip(spark, start, end, cigar, kind):
    assert value(spark, features.support_type("pos"), pos=100, aln_start_b=start, aln_end_b=end, cigar_b=cigar) == kind


@pytest.mark.parametrize(
    ("flags", "start", "end", "mate", "insert", "kind"),
    [(1, 100, 179, 300, 280, "FR"), (33, 100, 179, 300, 280, "FR"), (33, 100, 179, 50, -130, "RF"), (17, 300, 379, 100, -280, "FR"), (17, 100, 179, 300, 280, "RF"), (49, 100, 179, 300, 280, "TANDEM"), (33, 100, 179, 300, 0, "RF")],
)
def test_orientation(spark, flags, start, end, mate, insert, kind):
    got = value(spark, G.orientation("f", "s", "e", "m", "i"), f=flags, s=start, e=end, m=mate, i=insert)
    assert got == (kind if flags & 48 else "TANDEM")


def test_annotated_rows_keep_their_columns_and_count_their_own_reads(spark):
    near = [{"aln_start": 1000, "aln_end": 1059, "cigar": "20S60M", "flags": 33, "insert_size": 300}, {"aln_start": 960, "aln_end": 1039, "cigar": "80M", "flags": 9, "mapq": 0, "read_name": "c"}]
    table = read_table(spark, *near, near[0] | {"sample": "T", "read_name": "t"})
    row = ("1", 1000, "S", 4, 2, 0.99, "", "A", "0")
    columns = "chr string, start int, sample string, depth int, sample_count int, cscore double, partner string, genes string, cdsdist string"
    rows = spark.createDataFrame([row, row, ("2", 1000, "S", *row[3:])], columns)
    found = features.annotate_breakpoints(rows, table).orderBy("chr").collect()
    assert len(found) == 3
    assert found[0] == found[1]
    first, empty = found[0].asDict(), found[2].asDict()
    assert tuple(first[c] for c in features.CORE) == row
    assert (first["sup_forward"], first["sup_softClipped"], first["sup_numberOfMateChromosomes"], first["sup_nonFROrientation"]) == (1, 1, 1, 0)
    assert (first["nsup_forward"], first["nsup_multimapping"], first["nsup_lowMapQ"], first["nsup_numberOfMateChromosomes"]) == (1, 1, 1, 0)
    assert {empty[c] for c in empty if c.startswith(("sup_", "nsup_"))} == {0}
    assert (empty["insertSizeClusterMeanShift"], empty["insertSizeClusterSdRatio"]) == (0.0, 1.0)
    assert features.annotate_breakpoints(rows, table, by=()).orderBy("chr").first()["sup_forward"] == 2


def test_mapping_qualities_add_up_over_samples(spark):
    scores = {"S": [0, 60, 37], "T": [20]}
    table = reads.positions(read_table(spark, *[{"sample": s, "mapq": q, "file_ord": i} for s, qs in scores.items() for i, q in enumerate(qs)]))
    row = controls.mapping_quality(reads.site_counts(table)).first()
    every = [q for qs in scores.values() for q in qs]
    assert (row["reads"], row["min_mapq"], row["max_mapq"]) == (4, 0, 60)
    assert (row["mean_mapq"], row["sd_mapq"]) == (round(float(np.mean(every)), 6), round(float(np.std(every, ddof=1)), 6))


def test_deletion_keys_hold_all_within_two_edits(spark):
    keys = set(value(spark, partners.deletion_keys(F.col("t"), 2), t="ACGTAC"))
    wanted = {"".join(c for i, c in enumerate("ACGTAC") if i not in gone) for n in range(3) for gone in itertools.combinations(range(6), n)}
    assert keys == wanted


def sizes_near(spark, groups):
    return spark.createDataFrame([(i, int(x), 1) for i, sizes in groups.items() for x in sizes], "id_a long, insert_size_b int, flags_b int")


def test_insert_sizes_split_at_the_best_place_of_all(spark):
    rng = np.random.default_rng(3)
    groups = {i: np.concatenate([rng.normal(300, 40, rng.integers(4, 20)), rng.normal(rng.integers(300, 2000), 60, rng.integers(4, 20))]).round() for i in range(12)}
    groups |= {20: groups[0][:9], 21: [300] * 30 + [900] * 2, 22: [250] * 15, 23: [-5, 0] + [100] * 8 + [500] * 8}
    rows = {r["id"]: r for r in features.insert_size_clusters(sizes_near(spark, groups)).collect()}
    for i, sizes in groups.items():
        x = np.sort(np.array([v for v in sizes if v > 0], dtype=np.float64))
        wanted = (1.0, 0.0)
        if len(x) >= 10:
            k = min(range(1, len(x)), key=lambda k: (x[:k].var() * k + x[k:].var() * (len(x) - k)).round(6))
            if min(k, len(x) - k) >= 4:
                ratio = np.sqrt(x[:k].var(ddof=1) + x[k:].var(ddof=1) + 1) / (x.std(ddof=1) + 1)
                wanted = (min(ratio, 1 / ratio), x[k:].mean() - x[:k].mean())
        assert np.allclose((rows[i]["sd_ratio"], rows[i]["mean_shift"]), wanted, atol=1e-5), i
    assert (rows[21]["sd_ratio"], rows[21]["mean_shift"]) == (1.0, 0.0)  # two outliers make no cluster


def test_pairs_carry_their_qualities(spark):
    table = read_table(spark, {"flags": 1 + 64 + 8, "quals": [30] * 79 + [20]}, {"flags": 1 + 128 + 4, "bases": "A" * 79 + "C", "quals": [21] + [30] * 79})
    row = reads.unmapped_pairs(table).first()
    assert row["quals_1"] == "?" * 79 + "5"
    assert row["quals_2"] == "?" * 79 + "6"
    assert row["bases_2"] == "G" + "T" * 79


def test_report_filter(spark):
    rows = spark.createDataFrame([("S1", 5, 2, [10]), ("S2", 5, 2, [900]), ("S3", 3, 2, [0]), ("T4", 9, 11, [0]), ("T5", 9, 10, [-1, 40])], "sample string, depth long, sample_count long, cdsdist array<int>")
    shown = lambda p: sorted(r["sample"] for r in report.report_filter(rows, p).collect())
    assert shown(report.ReportParams()) == ["S1", "S2", "T5"]
    assert shown(report.ReportParams(proximity="adjacent")) == ["S1", "T5"]
    assert shown(report.ReportParams(excluded=("S1", "~^T"))) == ["S2"]


def test_variants_without_controls_get_zeros(spark):
    calls = spark.createDataFrame([(1, 1, 100, None), (2, 1, 200, 50)], "vid long, chr_idx int, pos int, svlen int")
    table = spark.createDataFrame([(1_000_000_101, 5, 3), (1_000_000_250, 2, 1)], "id long, obs long, sample_count long")
    rows = {r["vid"]: r for r in variants.annotate(calls, table).collect()}
    assert (rows[1]["obs"], rows[1]["obs_max"]) == ("0,0,0,5,0", 5)
    assert rows[2]["samples"] == "0,0,0,0,0,0,0,1,0,0"


def test_observations_do_not_depend_on_order(spark):
    rng = random.Random(8)
    changes = [{"file_ord": i, "read_name": str(i), "aln_start": 1000 + rng.randrange(3), "mapq": rng.randrange(60)} for i in range(30)]
    once = sorted(map(str, reads.observations(reads.positions(read_table(spark, *changes))).collect()))
    rng.shuffle(changes)
    assert once == sorted(map(str, reads.observations(reads.positions(read_table(spark, *changes))).collect()))


def test_empty_tables_give_empty_results(spark):
    empty = read_table(spark, {}).where("false")
    assert reads.observations(reads.positions(empty)).count() == 0
    assert reads.noise_windows(empty).count() == 0
    none = spark.createDataFrame([], SCHEMA)
    assert intervals.reduce(none).count() == intervals.coverage(none).count() == 0
