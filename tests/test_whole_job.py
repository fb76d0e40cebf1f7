"""Queries read every row of their tables; each case is computed without the query's own SQL."""

from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from splitmark.plans.registry import QUERIES
from splitmark.sources import projection


def test_every_order_is_annotated(spark, sf_dir):
    rows = QUERIES["vcf_band_annotate"](spark, sf_dir).collect()
    orders = duckdb.sql(f"SELECT o_orderkey, o_orderkey % 3 = 0 FROM '{sf_dir}/orders.parquet'").fetchall()
    assert sorted(r["vid"] for r in rows) == sorted(key for key, _ in orders)
    ends = dict(orders)
    assert all(len(r["obs"].split(",")) == len(r["samples"].split(",")) == (10 if ends[r["vid"]] else 5) for r in rows)


def test_mates_of_all_reads_extend_regions(spark, sf_dir):
    steps, existing = defaultdict(Counter), defaultdict(list)
    for r in projection.reads(spark, sf_dir).select("mate_chr", "mate_start", F.length("bases").alias("n")).collect():
        steps[r["mate_chr"]][r["mate_start"]] += 1
        steps[r["mate_chr"]][r["mate_start"] + r["n"] + 1] -= 1
    for r in projection.regions(spark, sf_dir, "b").collect():
        existing[r["chr"]].append((r["start"], r["stop"]))
    wanted = []
    for contig, changes in steps.items():
        depth, places = 0, sorted(changes)
        for start, after in zip(places, places[1:]):
            depth += changes[start]
            if depth > 2 and not any(start <= b and after - 1 >= a for a, b in existing[contig]):
                wanted.append((contig, start, after - 1))
    assert sorted(map(tuple, QUERIES["extended_regions"](spark, sf_dir).select("chr", "start", "stop").collect())) == sorted(wanted)
