"""Partners: breakpoints whose clipped sequence reads on in the reference beside another breakpoint.

Two sequences within two edits share a key among those made by deleting up to two letters, so the fuzzy join is an equi-join on such
keys and a bounded edit distance check. Sequences with too many candidates are common ones and take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitmark.functions import genomics as G


@dataclass(frozen=True)
class PartnerParams:
    prefix: int = 14
    max_edits: int = 2
    max_candidates: int = 7
    min_score: float = 10.0


def deletion_keys(text: Column, n: int) -> Column:
    """The text and all texts with up to ``n`` letters deleted."""
    keys = F.array(text)
    for _ in range(n):
        keys = F.array_distinct(F.flatten(F.array(keys, F.flatten(F.transform(keys, _without_one)))))
    return keys


def _without_one(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.char_length(text))))


def queries(sites: DataFrame, params: PartnerParams = PartnerParams()) -> DataFrame:
    """(id, chr, orientation, seq): the clipped consensus as it is, reversed, and reverse-complemented."""
    n = params.prefix
    ways = F.array(*[F.struct(F.lit(name).alias("orientation"), F.left(value, F.lit(n)).alias("seq")) for name, value in (("plain", F.col("bases")), ("reversed", F.reverse("bases")), ("complement", G.reverse_complement(F.col("bases"))))])
    return sites.where((F.col("score") > params.min_score) & (F.char_length("bases") >= n)).select("id", "chr", F.explode(ways).alias("w")).select("id", "chr", "w.orientation", "w.seq")


def targets(sites: DataFrame, params: PartnerParams = PartnerParams()) -> DataFrame:
    """(id, chr, seq): the opposing reference and its reverse."""
    return sites.select("id", "chr", F.explode(F.array(F.left("opposing", F.lit(params.prefix)), F.left(F.reverse("opposing"), F.lit(params.prefix)))).alias("seq")).where(F.char_length("seq") == params.prefix).distinct()


def candidates(query: DataFrame, target: DataFrame, params: PartnerParams = PartnerParams()) -> DataFrame:
    """(id, orientation, partner, cost): pairs of different sites within ``max_edits``, the cheapest of each, common queries left out."""
    keyed = lambda df: df.withColumn("key", F.explode(deletion_keys(F.col("seq"), params.max_edits)))
    left = keyed(query.select("seq").distinct())
    right = keyed(target.select("seq").distinct())
    pairs = left.join(right.withColumnRenamed("seq", "other"), "key").select("seq", "other").distinct()
    near = pairs.withColumn("cost", F.levenshtein("seq", "other")).where(F.col("cost") <= params.max_edits)
    # Candidates of a sequence are counted over sites before any pair of sites is made, so a common sequence never fans out.
    held = target.groupBy("seq").agg(F.count("*").alias("n")).withColumnRenamed("seq", "other")
    rare = near.join(held, "other").groupBy("seq").agg(F.sum("n").alias("n")).where(F.col("n") <= params.max_candidates).select("seq")
    kept = near.join(rare, "seq")
    full = query.join(kept, "seq").join(target.select(F.col("id").alias("partner"), F.col("chr").alias("partner_chr"), F.col("seq").alias("other")), "other").where("id <> partner")
    return full.groupBy("id", "chr", "orientation", "partner", "partner_chr").agg(F.min("cost").alias("cost"))


def choose(found: DataFrame) -> DataFrame:
    """(id, partner, cost): of each site's cheapest candidates the one that also has the site among its cheapest, then the nearest
    on the same contig, then the smallest."""
    one = found.groupBy("id", "chr", "partner", "partner_chr").agg(F.min("cost").alias("cost"))
    cheapest = one.withColumn("at", F.rank().over(Window.partitionBy("id").orderBy("cost"))).where("at = 1").drop("at")
    back = cheapest.select(F.col("partner").alias("id"), F.col("id").alias("partner"), F.lit(0).alias("one_way"))
    ranked = cheapest.join(back, ["id", "partner"], "left")
    order = F.struct(F.coalesce("one_way", F.lit(1)).alias("one_way"), (F.col("chr") != F.col("partner_chr")).cast("int").alias("elsewhere"), F.abs(F.col("partner") - F.col("id")).alias("far"), F.col("partner"), F.col("cost"))
    return ranked.groupBy("id").agg(F.min(order).alias("m")).select("id", "m.partner", "m.cost")
