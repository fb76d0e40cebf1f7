"""Mixing sources to target weights by soft membership, with DataFrame functions alone.

A classifier learned from a labelled table gives every document a posterior over domains. A document of n tokens then adds n times its
posterior to the domains' expected totals, and nonnegative rates are sought whose expected totals meet the targets: least squares
over relative errors, solved by projected gradient steps with momentum. A step needs one distributed sum per domain; a document's rate
follows from its posterior and the list of steps, so rates are never shuffled or joined.

Posteriors of a document add up to 1, so with errors relative to natural totals the gradient's Lipschitz constant is 1, and so is the step.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitmark.llm.common import hash_sample
from splitmark.session import written


#: Steps after which the state is written, so that a step's cost doesn't grow with the steps before it. Between them the narrow table is
#: kept in memory or on disk; an executor's part that is lost is read again from the written one.
WRITE_EVERY = 8


@dataclass(frozen=True)
class MixParams:
    most: int = 2000  # labelled documents of each domain that are learned from, as expected
    domains: int = 64  # more are refused
    buckets: int = 4096  # of hashed words
    evidence: float = 60.0  # words that a document's mean log odds count for
    weights: dict[str, float] = field(default_factory=dict)  # target share by domain; domains without one share what is left
    boosts: dict[str, float] | None = None  # instead of weights: target as a multiple of the natural total
    floor: float = 0.0  # smallest rate; 1 keeps every document
    steps: int = 40
    tolerance: float = 5e-4  # largest relative error of a total


def words_of(text: Column) -> Column:
    """Lower-case words; a word that ends in marks counts as its last three characters."""
    split = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.transform(split, lambda w: F.when(F.right(w, F.lit(1)) < "A", F.right(w, F.lit(3))).otherwise(w))


def buckets_of(words: Column, buckets: int) -> Column:
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def domain_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from a table of quality and toxicity marks, such as ``q1t0``; rows with a null are left out."""
    return labels.where("doc_id is not null and quality is not null and toxic is not null").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")).alias("domain"))


@dataclass(frozen=True)
class DomainModel:
    domains: list[str]
    prior: list[float]  # log odds against the first domain
    odds: list[list[float]]  # by domain but the first, of each bucket


def fit_domains(docs: DataFrame, labelled: DataFrame, params: MixParams = MixParams()) -> DomainModel:
    """A multinomial model of hashed words by domain, from a bounded sample of each; what comes to the driver is a count for each domain
    and bucket. An id with several labels counts with its smallest. Every domain is learned; more than ``params.domains`` are an
    error. Without labels there is one domain, ``all``."""
    one = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    counts = {r["domain"]: r["n"] for r in one.groupBy("domain").agg(F.count("*").alias("n")).limit(params.domains + 1).collect()}
    if len(counts) > params.domains:
        raise ValueError(f"more than {params.domains} domains")
    if not counts:
        return DomainModel(["all"], [0.0], [])
    picked = hash_sample(one, "domain", counts, params.most)
    seen = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("domain", F.explode(buckets_of(words_of(F.col("text")), params.buckets)).alias("bucket"))
    domains, total = sorted(counts, key=lambda d: (-counts[d], d)), sum(counts.values())
    table = {d: [0.5] * params.buckets for d in domains}
    for row in seen.groupBy("domain", "bucket").agg(F.count("*").alias("n")).collect():
        table[row["domain"]][row["bucket"]] += row["n"]
    sums = {d: sum(table[d]) for d in domains}
    logs = {d: [math.log(n / sums[d]) for n in table[d]] for d in domains}
    return DomainModel(domains, [math.log(counts[d] / total) - math.log(counts[domains[0]] / total) for d in domains], [[round(a - b, 4) for a, b in zip(logs[d], logs[domains[0]], strict=True)] for d in domains[1:]])


def _summed(buckets: str, table: Column) -> Column:
    return F.aggregate(buckets, F.lit(0.0), lambda s, b: s + F.get(table, b))


def with_posteriors(docs: DataFrame, model: DomainModel, params: MixParams) -> DataFrame:
    """(mix_row: all columns of ``docs``, mix_tokens: words, mix_posterior); a text without words gets the prior.

    The row is a struct, so names in ``docs`` can't clash with those used here.
    """
    hashed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row")).withColumn("mix_words", buckets_of(words_of(F.col("mix_row.text")), params.buckets))
    n = F.size("mix_words")
    share = F.lit(params.evidence) / F.greatest(n, F.lit(1))
    scores = [F.lit(0.0)]
    for prior, odds in zip(model.prior[1:], model.odds, strict=True):
        scores.append(F.lit(prior) + share * _summed("mix_words", F.lit(odds)))
    scored = hashed.select("mix_row", n.cast("bigint").alias("mix_tokens"), F.array(*scores).alias("mix_score"))
    scored = scored.withColumn("mix_most", F.array_max("mix_score"))
    scored = scored.select("mix_row", "mix_tokens", F.transform("mix_score", lambda s: F.exp(s - F.col("mix_most"))).alias("mix_raw"))
    total = F.aggregate("mix_raw", F.lit(0.0), lambda s, v: s + v)
    return scored.select("mix_row", "mix_tokens", F.transform("mix_raw", lambda v: v / total).alias("mix_posterior"))


def _state(history: list[tuple[list[float], float]], start: Column, floor: float) -> Column:
    """(x, y) after the steps: the rate, and the point ahead of it where the next gradient is taken."""
    if not history:
        return start
    steps = F.array(*[F.struct(F.array(*[F.lit(g) for g in gradient]).alias("g"), F.lit(beta).alias("b")) for gradient, beta in history])

    def move(state: Column, step: Column) -> Column:
        pull = F.aggregate(F.zip_with("mix_posterior", step["g"], lambda p, g: p * g), F.lit(0.0), lambda s, v: s + v)
        x = F.greatest(F.lit(floor), state["y"] - pull)
        return F.struct(x.alias("x"), (x + step["b"] * (x - state["x"])).alias("y"))

    return F.aggregate(steps, start, move)


def _totals(table: DataFrame, rate: Column, k: int) -> list[float]:
    sums = table.agg(*[F.sum(F.col("mix_tokens") * F.get("mix_posterior", F.lit(i)) * rate).alias(f"t{i}") for i in range(k)]).first()
    return [float(v or 0.0) for v in sums]


@dataclass(frozen=True)
class Mixture:
    domains: list[str]
    natural: list[float]
    targets: list[float]
    reached: list[float]
    rate: Column

    def error(self) -> float:
        """The largest miss of a target, as a share of its domain's natural total."""
        return max((abs(r - t) / n for r, t, n in zip(self.reached, self.targets, self.natural, strict=True) if n > 0), default=0.0)


def fit_rates(table: DataFrame, domains: list[str], params: MixParams) -> Mixture:
    """Rates for a table with ``mix_tokens`` and ``mix_posterior``. Only one sum for each domain comes to the driver in a step.

    Targets that can't be met (no document leans to a domain, or the floor is in the way) are met as nearly as least squares has
    it. Domains without any mass are left out of the error.
    """
    k = len(domains)
    natural, rows = _totals(table, F.lit(1.0), k), table.count()
    if params.boosts is not None:
        targets = [n * params.boosts.get(d, 1.0) for d, n in zip(domains, natural, strict=True)]
    else:
        given = {d: w for d, w in params.weights.items() if d in domains}
        rest = [d for d in domains if d not in given]
        shares = {**given, **{d: max(0.0, 1 - sum(given.values())) / len(rest) for d in rest}} if rest else given
        scale = sum(natural) / (sum(shares.values()) or 1.0)
        targets = [shares[d] * scale for d in domains]
    start = F.struct(F.lit(max(1.0, params.floor)).alias("x"), F.lit(max(1.0, params.floor)).alias("y"))
    history: list[tuple[list[float], float]] = []
    recent, held, at, errors = [], table.select("mix_tokens", "mix_posterior").persist(StorageLevel.MEMORY_AND_DISK), start, []
    for step in range(params.steps):
        reached = _totals(held, _state(recent, at, params.floor)["y"], k)
        gradient = [(y - t) / n if n > 0 else 0.0 for y, t, n in zip(reached, targets, natural, strict=True)]
        errors.append(max(map(abs, gradient)))
        if errors[-1] < params.tolerance or (step >= 10 and min(errors[-5:]) > 0.99 * min(errors[:-5])):
            break
        history.append((gradient, step / (step + 3)))
        recent.append(history[-1])
        if len(recent) == WRITE_EVERY:
            moved = written(held.select("mix_tokens", "mix_posterior", _state(recent, at, params.floor).alias("mix_state")), "rates", rows).persist(StorageLevel.MEMORY_AND_DISK)
            held.unpersist()
            held, recent, at = moved, [], F.col("mix_state")
    reached = _totals(held, _state(recent, at, params.floor)["x"], k)
    held.unpersist()
    return Mixture(domains, natural, targets, reached, _state(history, start, params.floor)["x"])


def copies(rate: Column, key: Column) -> Column:
    """Whole copies with the rate as expectation: its floor, and one more where a hash of the id falls below the rest. Rows without an id
    are told apart by their place in the table; rows that share an id round alike."""
    uniform = F.pmod(F.xxhash64(F.coalesce(key, F.monotonically_increasing_id()), F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (uniform < rate - F.floor(rate)).cast("int")).cast("bigint")


def mix(docs: DataFrame, labelled: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """One row per row of ``docs``: doc_id, tokens, domain (likeliest), posterior, rate, copies, target_error.

    ``target_error`` is the same in every row: by how much, at most, a domain's expected total misses its target under these rates, as a
    share of the domain's natural total. The steps end at ``params.tolerance``, at ``params.steps``, or where they no longer gain.

    Null and empty texts have no tokens and the prior as posterior. Repeated rows count as often as they stand there. An empty table
    gives an empty result.
    """
    model = fit_domains(docs, labelled, params)
    table = with_posteriors(docs.select("doc_id", "text"), model, params)
    table = written(table.select(F.col("mix_row.doc_id").alias("doc_id"), "mix_tokens", "mix_posterior"), "posteriors")
    found = fit_rates(table, model.domains, params)
    likeliest = F.get(F.lit(model.domains), (F.array_position("mix_posterior", F.array_max("mix_posterior")) - 1).cast("int"))
    rated = table.withColumn("mix_rate", found.rate)
    return rated.select("doc_id", F.col("mix_tokens").alias("tokens"), likeliest.alias("domain"), F.col("mix_posterior").alias("posterior"), F.col("mix_rate").alias("rate"), copies(F.col("mix_rate"), F.col("doc_id")).alias("copies"), F.lit(found.error()).alias("target_error"))


def mixed(docs: DataFrame, labelled: DataFrame, params: MixParams) -> DataFrame:
    """Each row of ``docs`` as often as its rate has it, with the columns of ``docs``. Null and empty texts have no tokens and the prior as
    posterior; an empty table stays empty."""
    model = fit_domains(docs, labelled, params)
    table = written(with_posteriors(docs, model, params), "posteriors")
    found = fit_rates(table.select("mix_tokens", "mix_posterior"), model.domains, params)
    counted = table.withColumn("mix_copies", copies(found.rate, F.col("mix_row.doc_id"))).where("mix_copies > 0")
    return counted.withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("mix_copies")))).select("mix_row.*")
