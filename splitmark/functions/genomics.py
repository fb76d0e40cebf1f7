"""Scalar functions over reads and sequences, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from splitmark import schema


def reverse_complement(bases: Column) -> Column:
    return F.reverse(F.translate(bases, "ACGTN", "TGCAN"))


def cigar_ops(cigar: Column) -> Column:
    """``array<struct<len, op>>`` of a CIGAR string."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"\d+[MIDNSHP=X]"), F.lit(0)), lambda t: F.struct(F.left(t, F.char_length(t) - 1).cast("int").alias("len"), F.right(t, F.lit(1)).alias("op")))


def longest_clip(ops: Column) -> Column:
    return F.array_max(F.transform(ops, lambda o: F.when(o["op"] == "S", o["len"]).otherwise(0)))


def matched(ops: Column) -> Column:
    return F.aggregate(ops, F.lit(0), lambda s, o: s + F.when(o["op"] == "M", o["len"]).otherwise(0))


def first_op(ops: Column) -> Column:
    return F.get(ops, F.lit(0))["op"]


def last_op(ops: Column) -> Column:
    return F.get(ops, F.size(ops) - 1)["op"]


def lead_clip(cigar: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(cigar, r"^(\d+)S", 1), F.lit("")).cast("int"), F.lit(0))


def tail_clip(cigar: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(cigar, r"(\d+)S$", 1), F.lit("")).cast("int"), F.lit(0))


def longest_end_clip(cigar: Column) -> Column:
    """The longest soft clip. A CIGAR has them at its ends alone, at most with hard clips beyond."""
    at = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(cigar, pattern, 1), F.lit("")).cast("int"), F.lit(0))
    return F.greatest(at(r"^(?:\d+H)?(\d+)S"), at(r"(\d+)S(?:\d+H)?$"))


def unclipped(start: Column, end: Column, cigar: Column) -> tuple[Column, Column]:
    """(start, end) with the clipped bases laid out."""
    return start - lead_clip(cigar), end + tail_clip(cigar)


def clipped_bases(bases: Column, cigar: Column, side: Column, n: int = 15) -> Column:
    """The last ``n`` clipped bases of a start clip, the first ``n`` of an end clip."""
    lead, tail = lead_clip(cigar), tail_clip(cigar)
    start = F.substring(bases, F.greatest(lead - n, F.lit(0)) + 1, F.least(lead, F.lit(n)))
    end = F.substring(bases, F.char_length(bases) - tail + 1, F.least(tail, F.lit(n)))
    return F.when(side == "start", start).otherwise(end)


def base_shares(bases: Column) -> Column:
    """The share of the commonest base, letter case aside; 0 for an empty sequence."""
    n = F.char_length(bases)
    counts = F.array(*[n - F.char_length(F.replace(F.upper(bases), F.lit(b), F.lit(""))) for b in "ACGTN"])
    return F.when(n > 0, F.array_max(counts) / n).otherwise(0.0)


def is_homopolymer(bases: Column, end: int) -> Column:
    """One base makes up more than 0.8, or the first ``end`` bases (the last, for a negative number) are alike."""
    run = F.left(bases, F.lit(end)) if end > 0 else F.right(bases, F.lit(-end))
    alike = (F.char_length(run) == abs(end)) & (F.replace(run, F.left(run, F.lit(1)), F.lit("")) == "")
    return (base_shares(bases) > 0.8) | alike


def distance_class(distance: Column) -> Column:
    """none, inside, adjacent, close or far, by distance to the nearest coding sequence."""
    return F.when(distance < 0, "none").when(distance == 0, "inside").when(distance < 50, "adjacent").when(distance < 500, "close").otherwise("far")


def event_size(start: Column, partner: Column, chr_name: Column) -> Column:
    """Distance to a partner written ``chr:pos`` on the same contig; null otherwise."""
    parts = F.split(partner, ":")
    return F.when(F.get(parts, F.lit(0)) == chr_name, F.abs(F.get(parts, F.lit(1)).try_cast("int") - start))


def event_text(size: Column) -> Column:
    return F.when(size.isNull(), "none").when(size > 1000, "large").otherwise("small")


def three_decimals(value: Column) -> Column:
    """At most three decimals, halves to even."""
    return F.bround(value, 3)


def direction_code(direction: Column) -> Column:
    return F.when(direction == "REVERSE", "r").when(direction == "FORWARD", "f")


def orientation(flags: str, start: str, end: str, mate_start: str, insert_size: str) -> Column:
    """FR, RF or TANDEM of a pair by its strands; FR where the forward read's first base lies before the reverse read's. A forward read
    tells its mate's by the insert size, so a pair on two contigs (insert size 0) isn't FR there."""
    reverse, mate = schema.flag(schema.REVERSE, flags), schema.flag(schema.MATE_REVERSE, flags)
    forward_first = F.when(~reverse, F.col(start) < F.col(start) + F.col(insert_size)).otherwise(F.col(mate_start) < F.col(end))
    return F.when(reverse == mate, "TANDEM").when(forward_first, "FR").otherwise("RF")


def masked_sample(sample: Column, pattern: str | None) -> Column:
    """The first group of ``pattern`` in a sample's name; the name itself without a pattern."""
    return F.regexp_replace(sample, f"^.*?{pattern}.*$", "$1") if pattern else sample
