"""Schemas of the tables that the operators read and write, and the contig dictionary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

READS = (
    "sample string, read_name string, file_ord bigint, flags int, chr string, chr_idx int, aln_start int, aln_end int, mapq int, cigar string, "
    "bases string, quals array<int>, mate_chr string, mate_chr_idx int, mate_start int, insert_size int"
)
BREAKPOINT = ("id bigint, chr string, pos int, sample_count int, obs int, ref string")
OBSERVATION = ("bp_id bigint, sample string, obs int, start_clips int, end_clips int, bases string, consensus double")
SAMPLE = ("id string, source string, sex string")
REGIONS = ("chr string, from int, to int, extra string")
EXONS = ("gene string, chr string, from int, to int, strand string")

#: Bits of a read's flags.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECOND, SECONDARY, SUPPLEMENTARY = 1, 2, 4, 8, 16, 32, 64, 128, 256, 2048

#: Contigs that aren't numbers, by index.
LETTERED = {"X": 23, "Y": 24, "M": 25, "MT": 25}
GENOME = 1_000_000_000


def flag(bit: int, flags: str = "flags") -> Column:
    return F.col(flags).bitwiseAND(bit) != 0


def contig_index(chr_name: Column) -> Column:
    """1-22, X, Y and M with or without ``chr``; null for minor contigs."""
    bare = F.regexp_replace(chr_name, "^chr", "")
    named = F.when(bare.rlike("^([1-9]|1[0-9]|2[0-2])$"), bare.try_cast("int"))
    for name, index in LETTERED.items():
        named = named.when(bare == name, F.lit(index))
    return named


def is_major(chr_name: Column) -> Column:
    return contig_index(chr_name).isNotNull()


def xpos(chr_idx: Column, pos: Column) -> Column:
    """One number for a place in the genome."""
    return chr_idx.cast("bigint") * F.lit(GENOME) + pos


def xpos_parts(position: Column) -> tuple[Column, Column]:
    """(contig index, position) of :func:`xpos`."""
    return F.floor(position / F.lit(GENOME)).cast("int"), (position % F.lit(GENOME)).cast("int")
