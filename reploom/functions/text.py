"""Scalar text rules shared by readers and operators, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that str.strip() removes.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Spellings of the productive flag.
TRUE_WORDS = ("t", "true", "1", "yes")
FALSE_WORDS = ("f", "false", "0", "no")

#: Letters of any script and the three marks; at least one letter.
SEQUENCE_PATTERN = r"^[*.\-]*\p{L}[\p{L}*.\-]*$"


def strip(c: Column) -> Column:
    """Without outer blanks of any kind; null stays null."""
    return F.btrim(c, F.lit(BLANKS))


def is_sequence(c: Column) -> Column:
    """Well-formed residues after stripping; null gives null."""
    return strip(c).rlike(SEQUENCE_PATTERN)


def is_productive(c: Column) -> Column:
    """True for the affirmative spellings; blank, null and unknown words are not productive."""
    return F.coalesce(F.lower(strip(c)).isin(*TRUE_WORDS), F.lit(False))


def is_flag(c: Column) -> Column:
    """A truth value or an empty field; null gives null."""
    return F.lower(strip(c)).isin("", *TRUE_WORDS, *FALSE_WORDS)


def as_flag(c: Column) -> Column:
    """BOOLEAN of a valid flag; empty, unknown and null give null."""
    low = F.lower(strip(c))
    return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)


def parse_count(c: Column) -> Column:
    """Abundance of a text field: integral numbers (3, 3.0) as BIGINT, anything else and values below 1 as 1."""
    n = c.try_cast("decimal(38,6)")
    return F.when(n == F.floor(n), F.greatest(n.try_cast("bigint"), F.lit(1))).otherwise(F.lit(1)).cast("bigint")


def alphabet_of(sample: Column) -> Column:
    """Aggregate: nucleotide, amino_acid or ambiguous (nothing but gap marks and blanks) for all text of a group, from counts of letters.

    Case does not count; nucleotide needs codes of bases only, and plain bases for at least 65 % of them. Null text counts nothing.
    """
    known = F.regexp_replace(F.upper(sample), r"[-.*_ \t]", "")
    letters = F.coalesce(F.sum(F.length(known)), F.lit(0))
    odd = F.coalesce(F.sum(F.length(F.regexp_replace(known, "[ACGTUNRYSWKMBDHV]", ""))), F.lit(0))
    plain = F.coalesce(F.sum(F.length(F.regexp_replace(known, "[^ACGTUN]", ""))), F.lit(0))
    return F.when(letters == 0, "ambiguous").when((odd == 0) & (plain >= 0.65 * letters), "nucleotide").otherwise("amino_acid")
