"""Diagnosis-code operators.

A code is 'ICD10:' + letter (character 7) + a two-digit number (characters 8-9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def code_letter():
    return F.substring("concept_cd", 7, 1)


def code_number():
    """try_cast: a non-numeric number part gives null instead of an error."""
    return F.expr("try_cast(substring(concept_cd, 8, 2) AS INT)")


def in_range(letter: str, lo: int, hi: int):
    return (code_letter() == F.lit(letter)) & code_number().between(lo, hi)


def code_range(claims: DataFrame, letter: str, lo: int, hi: int, diag_type: str | None = None, source_system: str | None = None,
               source_col: str = "sourcesystem_cd") -> DataFrame:
    """Claim rows whose code is in [letter lo, letter hi] (inclusive), optionally one
    diagnosis type (DP main / DAS associated) and one source system."""
    c = claims if source_system is None else claims.where(F.col(source_col) == F.lit(source_system))
    if diag_type is not None:
        c = c.where(F.col("diag_type") == F.lit(diag_type))
    return c.where(in_range(letter, lo, hi)).withColumn("code_number", code_number())


# fixed values of the two-part rule: main diagnosis an injury, associated one self-harm
MAIN_RANGES = [("S", 0, 99), ("T", 0, 98)]
ASSOCIATED_RANGES = [("X", 60, 84)]


def _any_range(ranges):
    cond = None
    for letter, lo, hi in ranges:
        c = in_range(letter, lo, hi)
        cond = c if cond is None else cond | c
    return cond


def code_rule(claims: DataFrame, rule: str = "two_part") -> DataFrame:
    """Stays matching a code rule, with their distinct associated code numbers (A3).

    'two_part': main diagnosis in S00-S99 or T00-T98 and an associated one in X60-X84.
    'single': any diagnosis in X60-X84. One aggregate per stay replaces the semi join of two
    rule sets (U1/U5), so a stay is never repeated."""
    main = (F.col("diag_type") == "DP") & _any_range(MAIN_RANGES)
    assoc_any = _any_range(ASSOCIATED_RANGES)
    if rule == "two_part":
        assoc = (F.col("diag_type") == "DAS") & assoc_any
        g = claims.groupBy("encounter_num").agg(
            F.bool_or(main).alias("_m"),
            F.bool_or(assoc).alias("_a"),
            F.sort_array(F.collect_set(F.when(assoc, code_number()))).alias("number_codes"),
        )
        return g.where(F.col("_m") & F.col("_a")).drop("_m", "_a")
    if rule == "single":
        g = claims.where(assoc_any).groupBy("encounter_num").agg(
            F.sort_array(F.collect_set(code_number())).alias("number_codes")
        )
        return g
    raise ValueError(f"unknown code rule {rule!r}")


def code_set(claims: DataFrame, letter: str, lo: int, hi: int) -> DataFrame:
    """A3: distinct code numbers in a range per stay."""
    return (
        code_range(claims, letter, lo, hi)
        .groupBy("encounter_num")
        .agg(F.sort_array(F.collect_set("code_number")).alias("number_codes"))
    )
