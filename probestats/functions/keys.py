"""Keys, labels and names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WHITESPACE = " \t\n\r\x0b\x0c"

# Stem endings that mark score and error files.
DERIVED_STEM = r"(_scores)?$"
ERROR_STEM = r"(_mse_per_sample_per_position)?$"


def strip(text: Column) -> Column:
    return F.btrim(text.cast("string"), F.lit(WHITESPACE))


def strip_zeros(text: Column) -> Column:
    """Leading zeros off first, whitespace second."""
    return strip(F.ltrim(text.cast("string"), F.lit("0")))


def dataset_stem(name: Column) -> Column:
    """Dataset name without the ending that score and error files carry."""
    return F.regexp_replace(F.regexp_replace(name, DERIVED_STEM, ""), ERROR_STEM, "")


def case_label(cohort: Column, cases: str = "cases") -> Column:
    return F.when(cohort == cases, 1).otherwise(0)


def feature_name(position: Column, prefix: str = "f") -> Column:
    return F.concat(F.lit(prefix), position.cast("string"))


def block_of(position: Column, size: int) -> Column:
    """Id of the block of ``size`` consecutive positions; the last block may be short."""
    if size < 1:
        raise ValueError("block size must be at least 1")
    return F.floor(position / F.lit(size)).cast("int")


def split_genes(text: Column) -> Column:
    """Gene names out of a ``;`` or ``,`` list; blanks and ``.`` dropped, NULL gives no genes."""
    names = F.transform(F.split(F.replace(text, F.lit(","), F.lit(";")), ";"), strip)
    return F.coalesce(
        F.filter(names, lambda g: (g != "") & (g != ".")),
        F.array().cast("array<string>"),
    )
