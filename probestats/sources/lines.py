"""Lines of delimited text as column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from probestats.functions.keys import WHITESPACE, strip


def split_fields(line: Column, sep: str) -> Column:
    """The fields of a line, trimmed. A field in double quotes may hold separators, and quotes written twice.

    Only lines with a quote pay for looking at quotes.
    """
    outside = re.escape(sep) + r'(?=(?:[^"]*"[^"]*")*[^"]*$)'
    cells = F.when(F.contains(line, F.lit('"')), F.split(line, outside)).otherwise(F.split(line, re.escape(sep)))

    def unquoted(cell: Column) -> Column:
        cell = F.btrim(cell, F.lit(WHITESPACE))
        inner = F.replace(cell.substr(F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))
        return F.when(cell.rlike(r'(?s)^".*"$') & (F.length(cell) > 1), strip(inner)).otherwise(cell)

    return F.transform(cells, unquoted)


def matrix_fields(line: Column, sep: str, names: list[str]) -> Column:
    """The fields of a matrix line under the header ``names``. Missing last fields are NULL; too many raise."""
    cells = split_fields(line, sep)
    message = F.concat(F.lit(f"more than {len(names)} fields: "), F.substring(line, 1, 200))
    return F.when(F.size(cells) > len(names), F.raise_error(message).cast("array<string>")).otherwise(cells)


def gene_set(line: Column) -> tuple[Column, Column]:
    """Term and gene names of a line of term, description and genes, set apart by tabs; empty names dropped."""
    parts = F.split(line, "\t")
    genes = F.filter(F.transform(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), strip), lambda g: g != "")
    return F.element_at(parts, 1), genes
