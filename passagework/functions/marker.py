"""A line in a note that says which record took its place, and a digest that still holds with that line taken out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = "superseded_by"


def _from(text: Column, at: Column) -> Column:
    return F.substring(text, at, F.length(text))


def line_end(text: Column) -> Column:
    """How the first line of a text ends, CR LF or LF."""
    return F.when(text.rlike(r"\A[^\n]*\r\n"), "\r\n").otherwise("\n")


def _line(text: Column, record: Column, name: str) -> Column:
    return F.concat(F.lit(name + ": "), record, line_end(text))


def marked(text: Column, record: Column, name: str = NAME) -> Column:
    """The text with the line at the end of its front matter, or in front matter of its own; null stays null."""
    nl, rule = line_end(text), F.lit("---")
    close = F.position(F.concat(nl, rule), text, F.lit(4)) + F.length(nl)
    inside = F.concat(F.substring(text, F.lit(1), close - 1), _line(text, record, name), _from(text, close))
    has = F.startswith(text, F.concat(rule, nl)) & (close > F.length(nl))
    return F.when(has, inside).otherwise(F.concat(rule, nl, _line(text, record, name), rule, nl, text))


def same_but_for_marker(text: Column, record: Column, digest: Column, name: str = NAME) -> Column:
    """Whether a text has the digest (hex SHA-256) once the line of this record, or front matter of that line alone, is taken out.

    A text without the line doesn't match, nor one that was edited elsewhere; null anywhere gives null or false.
    """
    nl, line = line_end(text), _line(text, record, name)
    block = F.concat(F.lit("---"), nl, line, F.lit("---"), nl)
    at = F.position(line, text)
    cut = F.concat(F.substring(text, F.lit(1), at - 1), _from(text, at + F.length(line)))
    is_digest = lambda t: F.sha2(t.cast("binary"), 256) == digest
    return ((at > 0) & is_digest(cut)) | (F.startswith(text, block) & is_digest(_from(text, F.length(block) + 1)))
