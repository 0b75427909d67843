"""Word expressions in Spark's own functions: lower-cased A-Z, words are runs
of digits, a-z and characters beyond ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is; null gives ''.  Pure ASCII takes
    the byte-wise path."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.char_length(t) == F.octet_length(t), F.lower(t)).otherwise(
        F.translate(t, _UPPER, _UPPER.lower()))


def words(text: Column) -> Column:
    """array<string> of the words of a text; null has none."""
    return F.array_remove(F.split(lowered(text), SEPARATORS), "")
