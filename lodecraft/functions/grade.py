"""Grade-school problems: worked solutions that end in ``#### value``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the mark before the result, which ends at a comma ("1,234" gives 1).
VALUE = r"####\s*(-?\d+\.?\d*)"


def solution(answer: Column) -> Column:
    return F.trim(F.substring_index(answer, "####", 1))


def value(answer: Column) -> Column:
    """The number after the mark as a double; null if there is none."""
    return F.nullif(F.regexp_extract(answer, VALUE, 1), F.lit("")).cast("double")
