"""Text keys shared by the operators: comparison by letters and digits only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def letters_digits(c: Column) -> Column:
    """Letters and digits of ``c`` in one case; null stays null.

    Everything but Unicode letters (L*) and numbers (N*) is dropped first, then
    case is folded by upper and lower, so that sharp s meets SS.
    """
    upper = F.upper(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
    return F.lower(F.concat(upper, F.lit("")))  # the optimizer would drop an upper() directly within a lower()
