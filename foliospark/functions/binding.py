"""Binding a value that an expression uses more than once, and marking places in a text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once a row, even where a lambda reads it for each of its elements."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


MARK, _ESCAPE = "\x01", "\x02"


def escaped(x: Column) -> Column:
    """The text without MARK, which may then cut it; `unescaped` gives it back."""
    return F.replace(F.replace(x, F.lit(_ESCAPE), F.lit(_ESCAPE + "b")), F.lit(MARK), F.lit(_ESCAPE + "a"))


def unescaped(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit(_ESCAPE + "a"), F.lit(MARK)), F.lit(_ESCAPE + "b"), F.lit(_ESCAPE))
