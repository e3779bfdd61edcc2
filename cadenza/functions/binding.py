"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x computed once.

    What a lambda refers to from outside is computed again for every element, so anything but a plain column has to be bound first.
    """
    return F.transform(F.array(x), f)[0]
