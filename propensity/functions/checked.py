"""Expressions that carry their run-time errors along instead of failing the job.

A :class:`Checked` is a value and an error text (NULL where all went well), both ordinary
Catalyst expressions: checked rows stay inside whole-stage code, and aggregates of them are
partially aggregated like any other.  Where one of a group's rows failed, the group failed,
with the smallest error text, so the result doesn't depend on the order of rows.

    amount = checked_cast(F.col("amount"), "double")
    rate = checked_divide(checked_sum(amount), checked_count(F.col("clicked")))
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Checked:
    value: Column
    error: Column


def _checked(x: Checked | Column) -> Checked:
    return x if isinstance(x, Checked) else Checked(x, F.lit(None).cast("string"))


def _first_error(*errors: Column) -> Column:
    return F.coalesce(*errors)


def checked_cast(x: Checked | Column, type_: str) -> Checked:
    """``CAST(x AS type)``; a value that has no such form is an error, NULL stays NULL."""
    c = _checked(x)
    value = c.value.try_cast(type_)
    text = F.concat(F.lit("cannot cast '"), c.value.cast("string"), F.lit(f"' to {type_}"))
    return Checked(value, _first_error(c.error, F.when(c.value.isNotNull() & value.isNull(), text)))


def checked_divide(a: Checked | Column, b: Checked | Column) -> Checked:
    """``a / b``; a zero divisor is an error."""
    a, b = _checked(a), _checked(b)
    zero = F.when(a.value.isNotNull() & (b.value == 0), F.lit("division by zero"))
    return Checked(F.try_divide(a.value, b.value), _first_error(a.error, b.error, zero))


def checked_element(x: Checked | Column, index: Column) -> Checked:
    """The element at a position from 0; a position outside the array is an error."""
    c = _checked(x)
    outside = F.when(c.value.isNotNull() & ((index < 0) | (index >= F.size(c.value))),
                     F.concat(F.lit("no element "), index.cast("string")))
    return Checked(F.get(c.value, index), _first_error(c.error, outside))


def checked_sum(x: Checked | Column) -> Checked:
    """Sum over the group; one that overflows is an error."""
    c = _checked(x)
    value = F.try_sum(c.value)
    return Checked(value, _first_error(F.min(c.error), F.when(value.isNull() & (F.count(c.value) > 0), F.lit("sum overflows"))))


def checked_max(x: Checked | Column) -> Checked:
    c = _checked(x)
    return Checked(F.max(c.value), F.min(c.error))


def checked_min(x: Checked | Column) -> Checked:
    c = _checked(x)
    return Checked(F.min(c.value), F.min(c.error))


def checked_count(condition: Checked | Column) -> Checked:
    """Rows of the group for which ``condition`` holds."""
    c = _checked(condition)
    return Checked(F.count_if(c.value), F.min(c.error))
