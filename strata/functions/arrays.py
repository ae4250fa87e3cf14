"""Array-valued column functions for score vectors (JVM higher-order functions).

Catalyst does not hoist an expression that a lambda mentions but does not
depend on (e.g. ``array_max(z)`` inside ``transform(z, x -> exp(x - ...))``);
it re-evaluates it for every element, which makes a softmax O(C^2) per row.
Such per-row values are passed in with ``array_repeat(value, n)`` and
``zip_with`` instead, so they are evaluated once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def spread_each(value, like) -> Column:
    """``value`` repeated once per element of ``like`` (evaluated once)."""
    return F.array_repeat(_c(value), F.size(_c(like)))


def softmax(z) -> Column:
    """Max-shifted softmax of an ARRAY<DOUBLE>, O(C) per row."""
    z = _c(z)
    e = F.zip_with(z, spread_each(F.array_max(z), z), lambda x, m: F.exp(x - m))
    total = F.aggregate(e, F.lit(0.0), lambda a, y: a + y)
    return F.zip_with(e, spread_each(total, z), lambda x, s: x / s)


def one_hot(label, num_classes: int) -> Column:
    """1 at the label's position, 0 elsewhere."""
    return F.zip_with(F.sequence(F.lit(0), F.lit(num_classes - 1)), F.array_repeat(_c(label), num_classes),
                      lambda c, y: (c == y).cast("int"))


def argmax(z) -> Column:
    """Index of the first maximum (lowest class on ties)."""
    z = _c(z)
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def at(arr, idx) -> Column:
    """0-based element access."""
    return F.element_at(_c(arr), _c(idx) + 1)


def attention_mask(length, max_len: int) -> Column:
    """1 for the first ``length`` positions of ``max_len``."""
    length = _c(length)
    return F.transform(F.sequence(F.lit(1), F.lit(max_len)), lambda i: (i <= length).cast("int"))
