"""Rule cascades as columns: the first failing rule names the row's code."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` computed once: a bound name instead of a repeated expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_failure(rules: Iterable[tuple[Column, str] | Column]) -> Column:
    """Code of the first rule whose condition is true, else NULL.

    A rule is (condition, code) or a column that already is a code or NULL. A condition
    that is NULL has not failed: unknown is never a violation.
    """
    picks = [
        rule if isinstance(rule, Column) else F.when(rule[0], F.lit(rule[1])) for rule in rules
    ]
    return F.coalesce(*picks) if len(picks) > 1 else picks[0]


def notes(entries: Iterable[tuple[Column, str | Column]]) -> Column:
    """Every statement whose condition is true, in the given order."""
    return F.array_compact(
        F.array(*[
            F.when(condition, text if isinstance(text, Column) else F.lit(text))
            for condition, text in entries
        ])
    )


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """A small constant mapping as one expression; NULL for a key it lacks."""
    pairs: list[Column] = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), key)
