"""Predicates and projections over items: trust, scope, text and time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import at, in_effect

SCOPE = ("program", "branch", "year", "semester")
IMPORTANCE = ("LOW", "NORMAL", "HIGH", "CRITICAL")
FIELDS = ("title", "summary", "statement")


def with_state(items: DataFrame, claims: DataFrame) -> DataFrame:
    """Items with ``claim_state`` and ``statement`` of their claim."""
    return items.join(claims.select(F.col("id").alias("claim_id"), F.col("state").alias("claim_state"), "statement"), "claim_id")


def current(items: DataFrame, claims: DataFrame, edges: DataFrame, now: datetime) -> DataFrame:
    """Items of verified claims that are in effect and that no edge supersedes."""
    live = items.filter(in_effect(F.col("effective_from"), F.col("effective_until"), at(now)))
    verified = with_state(live, claims.filter("state = 'VERIFIED'"))
    return verified.join(edges.filter("kind = 'SUPERSEDES'").select(F.col("old_item_id").alias("id")), "id", "left_anti")


def scope_filter(scope: dict[str, object]) -> Column:
    """For each dimension that the user has set, the item has none or the same."""
    test = F.lit(True)
    for name in SCOPE:
        if scope.get(name) is not None:
            test = test & (F.col(name).isNull() | (F.col(name) == F.lit(scope[name])))
    return test


def scopes_match(a: str, b: str) -> Column:
    """Symmetric: in every dimension either side has none, or both are equal. a, b: column prefixes."""
    test = F.lit(True)
    for name in SCOPE:
        x, y = F.col(f"{a}{name}"), F.col(f"{b}{name}")
        test = test & (x.isNull() | y.isNull() | (x == y))
    return F.coalesce(test, F.lit(True))


def specificity(prefix: str = "") -> Column:
    return sum((F.col(f"{prefix}{name}").isNotNull().cast("int") for name in SCOPE), F.lit(0))


def category_filter(categories: list[str] | tuple[str, ...]) -> Column:
    """An empty list filters nothing."""
    return F.col("category").isin(*categories) if categories else F.lit(True)


def any_field_contains(token: str, fields: tuple[str, ...] = FIELDS) -> Column:
    test = F.lit(False)
    for f in fields:
        test = test | F.coalesce(F.lower(F.col(f)).contains(token), F.lit(False))
    return test


def all_tokens(tokens: list[str] | tuple[str, ...], fields: tuple[str, ...] = FIELDS) -> Column:
    test = F.lit(True)
    for t in tokens:
        test = test & any_field_contains(t.lower(), fields)
    return test


def any_token(tokens: list[str] | tuple[str, ...], most: int = 12, fields: tuple[str, ...] = FIELDS) -> Column:
    """One of the first ``most`` words; words after them are not searched."""
    test = F.lit(False)
    for t in tokens[:most]:
        test = test | any_field_contains(t.lower(), fields)
    return test


def importance_rank(column: str = "importance") -> Column:
    """LOW 0 to CRITICAL 3."""
    return F.array_position(F.array(*[F.lit(x) for x in IMPORTANCE]), F.col(column)) - 1


def importance_order(text_order: bool = False) -> Column:
    """By rank; ``text_order`` compares the names, as systems without an ordinal do."""
    return F.col("importance").desc() if text_order else importance_rank().desc()


def check_columns(df: DataFrame, names: list[str]) -> None:
    """Updates may name existing columns only."""
    if unknown := sorted(set(names) - set(df.columns)):
        raise ValueError(f"unknown columns: {unknown}")
