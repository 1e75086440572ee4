"""Records of several shapes made one: overrides, fallbacks, results that are a list or an object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def override(base: Column, given: Column, empty_is_none: bool = False) -> Column:
    """A given value goes over the stored one; an empty text may count as not given."""
    return F.coalesce(F.nullif(given, F.lit("")) if empty_is_none else given, base)


def first_field(doc: Column, names: list[str], kind: str, default) -> Column:
    """The first of several field names that a JSON object has."""
    return F.coalesce(*(F.get_json_object(doc, f"$.{n}").try_cast(kind) for n in names), F.lit(default))


def result_items(doc: Column, field: str, item: str) -> Column:
    """Items of a result that is a bare list, {field: list} or {results: {field: list}}; none of these: an empty list."""
    bare = F.from_json(F.when(F.ltrim(doc).startswith("["), doc), f"array<{item}>")
    nested = F.from_json(F.when(F.ltrim(doc).startswith("{"), doc), f"{field} array<{item}>, results struct<{field}:array<{item}>>")
    return F.coalesce(bare, nested[field], nested["results"][field], F.array().cast(f"array<{item}>"))


def query_parameters(params: Column) -> Column:
    """A map of request parameters without null and empty ones."""
    return F.map_filter(params, lambda _, v: v.isNotNull() & (v != ""))


def item_at(items: Column, index: Column) -> Column:
    """An item by its 0-based number; null outside the list."""
    return F.get(items, index)


def scene_context(scenes: DataFrame, params: DataFrame, key: str, columns: list[str], texts: list[str]) -> DataFrame:
    """Scene fields with a request's parameters over them."""
    given = params.select(key, *(F.col(c).alias(f"given_{c}") for c in [*columns, *texts]))
    return scenes.join(given, key, "left").select(key, *(override(F.col(c), F.col(f"given_{c}")).alias(c) for c in columns), *(override(F.col(c), F.col(f"given_{c}"), True).alias(c) for c in texts))
