"""JSON documents held as strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def get(x: Column, path: str) -> Column:
    """The text at a dotted path; null if absent."""
    return F.get_json_object(x, f"$.{path}")


def number(x: Column, path: str) -> Column:
    return get(x, path).try_cast("double")


def has_key(x: Column, key: str) -> Column:
    """Whether the object has the key, even with a null value."""
    return F.array_contains(F.json_object_keys(x), key)


def as_map(x: Column) -> Column:
    """The object's keys with their values as they are: numbers, booleans, nulls and nested values keep their types."""
    return F.from_json(x, "map<string,variant>")


def merged(a: Column, b: Column) -> Column:
    """Both objects' keys, b's values first."""
    left = F.map_filter(as_map(a), lambda k, _: ~F.coalesce(F.map_contains_key(as_map(b), k), F.lit(False)))
    return F.to_json(F.map_concat(left, as_map(b)))


def without(x: Column, key: str) -> Column:
    return F.to_json(F.map_filter(as_map(x), lambda k, _: k != key))


def with_path(x: Column, path: list[str], value: Column, create: bool = True) -> Column:
    """The object with the value (JSON) at a path of keys, as jsonb_set does it: a missing last key is added if `create`;
    where an inner key is missing or no object, the document stays as it is."""
    if not path:
        return value
    key = path[0]

    def put(doc: Column, held: Column) -> Column:
        there = F.coalesce(F.map_contains_key(held, F.lit(key)), F.lit(False))
        with_ = lambda inner: F.to_json(F.map_concat(F.map_filter(held, lambda k, _: k != key), F.create_map(F.lit(key), F.parse_json(inner))))
        if len(path) == 1:
            return with_(value) if create else F.when(there, with_(value)).otherwise(doc)
        below = lambda own: F.when(there & own.startswith("{"), with_(with_path(own, path[1:], value, create))).otherwise(doc)
        return bound(F.to_json(F.try_element_at(held, F.lit(key))), below)

    return bound(x, lambda doc: bound(as_map(doc), lambda held: put(doc, held)))
