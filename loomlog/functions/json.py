"""JSON columns: containment, equality, top-level match, causation, and metadata merges. Patterns are literals,
compiled to typed path tests on VARIANT; nothing is parsed in Python per row."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBERS = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def _key(path: str, key: str) -> str:
    return f"{path}[{json.dumps(key, ensure_ascii=False)}]"


def _kind(value: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(value, path, "variant")), F.lit("NONE"))


def _holds(value: Column, path: str, pattern: object) -> Column:
    kind = _kind(value, path)
    if isinstance(pattern, dict):
        out = kind.startswith("OBJECT")
        for key, own in pattern.items():
            out = out & _holds(value, _key(path, key), own)
        return out
    if isinstance(pattern, list):
        items = F.try_variant_get(value, path, "array<variant>")
        out = kind.startswith("ARRAY")
        for own in pattern:
            out = out & F.coalesce(F.exists(items, _item(own)), F.lit(False))
        return out
    if pattern is None:
        return kind == "VOID"
    if isinstance(pattern, bool):
        return (kind == "BOOLEAN") & F.coalesce(F.try_variant_get(value, path, "boolean") == pattern, F.lit(False))
    if isinstance(pattern, int):  # exactly, beyond 2^53 too; 1.0 equals 1
        return kind.rlike(NUMBERS) & F.coalesce(F.try_variant_get(value, path, "decimal(38,0)") == F.lit(str(pattern)).cast("decimal(38,0)"), F.lit(False)) & F.coalesce(F.try_variant_get(value, path, "double") == float(pattern), F.lit(False))
    if isinstance(pattern, float):
        return kind.rlike(NUMBERS) & F.coalesce(F.try_variant_get(value, path, "double") == float(pattern), F.lit(False))
    return (kind == "STRING") & F.coalesce(F.try_variant_get(value, path, "string") == str(pattern), F.lit(False))


def _item(pattern: object):
    return lambda x: _holds(x, "$", pattern)


def contains(column: Column, pattern: object) -> Column:
    """Does the JSON text hold `pattern`: objects key by key, arrays element by element in any order, scalars by type and value."""
    return F.coalesce(_holds(F.try_parse_json(column), "$", pattern), F.lit(False))


def equals(column: Column, value: object) -> Column:
    """Is the JSON text `value`, whatever its spacing and the order of keys."""
    parsed = F.try_parse_json(column)
    return F.coalesce(contains(column, value) & (F.to_json(parsed) == F.to_json(F.parse_json(F.lit(json.dumps(value))))), F.lit(False))


def matches(column: Column, pattern: object) -> Column:
    """Top-level subset for objects, equality otherwise: each key of `pattern` has an equal value."""
    if not isinstance(pattern, dict):
        return equals(column, pattern)
    parsed = F.try_parse_json(column)
    out = _kind(parsed, "$").startswith("OBJECT")
    for key, value in pattern.items():
        own = F.to_json(F.try_variant_get(parsed, _key("$", key), "variant"))
        out = out & F.coalesce(own == F.to_json(F.parse_json(F.lit(json.dumps(value)))), F.lit(False))
    return F.coalesce(out, F.lit(False))


def causation_depth(metadata: Column) -> Column:
    """Depth of the causation block; 0 without one, or if any of its other fields is missing."""
    parsed = F.try_parse_json(metadata)
    whole = F.lit(True)
    for key in ("policy", "event_id", "stream_id", "global_position"):
        whole = whole & F.try_variant_get(parsed, f"$.causation.{key}", "string").isNotNull()
    return F.when(whole, F.coalesce(F.try_variant_get(parsed, "$.causation.depth", "bigint"), F.lit(0))).otherwise(F.lit(0)).cast("bigint")


def causation_stamp(policy: Column, event_id: Column, stream_id: Column, position: Column, depth: Column) -> Column:
    """The block that a dispatch carries: what caused it, one level deeper."""
    return F.to_json(F.struct(F.struct(policy.alias("policy"), event_id.alias("event_id"), stream_id.alias("stream_id"), position.alias("global_position"), (depth + 1).alias("depth")).alias("causation")))


def _parts(column: Column) -> Column:
    return F.from_json(column, "map<string,string>")


def merge_collides(left: Column, right: Column) -> Column:
    """Do two metadata objects share a top-level key (then they can't be merged)."""
    return F.arrays_overlap(F.map_keys(_parts(left)), F.map_keys(_parts(right)))


def merge(left: Column, right: Column) -> Column:
    """The merged object, or null where they collide or one isn't an object."""
    body = lambda x: F.regexp_replace(x, r"^\s*\{|\}\s*$", "")
    both = F.concat_ws(",", F.when(F.length(F.trim(body(left))) > 0, F.trim(body(left))), F.when(F.length(F.trim(body(right))) > 0, F.trim(body(right))))
    objects = _kind(F.try_parse_json(left), "$").startswith("OBJECT") & _kind(F.try_parse_json(right), "$").startswith("OBJECT")
    return F.when(objects & ~F.coalesce(merge_collides(left, right), F.lit(False)), F.concat(F.lit("{"), both, F.lit("}")))
