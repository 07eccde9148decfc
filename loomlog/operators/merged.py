"""Event families and their decoding: {"<Variant>": {fields}}, or "<Variant>" for one without fields.

A row decodes as a family if its payload has exactly one key, a variant of the family, and every required
field is there with the right JSON type (from_json alone would give nulls for a wrong type). Of several
families the first that decodes wins. A payload is parsed once, whatever the number of families and fields.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.json import NUMBERS


@dataclass(frozen=True)
class Family:
    """variants: name -> {field: double | bigint | string | date}; a field whose type ends in ? may be missing or null."""

    name: str
    variants: dict[str, dict[str, str]] = field(hash=False)


def _field(value: Column, path: str, kind: str) -> Column:
    at = F.try_variant_get(value, path, "variant")
    found = F.coalesce(F.schema_of_variant(at), F.lit("VOID"))
    own = kind.rstrip("?")
    if own == "double":
        good = found.rlike(NUMBERS)
    elif own == "bigint":
        good = found == "BIGINT"
    elif own == "date":
        good = (found == "STRING") & F.try_to_date(F.try_variant_get(value, path, "string"), "yyyy-MM-dd").isNotNull()
    else:
        good = found == "STRING"
    return good | (found == "VOID") if kind.endswith("?") else good


def _parsed(data: Column, f: Callable[[Column], Column]) -> Column:
    """f of struct<data, value (VARIANT), keys> of a payload, made once."""
    once = lambda x, g: F.element_at(F.transform(F.array(x), g), 1)
    return once(data, lambda d: once(F.struct(d.alias("data"), F.try_parse_json(d).alias("value"), F.json_object_keys(d).alias("keys")), f))


def _decodes(x: Column, family: Family) -> Column:
    out = F.lit(False)
    for variant, fields in family.variants.items():
        if not fields:
            out = out | (F.trim(x["data"]) == f'"{variant}"')
            continue
        own = (F.size(x["keys"]) == 1) & (F.get(x["keys"], F.lit(0)) == variant)
        for name, kind in fields.items():
            own = own & _field(x["value"], f'$["{variant}"]["{name}"]', kind)
        out = out | own
    return F.coalesce(out & x["value"].isNotNull(), F.lit(False))


def _family(x: Column, families: list[Family]) -> Column:
    out = F.lit(None).cast("string")
    for family in reversed(families):
        out = F.when(_decodes(x, family), family.name).otherwise(out)
    return out


def _variant(x: Column) -> Column:
    return F.coalesce(F.get(x["keys"], F.lit(0)), F.regexp_extract(x["data"], r'^\s*"(.*)"\s*$', 1))


def valid(data: Column, family: Family) -> Column:
    """Does the payload decode as a variant of `family`."""
    return F.coalesce(_parsed(data, lambda x: _decodes(x, family)), F.lit(False))


def family_of(data: Column, families: list[Family]) -> Column:
    """The name of the first family that decodes the payload, or null."""
    return _parsed(data, lambda x: _family(x, families))


def variant_of(data: Column) -> Column:
    return _parsed(data, _variant)


def payload(data: Column, variant: str, name: str, kind: str) -> Column:
    return F.try_variant_get(F.try_parse_json(data), f'$["{variant}"]["{name}"]', kind)


def decoded(log: DataFrame, families: list[Family], on_undecodable: str = "skip", order: str = "global_position") -> DataFrame:
    """`log` with `event_family` and `event_variant`. What doesn't decode is skipped, or fails the query (error), or ends the log there (truncate)."""
    both = _parsed(F.col("data"), lambda x: F.struct(_family(x, families).alias("family"), _variant(x).alias("variant")))
    # made by a generator, so that the filter on it doesn't make it again
    named = log.select("*", F.explode_outer(F.array(both)).alias("__own")).withColumns({"event_family": F.col("__own.family"), "event_variant": F.col("__own.variant")}).drop("__own")
    if on_undecodable == "skip":
        return named.where("event_family is not null")
    if on_undecodable == "error":
        broken = F.raise_error(F.concat(F.lit("undecodable event "), F.col("id"))).cast("string")
        return named.where(F.coalesce("event_family", broken).isNotNull())  # a filter: it runs whatever columns are read
    first = named.where("event_family is null").agg(F.min(order).alias("__end"))
    return named.crossJoin(F.broadcast(first)).where(F.col("__end").isNull() | (F.col(order) < F.col("__end"))).drop("__end")
