"""URNs `urn:<namespace>:<id>` and scoped ones `urn:<namespace>:<id>@<scope namespace>:<scope id>` as Column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SHAPE = r"^urn:([^:]+):(.+)$"


def new(value: Column, namespace: str) -> Column:
    """A URN of `namespace` from an id or a URN of it, however often it is wrapped; null for another namespace's."""
    own = f"urn:{namespace}:"
    bare = F.regexp_replace(value, f"^({re.escape(own)})+", "")
    return F.when(value.startswith(own), F.concat(F.lit(own), bare)).when(value.startswith("urn:"), F.lit(None)).otherwise(F.concat(F.lit(own), value))


def new_random(namespace: str) -> Column:
    return F.concat(F.lit(f"urn:{namespace}:"), F.uuid())


def parse(value: Column, namespace: str) -> Column:
    """The value if it is a URN of `namespace`, else null; nothing is unwrapped."""
    return F.when(is_urn(value) & (namespace_of(value) == namespace), value)


def parse_strict(value: Column, namespace: str) -> Column:
    """The same, but a wrong value fails the query with its text."""
    return F.coalesce(parse(value, namespace), F.raise_error(F.concat(F.lit(f"not a URN of {namespace}: "), F.coalesce(value, F.lit("null")))).cast("string"))


def is_urn(value: Column) -> Column:
    """Syntax only, any namespace."""
    return F.coalesce(value.rlike(SHAPE), F.lit(False))


def namespace_of(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, SHAPE, 1), F.lit(""))


def id_of(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, SHAPE, 2), F.lit(""))


def at(value: Column, scope: Column) -> Column:
    """`value` within `scope`; null if either has a scope or is no URN."""
    good = is_urn(value) & is_urn(scope) & ~value.contains("@") & ~scope.contains("@")
    return F.when(good, F.concat(value, F.lit("@"), namespace_of(scope), F.lit(":"), id_of(scope)))


def scope_of(value: Column) -> Column:
    """The scope of a scoped URN as a URN; null if there is none, or if it has no namespace or no id."""
    parts = F.split(id_of(value), "@")
    inner = F.get(parts, F.lit(1))
    whole = inner.rlike("^[^:]+:.+$") & (F.size(parts) == 2) & (F.get(parts, F.lit(0)) != "")
    return F.when(whole, F.concat(F.lit("urn:"), inner))


def kebab(name: Column, acronyms: bool) -> Column:
    """CamelCase to kebab-case; with `acronyms`, a run of capitals is one word (HTTPServer: http-server)."""
    if not acronyms:
        return F.lower(F.regexp_replace(name, "(?<!^)([A-Z])", "-$1"))
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1-$2"), "([a-z0-9])([A-Z])", "$1-$2"))
