"""Documents as text: schema on read for JSON, and codecs.

A reader's schema decides: unknown fields are ignored, a missing field gets its
default. A field whose default isn't null and that may itself be null keeps an
explicit null, so presence is asked of the text. Malformed text is an error, as is
a missing field without default that is declared required.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal(value: Any, kind: T.DataType) -> Column:
    """A constant of any JSON-like value."""
    import json

    if isinstance(value, list | dict):
        return F.from_json(F.lit(json.dumps(value)), kind)
    return F.lit(value).cast(kind)


def filled(doc: Column, schema: T.StructType, present: Callable[[str], Column], defaults: Mapping[str, Any], required: Sequence[str] = ()) -> Column:
    """The struct doc with defaults where a field isn't there, and an error where a required one isn't."""
    fields = []
    for f in schema.fields:
        c = doc[f.name]
        if f.name in defaults and defaults[f.name] is not None:
            d = literal(defaults[f.name], f.dataType)
            c = F.when(present(f.name), c).otherwise(d) if f.nullable else F.coalesce(c, d)
        elif f.name in required:
            c = F.when(present(f.name), c).otherwise(F.raise_error(F.lit(f"required field {f.name} is missing")).cast(f.dataType))
        fields.append(c.alias(f.name))
    return F.struct(*fields)


def decode_json(text: Column, schema: T.StructType, defaults: Mapping[str, Any] | None = None, required: Sequence[str] = ()) -> Column:
    """A struct of schema from a JSON text; null from null."""
    open_ = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
    doc = F.from_json(text, open_, {"mode": "FAILFAST"})
    there = F.json_object_keys(text)
    return F.when(text.isNotNull(), filled(doc, schema, lambda n: F.coalesce(F.array_contains(there, n), F.lit(False)), defaults or {}, required))


def encode_json(doc: Column, keep_nulls: bool = True) -> Column:
    """JSON text of a struct; nulls are written, so that they differ from missing fields."""
    return F.to_json(doc, {"ignoreNullFields": "false" if keep_nulls else "true"})


@dataclass(frozen=True)
class Codec:
    """How a document becomes text and is read again, as Columns."""

    encode: Callable[[Column], Column]
    decode: Callable[[Column, T.StructType], Column]


def json_codec(defaults: Mapping[str, Any] | None = None, required: Sequence[str] = ()) -> Codec:
    return Codec(encode_json, lambda text, schema: decode_json(text, schema, defaults, required))


CSV = Codec(lambda doc: F.to_csv(doc), lambda text, schema: F.from_csv(text, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)))
