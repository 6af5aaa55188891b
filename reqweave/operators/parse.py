"""Model replies (JSON text) to requirement records, in two dialects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = "struct<code: string, description: string>"
DIALECTS = ("strict", "lenient")


def _type(v: str) -> str:
    return f"coalesce(schema_of_variant({v}), 'VOID')"


def _text(v: str, field: str) -> str:
    """A field of a variant object as text; null if it is missing or null."""
    return f"try_variant_get({v}, '$.{field}', 'string')"


def _is_text(v: str, field: str) -> str:
    return f"{_type(f'try_variant_get({v}, ' + chr(39) + '$.' + field + chr(39) + ', ' + chr(39) + 'variant' + chr(39) + ')')} in ('STRING', 'VOID')"


def _is_object(v: str) -> str:
    return f"{_type(v)} like 'OBJECT%'"


def _is_array(v: str) -> str:
    return f"{_type(v)} like 'ARRAY%'"


def _record(v: str) -> str:
    return f"named_struct('code', {_text(v, 'code')}, 'description', {_text(v, 'description')})"


def parse_strict(raw: Column | str) -> tuple[Column, Column]:
    """(items, error) of a reply column.

    An array; an object with ``requirements`` (looked for first) or ``requirement`` (one item); or an object with both ``code`` and
    ``description``. Other JSON has no items. Malformed JSON is an error, and so is a reply with any
    item that is no object or has a code or description that is neither text nor null. A null reply has no items.
    """
    c = raw if isinstance(raw, str) else "_raw"
    v = f"try_parse_json({c})"
    keys = f"coalesce(json_object_keys({c}), array())"
    under = lambda k: f"try_variant_get({v}, '$.{k}', 'variant')"
    listed = lambda x: f"variant_get({x}, '$', 'array<variant>')"
    items = f"""CASE
        WHEN {_is_array(v)} THEN {listed(v)}
        WHEN NOT {_is_object(v)} THEN cast(array() AS array<variant>)
        WHEN array_contains({keys}, 'requirements') THEN
            CASE WHEN {_is_array(under('requirements'))} THEN {listed(under('requirements'))} ELSE array({under('requirements')}) END
        WHEN array_contains({keys}, 'requirement') THEN array({under('requirement')})
        WHEN array_contains({keys}, 'code') AND array_contains({keys}, 'description') THEN array({v})
        ELSE cast(array() AS array<variant>) END"""
    wrong = f"exists({items}, x -> NOT {_is_object('x')} OR NOT {_is_text('x', 'code')} OR NOT {_is_text('x', 'description')})"
    not_list = f"""{_is_object(v)} AND array_contains({keys}, 'requirements') AND NOT {_is_array(under('requirements'))}"""
    error = f"{c} IS NOT NULL AND ({v} IS NULL OR coalesce({not_list}, false) OR coalesce({wrong}, false))"
    found = f"CASE WHEN {c} IS NULL OR {error} THEN cast(array() AS array<{ITEM}>) ELSE transform({items}, x -> {_record('x')}) END"
    return F.expr(found), F.expr(error)


def parse_lenient(raw: str) -> tuple[Column, Column]:
    """(items, error): an array, or an object with ``root``; items that are no objects or have neither field are skipped.

    Any other reply has no items. Only malformed JSON is an error.
    """
    v = f"try_parse_json({raw})"
    root = f"try_variant_get({v}, '$.root', 'variant')"
    items = f"""CASE
        WHEN {_is_array(v)} THEN variant_get({v}, '$', 'array<variant>')
        WHEN {_is_object(v)} AND {_is_array(root)} THEN variant_get({root}, '$', 'array<variant>')
        ELSE cast(array() AS array<variant>) END"""
    told = lambda f: f"coalesce({_text('x', f)}, '') <> ''"
    fits = f"{_is_object('x')} AND {_is_text('x', 'code')} AND {_is_text('x', 'description')} AND ({told('code')} OR {told('description')})"
    error = f"{raw} IS NOT NULL AND {v} IS NULL"
    found = f"CASE WHEN {v} IS NULL THEN cast(array() AS array<{ITEM}>) ELSE transform(filter({items}, x -> {fits}), x -> {_record('x')}) END"
    return F.expr(found), F.expr(error)


def parse_responses(responses: DataFrame, dialect: str = "strict", column: str = "response") -> DataFrame:
    """``responses`` with the columns items and parse_error."""
    if dialect not in DIALECTS:
        raise ValueError(f"dialect: one of {DIALECTS}")
    rows = responses.withColumn("_raw", F.col(column))
    items, error = (parse_strict if dialect == "strict" else parse_lenient)("_raw")
    return rows.withColumns({"items": items, "parse_error": error}).drop("_raw")


def explode_items(parsed: DataFrame, *keys: str) -> DataFrame:
    """A row per requirement: the keys, item_no from 0, code and description."""
    return parsed.select(*keys, F.posexplode("items").alias("item_no", "i")).select(
        *keys, F.col("item_no").cast("long").alias("item_no"), "i.code", "i.description"
    )
