"""App metadata: JSON documents to typed rows, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.functions.text import array_to_text
from keysift.model import INT, LIST, METADATA_BLOCKS, METADATA_TOP, STRING

_FIELDS = "map<string,variant>"


def _by_lower_name(document: str) -> str:
    """A JSON object as a map by lower-case key; of keys that differ in case only, the last counts."""
    entries = f"map_entries({document})"
    later = f"slice({entries}, i + 2, size({entries}))"
    last = f"filter({entries}, (e, i) -> not exists({later}, l -> lower(l.key) = lower(e.key)))"
    return f"map_from_entries(transform({last}, e -> struct(lower(e.key), e.value)))"


def _typed(block: str, name: str, kind: str) -> str:
    """The field if it has exactly the wanted JSON type, else the type's zero value."""
    value = f"try_element_at({block}, '{name.lower()}')"
    if kind == STRING:
        return f"if(schema_of_variant({value}) = 'STRING', try_variant_get({value}, '$', 'string'), '')"
    if kind == INT:
        return f"if(schema_of_variant({value}) = 'BIGINT', try_variant_get({value}, '$', 'bigint'), 0L)"
    # Elements of another type count as empty strings.
    item = "if(schema_of_variant(x) = 'STRING', try_variant_get(x, '$', 'string'), '')"
    items = f"transform(try_variant_get({value}, '$', 'array<variant>'), x -> {item})"
    return f"coalesce(if(schema_of_variant({value}) like 'ARRAY%', {items}, null), cast(array() as array<string>))"


def _struct(block: str, fields) -> str:
    return f"named_struct({', '.join(f"'{name}', {_typed(block, name, kind)}" for name, kind in fields)})"


def parse_metadata(documents: DataFrame) -> DataFrame:
    """``documents(app_key, json)`` to ``metadata(app_key, Metadata)``.

    Keys match in any case, unknown keys are dropped, a missing field or one of
    the wrong type is zero-valued and the others are kept, a broken document is
    all zero.
    """
    whole = f"if(try_parse_json(json) is not null, from_json(json, '{_FIELDS}'), null)"
    step = documents.selectExpr("app_key", f"{whole} as document")
    step = step.selectExpr("app_key", f"{_by_lower_name('document')} as top")
    step = step.selectExpr(
        "app_key",
        "top",
        *(f"try_variant_get(top['{block.lower()}'], '$', '{_FIELDS}') as {block}" for block in METADATA_BLOCKS),
    )
    step = step.selectExpr("app_key", "top", *(f"{_by_lower_name(block)} as in_{block}" for block in METADATA_BLOCKS))
    top = [f"'{name}', {_typed('top', name, kind)}" for name, kind in METADATA_TOP]
    nested = [f"'{block}', {_struct(f'in_{block}', fields)}" for block, fields in METADATA_BLOCKS.items()]
    return step.selectExpr("app_key", f"named_struct({', '.join(top + nested)}) as Metadata")


def zero_metadata() -> Column:
    """Metadata of an app that has none."""
    zero = {STRING: "''", INT: "0L", LIST: "cast(array() as array<string>)"}
    top = [f"'{name}', {zero[kind]}" for name, kind in METADATA_TOP]
    blocks = [
        f"'{block}', named_struct({', '.join(f"'{name}', {zero[kind]}" for name, kind in fields)})"
        for block, fields in METADATA_BLOCKS.items()
    ]
    return F.expr(f"named_struct({', '.join(top + blocks)})")


def flat_metadata(metadata: DataFrame, *, arrays_as_text: bool = False) -> DataFrame:
    """One column per field, prefixed by its block (two blocks share a field name)."""

    def out(path: str, name: str, kind: str) -> Column:
        value = F.col(path)
        return (array_to_text(value) if arrays_as_text and kind == LIST else value).alias(name)

    return metadata.select(
        "app_key",
        *(out(f"Metadata.{name}", name, kind) for name, kind in METADATA_TOP),
        *(
            out(f"Metadata.{block}.{name}", f"{block}_{name}", kind)
            for block, fields in METADATA_BLOCKS.items()
            for name, kind in fields
        ),
    )
