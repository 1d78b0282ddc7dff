"""The contract of exported reports: one declaration, from which reading and checking are made.

A schema says per field its type, whether it is required, its default and its
bounds, over any nesting.  ``violations`` turns it into one expression over a
parsed document (a VARIANT, so that absent, null and mistyped fields differ),
``read`` into a typed column with the defaults filled in.  Documents that break
the contract are kept beside what is wrong with them.

As in the reference's model, further fields are ignored, whole numbers and
numerals pass as numbers, and a null stands for an absent field only where the
contract allows null.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUIRED = object()


@dataclass(frozen=True)
class Text:
    default: object = REQUIRED
    choices: tuple[str, ...] = ()
    filled: bool = False
    sql = "string"


@dataclass(frozen=True)
class Whole:
    default: object = REQUIRED
    sql = "bigint"


@dataclass(frozen=True)
class Number:
    default: object = REQUIRED
    low: float | None = None
    high: float | None = None
    sql = "double"


@dataclass(frozen=True)
class Numbers:
    """Numbers by name."""

    default: object = None
    sql = "map<string,double>"


@dataclass(frozen=True)
class Anything:
    """Any object or null; read as its JSON text."""

    default: object = None
    sql = "string"


@dataclass(frozen=True)
class Each:
    """A list; an absent one is empty."""

    item: object
    default: object = None

    @property
    def sql(self) -> str:
        return f"array<{self.item.sql}>"


@dataclass(frozen=True)
class Record:
    fields: dict
    #: REQUIRED, or None: absent and null are null, or "filled": absent is a record of defaults.
    default: object = REQUIRED

    @property
    def sql(self) -> str:
        return "struct<" + ",".join(f"{n}:{f.sql}" for n, f in self.fields.items()) + ">"


def _share(default: object = REQUIRED) -> Number:
    return Number(default, 0.0, 1.0)


# What the contract allows.
BUG_TYPES = ("ui", "functional", "crash", "validation", "navigation", "state_inconsistency", "rendering", "performance", "workflow", "unknown")
GROUNDINGS = ("observed", "inferred", "assumed")
BASES = ("visible_convention", "ui_text", "narration", "assumed")

# Fields, types, defaults and bounds of the contract.
EVIDENCE = Record({"frame_id": Text(""), "t_start_ms": Whole(), "t_end_ms": Whole(), "note": Text("")})
STEP = Record(
    {
        "key": Text(),
        "index": Whole(),
        "text": Text(filled=True),
        "action_type": Text("unknown"),
        "grounding": Text("inferred", GROUNDINGS),
        "confidence": _share(0.5),
        "uncertainty_note": Text(""),
        "evidence": Each(EVIDENCE),
        "screen_state": Text(""),
        "compressed_from": Anything(),
    }
)
REPORT = Record(
    {
        "schema_version": Text("1.0", ("1.0",)),
        "title": Text(),
        "summary": Text(""),
        "bug_type": Text("unknown", BUG_TYPES),
        "preconditions": Each(Record({"text": Text(), "grounding": Text("assumed", GROUNDINGS), "confidence": Number(0.5)})),
        "environment": Record({**{n: Text("unknown" if n == "device_class" else "") for n in ("os", "browser", "app", "device_class", "resolution", "locale", "theme")}, "field_confidence": Numbers()}, "filled"),
        "steps": Each(STEP),
        "observed_result": Record({"text": Text(), "evidence": Each(EVIDENCE), "confidence": _share(0.5)}),
        "expected_result": Record({"text": Text(), "basis": Text("assumed", BASES), "confidence": _share(0.3)}, None),
        "bug_manifestation": Record({"t_ms": Whole(), "evidence": Each(EVIDENCE), "confidence": Number(0.5)}, None),
        "alternate_interpretations": Each(Text()),
        "ambiguity_notes": Each(Text()),
        "omitted_activity": Each(Record({"t_start_ms": Whole(), "t_end_ms": Whole(), "reason": Text()})),
        "overall_confidence": _share(0.5),
        "confidence_breakdown": Record({"actions": Number(0.5), "ocr": Number(0.5), "bug_localization": Number(0.5), "expected_result": Number(0.0), "coverage": Number(0.5)}, "filled"),
    }
)

FOUND = "array<struct<path:string,rule:string>>"


# --- checks -----------------------------------------------------------------


def _broken(bad: Column, path: Column, rule: str) -> Column:
    """One violation, or none."""
    return F.when(bad, F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule")))).otherwise(F.array().cast(FOUND))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _number(value: Column) -> Column:
    """The number that a document's value stands for: itself, a numeral, true or false; else null."""
    return F.when(_kind(value).startswith("OBJECT") | _kind(value).startswith("ARRAY"), None).otherwise(F.try_variant_get(value, "$", "double"))


def _member(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _members(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _absent(value: Column, field: object) -> tuple[Column, Column]:
    """(nothing to check further, and whether that breaks the contract)."""
    null = F.is_variant_null(value)
    if field.default is REQUIRED:
        return value.isNull() | null, value.isNull() | null
    may_be_null = isinstance(field, (Anything, Record)) and field.default is None
    return value.isNull() | null, F.lit(False) if may_be_null else value.isNotNull() & null


def check(value: Column, field: object, path: Column) -> Column:
    """All violations of one value, as an array; ``path`` names it."""
    gone, broken = _absent(value, field)
    required = _broken(F.coalesce(broken, F.lit(False)), path, "required" if field.default is REQUIRED else "must not be null")
    return F.when(F.coalesce(gone, F.lit(True)), required).otherwise(_rules(value, field, path))


def _rules(value: Column, field: object, path: Column) -> Column:
    kind = _kind(value)
    if isinstance(field, Text):
        text = F.try_variant_get(value, "$", "string")
        rules = _broken(F.lit(False), path, "")
        if field.choices:
            rules = _broken(~text.isin(*field.choices), path, "unknown value")
        elif field.filled:
            # Blank as the reference's strip() sees it: all white space, also beyond ASCII.
            rules = _broken(text.rlike(r"^[\s\p{Z}\x1c-\x1f\x85]*$"), path, "must not be empty")
        return F.when(kind != "STRING", _broken(F.lit(True), path, "not a text")).otherwise(rules)
    if isinstance(field, Whole):
        n = _number(value)
        return _broken(F.coalesce(n != F.floor(n), F.lit(True)), path, "not a whole number")
    if isinstance(field, Number):
        n = _number(value)
        outside = F.lit(False)
        if field.low is not None:
            outside = ~n.between(field.low, field.high)
        return F.when(n.isNull(), _broken(F.lit(True), path, "not a number")).otherwise(_broken(outside, path, f"outside of {field.low or 0:g} to {field.high or 0:g}"))
    if isinstance(field, Anything):
        return _broken(~kind.startswith("OBJECT"), path, "not an object")
    if isinstance(field, Numbers):
        named = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
        each = F.flatten(F.transform(named, lambda e: _broken(_number(e["value"]).isNull(), F.concat(path, F.lit("."), e["key"]), "not a number")))
        return F.when(~kind.startswith("OBJECT"), _broken(F.lit(True), path, "not an object")).otherwise(each)
    if isinstance(field, Each):
        each = F.flatten(F.transform(_members(value), lambda v, i: check(v, field.item, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        return F.when(~kind.startswith("ARRAY"), _broken(F.lit(True), path, "not a list")).otherwise(each)
    inside = F.concat(*[check(_member(value, n), f, F.concat(F.when(path == "", "").otherwise(F.concat(path, F.lit("."))), F.lit(n))) for n, f in field.fields.items()])
    return F.when(~kind.startswith("OBJECT"), _broken(F.lit(True), path, "not an object")).otherwise(inside)


# --- typed values -----------------------------------------------------------


def _literal(field: object) -> Column:
    """The default of a field, typed."""
    if isinstance(field, Record) and field.default == "filled":
        return F.struct(*[_literal(f).alias(n) for n, f in field.fields.items()])
    if isinstance(field, Each):
        return F.array().cast(field.sql)
    if isinstance(field, Numbers):
        return F.create_map().cast(field.sql)
    return F.lit(None if field.default is REQUIRED else field.default).cast(field.sql)


def typed(value: Column, field: object) -> Column:
    """A document's value in the contract's type, defaults filled in."""
    if isinstance(field, Record):
        got = F.struct(*[typed(_member(value, n), f).alias(n) for n, f in field.fields.items()])
    elif isinstance(field, Each):
        got = F.transform(_members(value), lambda v: typed(v, field.item))
    elif isinstance(field, Anything):
        got = F.to_json(value)
    elif isinstance(field, Whole):
        got = _number(value).cast("bigint")
    elif isinstance(field, Number):
        got = _number(value)
    else:
        got = F.try_variant_get(value, "$", field.sql)
    return F.when(value.isNull() | F.is_variant_null(value), _literal(field)).otherwise(got)


# --- documents --------------------------------------------------------------


def checked(documents: DataFrame, schema: Record = REPORT, body: str = "body") -> DataFrame:
    """Add ``report`` (typed, null where the document breaks the contract) and ``broken`` (what is wrong, empty if nothing is).

    Documents that are no JSON have the one violation ``not JSON`` of path ''.
    """
    parsed = documents.withColumn("_v", F.try_parse_json(body))
    # A one-row generator: the document is parsed and checked once, however often its parts are used.
    found = F.when(F.col("_v").isNull(), _broken(F.lit(True), F.lit(""), "not JSON")).otherwise(_rules(F.col("_v"), schema, F.lit("")))
    named = parsed.select("*", F.explode(F.array(found)).alias("broken"))
    return named.withColumn("report", F.when(F.size("broken") == 0, typed(F.col("_v"), schema))).drop("_v")


def violations(documents: DataFrame, schema: Record = REPORT, body: str = "body") -> DataFrame:
    """(the documents' other columns, path, rule): a row for each thing that breaks the contract."""
    kept = [c for c in documents.columns if c != body]
    return checked(documents, schema, body).select(*kept, F.explode("broken").alias("v")).select(*kept, "v.path", "v.rule")


def shaped(value: Column, have: T.DataType, field: object) -> Column:
    """A value of a relation in the contract's type; what it does not hold, or holds as null where null is not allowed, gets its default."""
    if isinstance(field, Record):
        parts = [shaped(value[n], have[n].dataType, f).alias(n) if n in have.names else _literal(f).alias(n) for n, f in field.fields.items()]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(field, Each):
        return F.coalesce(F.transform(value, lambda v: shaped(v, have.elementType, field.item)), _literal(field))
    if isinstance(field, Anything):  # its JSON text becomes part of the document again
        return F.try_parse_json(value.cast("string"))
    return value.cast(field.sql) if field.default in (REQUIRED, None) else F.coalesce(value.cast(field.sql), _literal(field))


def body(rows: DataFrame, schema: Record = REPORT) -> Column:
    """The columns of ``rows`` under the contract's names as a document, nulls kept."""
    filled = [shaped(rows[n], rows.schema[n].dataType, f).alias(n) if n in rows.columns else _literal(f).alias(n) for n, f in schema.fields.items()]
    return F.to_json(F.struct(*filled), {"ignoreNullFields": "false"})


def names(schema: Record = REPORT) -> list[str]:
    """Paths of all leaves, lists as ``[]``: what a round trip has to keep."""

    def walk(field: object, path: str) -> list[str]:
        if isinstance(field, Record):
            return reduce(list.__add__, [walk(f, f"{path}.{n}" if path else n) for n, f in field.fields.items()])
        return walk(field.item, path + "[]") if isinstance(field, Each) else [path]

    return walk(schema, "")


def sample(schema: Record = REPORT) -> str:
    """The smallest document that keeps the contract."""

    def least(field: object) -> object:
        if isinstance(field, Record):
            return {n: least(f) for n, f in field.fields.items() if f.default is REQUIRED}
        return "x" if isinstance(field, Text) else 0

    return json.dumps(least(schema))
