"""Values whose shape differs by row, walked as VARIANT with built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind(v: Column) -> Column:
    """The JSON type of a value: object, array, string, boolean, integer, number or null."""
    s = F.schema_of_variant(v)
    return (
        F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").when(s == "BIGINT", "integer").otherwise("number")
    )


def elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def members(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def as_string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


# -- S37 ----------------------------------------------------------------------------------------------


def _listed(v: Column) -> Column:
    """What a group holds: a list's elements, those of an object's ``images``, else of its ``paths``, or the value itself."""
    held = F.when(F.map_contains_key(members(v), "images"), members(v)["images"]).otherwise(members(v)["paths"])
    inner = F.when(kind(v) == "object", held).otherwise(v)
    return F.coalesce(elements(inner), F.array(inner))


def _name(v: Column) -> Column:
    """A value as text; zero, false and null are none."""
    zero = kind(v).isin("integer", "number") & (F.try_variant_get(v, "$", "double") == 0)
    return F.when(kind(v) == "boolean", F.when(F.try_variant_get(v, "$", "boolean"), "True").otherwise("")).when(zero, "").otherwise(F.trim(F.coalesce(as_string(v), F.lit(""))))


def _group(v: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(_listed(v), _name), lambda x: x != ""))


def solution_groups(v: Column) -> Column:
    """A list of groups, each a list of names in first order without repeats; empty groups are left out.

    A scalar, an object, or a list of scalars is one group; a list that holds
    lists or objects has a group for each element; null and what is no JSON has none.
    """
    nested = F.exists(elements(v), lambda x: kind(x).isin("array", "object"))
    groups = F.when(F.coalesce(nested, F.lit(False)), F.transform(elements(v), _group)).otherwise(F.array(_group(v)))
    some = F.filter(groups, lambda g: F.size(g) > 0)
    return F.when(v.isNull() | F.is_variant_null(v), F.array().cast("array<array<string>>")).otherwise(some)


# -- S44 ----------------------------------------------------------------------------------------------


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _fault(bad: Column, path: Column, word: str) -> Column:
    """The fault's path and keyword, if there is one."""
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(bad, F.lit(False)), F.array(F.concat(path, F.lit(":"), F.lit(word)))).otherwise(none)


def schema_faults(v: Column, schema: dict, path: Column | None = None) -> Column:
    """The faults of a value under a JSON schema, each ``path:keyword``, in the schema's order.

    One tree of built-in expressions is made of the schema (type, const, enum,
    minLength, minimum, maximum, uniqueItems, items, required, properties,
    additionalProperties); a value of the wrong type has that fault alone. An
    absent value (null column) has none: its object says that it is required.
    """
    path = F.lit("$") if path is None else path
    return let(v, lambda x: _faults(x, schema, path))


def _faults(v: Column, schema: dict, path: Column) -> Column:
    none = F.array().cast("array<string>")
    own: list[Column] = []
    number = F.try_variant_get(v, "$", "double")
    if "const" in schema:
        own.append(_fault((kind(v) != "string") | (as_string(v) != schema["const"]), path, "const"))
    if "enum" in schema:
        own.append(_fault((kind(v) != "string") | ~as_string(v).isin(schema["enum"]), path, "enum"))
    if "minLength" in schema:
        own.append(_fault(F.length(as_string(v)) < schema["minLength"], path, "minLength"))
    if "minimum" in schema:
        own.append(_fault(number < schema["minimum"], path, "minimum"))
    if "maximum" in schema:
        own.append(_fault(number > schema["maximum"], path, "maximum"))
    if schema.get("uniqueItems"):
        texts = F.transform(elements(v), lambda x: F.concat(kind(x), F.lit(" "), F.coalesce(as_string(x), F.lit(""))))
        own.append(let(texts, lambda x: _fault(F.size(F.array_distinct(x)) < F.size(x), path, "uniqueItems")))
    if "items" in schema:
        each = F.transform(elements(v), lambda x, i: _faults(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        own.append(F.coalesce(F.flatten(each), none))
    if schema.get("type") == "object":
        own.append(let(members(v), lambda m: _member_faults(m, schema, path)))
    told = F.concat(*own) if own else none
    if "type" in schema:
        whole = (kind(v) == "number") & (number == F.floor(number))
        fits = {"integer": (kind(v) == "integer") | whole, "number": kind(v).isin("integer", "number")}.get(schema["type"], kind(v) == schema["type"])
        told = F.when(fits, told).otherwise(F.array(F.concat(path, F.lit(":type"))))
    return F.when(v.isNull(), none).otherwise(told)


def _member_faults(m: Column, schema: dict, path: Column) -> Column:
    properties, more = schema.get("properties", {}), schema.get("additionalProperties", True)
    at = lambda k: F.concat(path, F.lit("."), k if isinstance(k, Column) else F.lit(k))
    own = [_fault(~F.map_contains_key(m, k), at(k), "required") for k in schema.get("required", ())]
    own += [schema_faults(m[k], inner, at(k)) for k, inner in properties.items()]
    if more is not True:
        others = F.filter(F.array_sort(F.map_keys(m)), lambda k: ~k.isin(list(properties)))
        told = lambda k: F.array(F.concat(at(k), F.lit(":additionalProperties"))) if more is False else schema_faults(m[k], more, at(k))
        own.append(F.flatten(F.transform(others, told)))
    return F.concat(*own) if own else F.array().cast("array<string>")


def _strings(unique: bool = False, least: int = 0) -> dict:
    inner = {"type": "string"} | ({"minLength": least} if least else {})
    return {"type": "array", "items": inner} | ({"uniqueItems": True} if unique else {})


def _object(properties: dict, optional: tuple[str, ...] = (), more: bool | dict = False) -> dict:
    return {"type": "object", "required": [k for k in properties if k not in optional], "properties": properties, "additionalProperties": more}


_TEXT, _FLAG, _SOME_TEXT = {"type": "string"}, {"type": "boolean"}, {"type": "string", "minLength": 1}
#: The fields of a problem's semantic profile, first version, with their types and the values that they may have.
PROFILE_VERSION = "problem_semantic_profile_v1"
PROFILE = _object(
    {
        "schema_version": {"const": PROFILE_VERSION},
        "problem_id": _SOME_TEXT,
        "modality": {"type": "string", "enum": ["text_only", "text_image", "image_dominant", "merged_continuation"]},
        "course": _TEXT,
        "topic": _TEXT,
        "subtopic": _TEXT,
        "statement_summary": _SOME_TEXT,
        "concepts": _strings(unique=True, least=1),
        "skills": _strings(unique=True, least=1),
        "objects": _object({k: _strings(unique=True) for k in ("geometry", "algebra", "arithmetic")}, more=_strings()),
        "given_conditions": _strings(),
        "unknowns": _strings(unique=True),
        "representation": _object({"embedding_text": _SOME_TEXT, "search_keywords": _strings(unique=True), "canonical_problem_type": _SOME_TEXT}),
        "difficulty": _object(
            {
                "estimated_level": {"type": "integer", "minimum": 1, "maximum": 5},
                "scale": {"const": "1-5"},
                "signals": _object(
                    {
                        "steps_estimated": {"type": "integer", "minimum": 0},
                        "requires_graph_reading": _FLAG,
                        "requires_formula_memory": _FLAG,
                        "requires_multi_case_reasoning": _FLAG,
                        "requires_algebraic_manipulation": {"type": "string", "enum": ["none", "low", "medium", "high"]},
                    },
                    more=True,
                ),
                "reason": _TEXT,
            }
        ),
        "evidence": _object({"uses_text": _FLAG, "uses_figure": _FLAG, "figure_tags": _strings(unique=True), "source_fields": _strings(unique=True)}, more=True),
        "review": _object({"status": {"type": "string", "enum": ["sin_revisar", "revisado", "requiere_correccion"]}, "human_verified": _FLAG, "notes": _TEXT}),
    },
    optional=("subtopic",),
)


def profile_faults(text: Column) -> Column:
    """The faults of a semantic profile's JSON text; without a known version that alone is told."""
    v = F.try_parse_json(text)
    version = F.trim(F.coalesce(as_string(members(v)["schema_version"]), F.lit("")))
    return (
        F.when(v.isNull(), F.array(F.lit("invalid_json")))
        .when(kind(v) != "object", F.array(F.lit("not_an_object")))
        .when(version == "", F.array(F.lit("missing:schema_version")))
        .when(version != PROFILE_VERSION, F.array(F.concat(F.lit("unknown:schema_version:"), version)))
        .otherwise(schema_faults(v, PROFILE))
    )
