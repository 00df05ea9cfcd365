"""Functions on descriptions: JSON answers, ids from paths, composed text, tags."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID_PATTERN = r"(\d+)\.\w+$"
ANSWER_FIELDS = ("target_field", "alt_detailed", "scene_narrative")


def unfenced(text: Column) -> Column:
    """text without the code fence around it, and without a leading word json."""
    t = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    inner = F.regexp_replace(F.regexp_replace(t, r"(?s)^```[^\n]*\n", ""), r"(?s)(^|\n)```.*$", "")
    body = F.when(t.startswith("```") & t.contains("\n"), inner).otherwise(t)
    return F.regexp_replace(F.regexp_replace(body, r"^\s+|\s+$", ""), r"^json\s*", "")


def json_answer(text: Column) -> Column:
    """struct<parsed, parse_error>: the answer as VARIANT; an answer with a member named error is one, too. Null text is an error."""
    parsed = F.try_parse_json(unfenced(text))
    return F.struct(parsed.alias("parsed"), _bad(parsed).alias("parse_error"))


def _bad(parsed: Column) -> Column:
    return parsed.isNull() | F.try_variant_get(parsed, "$.error", "variant").isNotNull()


def _field(v: Column, path: str, default: str) -> Column:
    """A string member; a missing one, or one below what is no object, gets the default. An explicit null stays null."""
    found = F.try_variant_get(v, path, "string")
    null = F.is_variant_null(F.try_variant_get(v, path, "variant"))
    return F.when(found.isNotNull() | F.coalesce(null, F.lit(False)), found).otherwise(F.lit(default))


SCENE_FIELDS = ("raw_response", "parsed_json", "parse_error", "scene_narrative", "semantic_tags", "land_use_primary", "street_type", "place_character", "usable")


def with_scene_fields(df: DataFrame, text: str) -> DataFrame:
    """df with SCENE_FIELDS, the description columns of a model's answer. Wrong types and malformed answers get the defaults.

    The answer is stripped and parsed once, in a projection of its own below that of the fields.
    """
    parsed, error = "_scene_parsed", "_scene_error"
    answer = F.col(f"`{text}`")
    told = df.withColumn(parsed, F.try_parse_json(unfenced(answer)))
    v = F.col(parsed)
    told = told.withColumn(error, _bad(v))
    bad = F.col(error)
    tags = F.try_variant_get(v, "$.semantic_tags", "array<string>")
    usable = F.coalesce(F.try_variant_get(v, "$.image_quality.usable_for_analysis", "boolean"), F.lit(True))
    fields = {
        "raw_response": answer,
        "parsed_json": F.when(~bad, F.to_json(v)),
        "parse_error": bad,
        "scene_narrative": F.when(bad, "").otherwise(_field(v, "$.scene_narrative", "")),
        "semantic_tags": F.when(bad, "").otherwise(F.coalesce(F.array_join(tags, ","), F.try_variant_get(v, "$.semantic_tags", "string"), F.lit(""))),
        "land_use_primary": F.when(bad, "error").otherwise(_field(v, "$.land_use_character.primary", "unknown")),
        "street_type": F.when(bad, "error").otherwise(_field(v, "$.urban_morphology.street_type", "unknown")),
        "place_character": F.when(bad, "error").otherwise(_field(v, "$.place_character.dominant_activity", "unknown")),
        "usable": F.when(bad, False).otherwise(usable),
    }
    return told.withColumns(fields).drop(parsed, error)


def parse_description(text: Column, target_field: str | None = "target_field") -> Column:
    """A readable description from a model's answer.

    Null and blank give null, malformed JSON the text itself. An object gives the first of target_field, alt_detailed
    and scene_narrative that it has, else its string members joined by spaces, else its JSON. Other JSON gives its
    text. With target_field None: the whole answer as JSON.
    """
    v = F.try_parse_json(text)
    blank = text.isNull() | (F.regexp_replace(text, r"\s", "") == "")
    if target_field is None:
        return F.when(blank, None).when(v.isNull(), text).otherwise(F.to_json(v))
    keys = F.json_object_keys(text)
    names = list(dict.fromkeys([target_field, *ANSWER_FIELDS[1:]]))
    picked = F.when(F.array_contains(keys, names[0]), F.try_variant_get(v, _path(names[0]), "string"))
    for name in names[1:]:
        picked = picked.when(F.array_contains(keys, name), F.try_variant_get(v, _path(name), "string"))
    # A member is a string if its own JSON begins with a quote.
    members = F.from_json(text, "map<string,string>")
    typed = F.try_variant_get(v, "$", "map<string,variant>")
    strings = F.filter(keys, lambda k: F.to_json(F.element_at(typed, k)).startswith('"'))
    joined = F.array_join(F.transform(strings, lambda k: F.element_at(members, k)), " ")
    is_object = keys.isNotNull()
    return (
        F.when(blank, None)
        .when(v.isNull(), text)
        .when(is_object & F.arrays_overlap(keys, F.array(*map(F.lit, names))), picked.otherwise(F.lit(None)))
        .when(is_object, F.coalesce(F.nullif(joined, F.lit("")), F.to_json(v)))
        .otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))
    )


def _path(name: str) -> str:
    return f"$['{name}']" if not re.fullmatch(r"\w+", name) else f"$.{name}"


def extract_image_id(path: Column, pattern: str = ID_PATTERN) -> Column:
    """The first group of pattern in path, null where it doesn't match."""
    p = f"(?U){pattern}"
    return F.when(path.rlike(p), F.regexp_extract(path, p, 1))


def file_stem(path: Column) -> Column:
    """The file's name without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def compose_text(df: DataFrame, columns: list[str], separator: str = " | ") -> Column:
    """The non-blank values of the columns that df has, trimmed and joined; lists by commas first. Nothing at all gives ''."""
    kinds = dict(df.dtypes)
    parts = []
    for name in columns:
        if name in kinds:
            c = df[f"`{name}`"]
            c = F.array_join(c.cast("array<string>"), ", ") if kinds[name].startswith("array") else c.cast("string")
            parts.append(F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit("")))
    return F.concat_ws(separator, *parts) if parts else F.lit("")


def split_tags(tags: Column) -> Column:
    """The trimmed, non-empty tags of a comma-separated list."""
    return F.filter(F.transform(F.split(tags, ","), F.trim), lambda t: t != "")


def place_slug(name: str) -> str:
    return name.lower().translate({ord(" "): "_", ord(","): None})


def stars(p: Column) -> Column:
    """Marks of significance."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def percent(part: Column, whole: Column) -> Column:
    """A percentage with one decimal, halves to even."""
    return F.bround(part * 100.0 / whole, 1)
