"""Prompts for describing street-level images, and the schema of a full answer."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _L, _B = T.StringType(), T.ArrayType(T.StringType()), T.BooleanType()

#: What a full answer holds. Advisory: readers take what is there.
SCENE = T.StructType(
    [
        T.StructField("scene_narrative", T.StringType()),
        T.StructField("land_use_character", _struct(primary=_S, secondary=_S, intensity=_S)),
        T.StructField("urban_morphology", _struct(street_type=_S, enclosure_ratio=_S, building_setback=_S, block_pattern=_S)),
        T.StructField("streetscape_elements", _struct(sidewalk_quality=_S, street_trees=_S, street_furniture=_L, facade_transparency=_S, signage_density=_S)),
        T.StructField("mobility_infrastructure", _struct(modes_visible=_L, parking_presence=_S, transit_stops=_B, crosswalk_type=_S)),
        T.StructField("place_character", _struct(dominant_activity=_S, temporal_markers=_S, human_presence=_S, visual_complexity=_S)),
        T.StructField("historic_cultural_elements", _struct(architectural_period=_S, heritage_features=_L, cultural_signifiers=_L)),
        T.StructField("environmental_quality", _struct(greenery_coverage=_S, sky_visibility=_S, cleanliness=_S, maintenance_level=_S)),
        T.StructField("spatial_safety_cues", _struct(lighting_adequacy=_S, sightlines=_S, enclosure_feeling=_S, activity_level=_S)),
        T.StructField("geo_context", _struct(topography=_S, water_visibility=_B, landmark_proximity=_L, neighborhood_type=_S)),
        T.StructField("image_quality", _struct(usable_for_analysis=_B, issues=_L)),
        T.StructField("semantic_tags", T.ArrayType(T.StringType())),
    ]
)


def outline(schema: T.StructType = SCENE) -> dict:
    """The schema as nested names with short type marks, for a prompt."""
    mark = {"string": "text", "boolean": "true or false", "array<string>": ["text"]}
    return {f.name: outline(f.dataType) if isinstance(f.dataType, T.StructType) else mark[f.dataType.simpleString()] for f in schema}


FULL_SYSTEM = "You survey streets from photographs. Report what can be seen, guess nothing, and reply with one JSON object and no other text."
FULL_USER = f"Fill in every member of this outline for the photograph. Use 'unknown' where it does not tell.\n{outline()}"
SHORT_SYSTEM = "You describe photographs of streets in plain words and reply with one JSON object."
SHORT_USER = "Reply with the members scene_narrative (two or three sentences), semantic_tags (five to ten tags), land_use_character.primary, urban_morphology.street_type and place_character.dominant_activity."

TEMPLATES = {
    "full": {"system": FULL_SYSTEM, "user": FULL_USER, "schema": SCENE},
    "simple": {"system": SHORT_SYSTEM, "user": SHORT_USER, "schema": None},
}


def get_prompt_template(name: str = "full") -> dict:
    if name not in TEMPLATES:
        raise ValueError(f"unknown template {name!r}; one of {sorted(TEMPLATES)}")
    return dict(TEMPLATES[name])


def create_custom_prompt(system: str, user: str, schema: T.StructType | None = None) -> dict:
    return {"system": system, "user": user, "schema": schema}


def prompt_for(template: str | None, system: str | None, user: str | None) -> dict:
    """A template counts only where neither prompt is given."""
    if system is None and user is None:
        return get_prompt_template(template or "full")
    return create_custom_prompt(system if system is not None else FULL_SYSTEM, user if user is not None else FULL_USER, SCENE)
