"""Declared table specifications: canonical columns, accepted aliases, target vocabulary."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TableSpec:
    """What a study table must look like after normalisation.

    numeric      columns coerced to DOUBLE (unparseable text becomes NULL)
    categorical  columns cast to STRING, NULL kept
    optional     categorical columns used only when present after aliasing
    target       binary label column
    aliases      canonical name -> accepted column-name slugs
    key          optional row key (used for deterministic hashing); when absent
                 an md5 over all columns is used
    positive / negative   target words mapped to 1 / 0 after trim + lower
    excluded_class        numeric target value removed explicitly and counted
    """

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    target: str
    optional: tuple[str, ...] = ()
    aliases: dict[str, frozenset[str]] = field(default_factory=dict)
    key: str | None = None
    positive: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    excluded_class: float | None = None

    @property
    def required(self) -> list[str]:
        return [*self.numeric, *self.categorical, self.target]

    def canonical_for(self, slug: str) -> str:
        for name, names in self.aliases.items():
            if slug in names:
                return name
        return slug

    def present_optional(self, columns) -> list[str]:
        return [c for c in self.optional if c in columns]

    def categorical_features(self, columns) -> list[str]:
        return [*self.categorical, *self.present_optional(columns)]

    def feature_columns(self, columns) -> list[str]:
        return [*self.numeric, *self.categorical_features(columns)]


# ---------------------------------------------------------------------------
# The plot-observation study schema, its accepted column
# aliases and the target vocabulary. These must stay exactly as listed so
# that uploads accepted by the original study are accepted here.
# "crop" is an alias of crop_type; class 2 (excess water) is excluded from the binary study.
# ---------------------------------------------------------------------------
IRRIGATION_SPEC = TableSpec(
    numeric=("temperature", "humidity", "moi"),
    categorical=("soil_type", "crop_stage"),
    target="result",
    optional=("crop_id", "crop_type"),
    aliases={
        "temperature": frozenset({"temp", "temperature", "ambient_temperature", "air_temperature"}),
        "humidity": frozenset({"humidity", "relative_humidity", "air_humidity"}),
        "moi": frozenset({"moi", "moisture_index", "soil_moisture_index", "soil_moisture"}),
        "soil_type": frozenset({"soil_type", "soiltype", "soil"}),
        "crop_stage": frozenset({"seedling_stage", "crop_stage", "cropstage", "phenological_stage", "stage"}),
        "result": frozenset({"result", "target", "label", "irrigation_required", "irrigation"}),
        "crop_id": frozenset({"crop_id", "cropid", "crop_identifier"}),
        "crop_type": frozenset({"crop_type", "croptype", "crop"}),
    },
    positive=("yes", "true", "si", "sí", "required", "1"),
    negative=("no", "false", "0", "not_required"),
    excluded_class=2.0,
)

# Input range rules of the scoring form (humidity is a percentage, moisture
# index is non-negative). Fixed values.
IRRIGATION_RANGE_RULES = {
    "humidity_out_of_range": "humidity < 0 OR humidity > 100",
    "moi_negative": "moi < 0",
}
