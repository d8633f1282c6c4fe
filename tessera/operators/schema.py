"""Schema normalisation: column-name slugs, alias resolution, required columns.

All of this is metadata work on ``df.columns`` (driver side, no data
touched), except the emptiness check which is a one-row ``isEmpty`` probe.
"""

from __future__ import annotations

import itertools
import unicodedata
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.spec import TableSpec


def slug(name) -> str:
    """A header as an identifier: letters and digits of its ASCII form, words parted by one underscore.

    Accents are decomposed and dropped with every other character beyond
    ASCII; any other character ends a word.
    """
    kept = (c for c in unicodedata.normalize("NFKD", str(name)) if c.isascii())
    return "_".join("".join(c.lower() if c.isalnum() else " " for c in kept).split())


@dataclass(frozen=True)
class ColumnMapping:
    original: list[str]
    normalized: list[str]


def resolve_names(columns: list[str], spec: TableSpec) -> list[str]:
    """Canonical name of each column; later ones of a name become ``<name>_duplicate``, ``<name>_duplicate_2``, ...

    Columns are grouped by canonical name and numbered within their group;
    numbers that would meet the name of another group are skipped.
    """
    groups: dict[str, list[int]] = {}
    for place, header in enumerate(columns):
        groups.setdefault(spec.canonical_for(slug(header)), []).append(place)
    names, taken = [""] * len(columns), set(groups)
    for base, places in groups.items():
        numbered = (f"{base}_duplicate" + (f"_{n}" if n > 1 else "") for n in itertools.count(1))
        free = itertools.chain([base], (n for n in numbered if n not in taken))
        for place, name in zip(places, free):
            names[place] = name
            taken.add(name)
    return names


def normalize_columns(df: DataFrame, spec: TableSpec) -> tuple[DataFrame, ColumnMapping]:
    """Rename every column to its canonical name (positional, so duplicate source names are safe)."""
    original = list(df.columns)
    names = resolve_names(original, spec)
    return df.toDF(*names), ColumnMapping(original, names)


def missing_required(columns, spec: TableSpec) -> list[str]:
    return [c for c in spec.required if c not in columns]


def require_columns(df: DataFrame, spec: TableSpec) -> None:
    missing = missing_required(df.columns, spec)
    if missing:
        raise ValueError("missing required columns: " + ", ".join(missing)
                         + "; headers that would do: " + "; ".join(
                             f"{name}: {', '.join(sorted(spec.aliases.get(name, {name})))}" for name in missing))


def with_default(df: DataFrame, column: str, value) -> DataFrame:
    """Add a constant column when absent (e.g. a placeholder target for scoring)."""
    return df if column in df.columns else df.withColumn(column, F.lit(value))


def split_features(df: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    """Feature projection and target projection (numeric, categorical, present optionals)."""
    features = spec.feature_columns(df.columns)
    return df.select(*features), df.select(spec.target)
