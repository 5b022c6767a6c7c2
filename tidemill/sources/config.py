"""Topics and profiles from a user's own YAML or JSON: a few dozen entries that become literals or small tables of a plan."""

from __future__ import annotations

import json
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from ..operators.fit import Level, Profile, Region
from ..operators.routing import Topic, Topics


def parsed(text: str) -> dict:
    """A mapping from JSON, or from YAML where a YAML reader is installed."""
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        import yaml

        return yaml.safe_load(text) or {}


def _made(kind: type, given: dict, **nested):
    """A configuration object; unknown names are an error, so that a slip does not pass as a default."""
    known = {f.name for f in fields(kind)}
    if wrong := set(given) - known:
        raise ValueError(f"{kind.__name__} has no {', '.join(sorted(wrong))}")
    return kind(**{k: nested[k] if k in nested else tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def topics(text: str) -> Topics:
    """Sections, excluded and gate keywords, sources and the numbers of routing."""
    given = parsed(text)
    sources = {k: (float(v.get("weight", 0)), v.get("hint")) for k, v in given.get("sources", {}).items()}
    return _made(Topics, given, sections=tuple(_made(Topic, x) for x in given.get("sections", [])), sources=sources)


def profile(text: str) -> Profile:
    """Levels, regions, keyword lists and the numbers of fit scoring; points and tiers that are not given stay."""
    given = parsed(text)
    base = Profile((), (), ())
    merged = {k: getattr(base, k) | dict(given[k]) for k in ("points", "saturation", "tiers") if k in given}
    return _made(Profile, given, levels=tuple(_made(Level, x) for x in given.get("levels", [])), regions=tuple(_made(Region, x) for x in given.get("regions", [])), **merged)


def keyword_table(spark: SparkSession, t: Topics) -> DataFrame:
    """section, place, kind, keyword: the keywords of all sections as a small dimension."""
    rows = [(x.id, i, kind, k) for i, x in enumerate(t.sections) for kind in ("strong", "supporting") for k in getattr(x, kind)]
    return spark.createDataFrame(rows, "section string, place int, kind string, keyword string")
