"""Settings as YAML documents, read by the parser that Spark brings along."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import SparkSession


def resolve(path: str | Path) -> Path:
    """The file of this name, or the one with ``.yaml`` behind it; FileNotFoundError with the whole path if there is neither."""
    given = Path(path)
    for held in (given, given.with_name(given.name + ".yaml")):
        if held.is_file():
            return held.resolve()
    raise FileNotFoundError(f"no settings at {given.absolute()}")


def read_settings(spark: SparkSession, path: str | Path) -> dict:
    """The mapping in a YAML file on the driver; an empty file gives an empty one, anything else TypeError."""
    text = resolve(path).read_text(encoding="utf-8")
    jvm = spark._jvm
    yaml = jvm.org.yaml.snakeyaml.Yaml(jvm.org.yaml.snakeyaml.constructor.SafeConstructor(jvm.org.yaml.snakeyaml.LoaderOptions()))
    made = json.loads(jvm.com.fasterxml.jackson.databind.ObjectMapper().writeValueAsString(yaml.load(text)))
    if made is None:
        return {}
    if not isinstance(made, dict):
        raise TypeError(f"settings must be a mapping, not {type(made).__name__}")
    return made
