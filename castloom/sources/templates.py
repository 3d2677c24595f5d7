"""Extraction templates from YAML files: a small dimension, parsed by the driver."""

from __future__ import annotations

import json
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUILTIN = Path(__file__).resolve().parent.parent / "plans" / "builtin"

#: Templates are a dimension: more files than this are taken for a mistake.
MOST_FILES = 10_000

SCHEMA = (
    "name string, version string, description string, system_prompt string, "
    "user_prompt string, expected_format string, output_schema string, required_fields int, "
    "category string, applies_to array<string>, priority int, model_preference string, "
    "max_tokens int, temperature double, examples string"
)


def examples_text(examples: list[dict]) -> str:
    """Examples as they are put before a prompt, empty without any."""
    if not examples:
        return ""
    text = "\n\nExamples:\n"
    for number, example in enumerate(examples, 1):
        text += f"\nExample {number}:\n"
        if "input" in example:
            text += f"Input: {example['input']}\n"
        if "output" in example:
            text += f"Output:\n{json.dumps(example['output'], indent=2)}\n"
    return text


def _row(text: str) -> tuple:
    data = yaml.safe_load(text)
    schema = data.get("output_schema")
    return (
        data["name"],
        str(data["version"]),
        data["description"],
        data["system_prompt"].rstrip("\n"),
        data["user_prompt_template"],
        data["expected_format"],
        json.dumps(schema, sort_keys=True) if schema else None,
        len((schema or {}).get("required", [])),
        data.get("category"),
        data.get("applies_to", ["all"]),
        int(data.get("priority", 0)),
        data.get("model_preference"),
        int(data.get("max_tokens", 2000)),
        float(data.get("temperature", 0.3)),
        examples_text(data.get("few_shot_examples") or []),
    )


def _texts(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """The files of a folder in the order of their paths, at most MOST_FILES."""
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .text(folder, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), "value")
    )
    rows = files.where("name <> 'schema.yaml'").orderBy("path").limit(MOST_FILES + 1).collect()
    if len(rows) > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} template files in {folder}")
    return [r["value"] for r in rows]


def read_templates(spark: SparkSession, *folders: str | Path, pattern: str = "*.yaml") -> DataFrame:
    """Templates of all folders and their subfolders; an earlier folder shadows later ones.

    Folders may lie in any storage Spark reads. The built-in folder always comes last.
    """
    texts = [t for folder in folders for t in _texts(spark, str(folder), pattern)]
    texts += [f.read_text(encoding="utf-8") for f in sorted(BUILTIN.rglob("*.yaml"))]
    found: dict[str, tuple] = {}
    for row in map(_row, texts):
        found.setdefault(row[0], row)
    return spark.createDataFrame(list(found.values()), SCHEMA)
