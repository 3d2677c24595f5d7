"""Prompts from template text: plain ``{{ mark }}`` fields and one level of ``{% if %}``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK = r"\{\{\s*([A-Za-z_.]+)\s*\}\}"


def supported(template: Column, fields: Mapping[str, Column]) -> Column:
    """False when the text has a statement other than ``if`` on a known field."""
    return ~F.contains(_settle_ifs(template, fields), F.lit("{%"))


def _settle_ifs(template: Column, fields: Mapping[str, Column]) -> Column:
    text = F.regexp_replace(template, r"\n\z", "")
    for name, value in fields.items():
        block = rf"(?s)\{{%-?\s*if {name.replace('.', chr(92) + '.')}\s*-?%\}}(.*?)\{{%-?\s*endif\s*-?%\}}"
        given = F.coalesce(value.cast("string"), F.lit("")) != ""
        text = F.when(given, F.regexp_replace(text, block, "$1")).otherwise(
            F.regexp_replace(text, block, "")
        )
    return text


def fill(template: Column, fields: Mapping[str, Column]) -> Column:
    """Every mark replaced in one pass, so marks inside the values stay text."""
    text = _settle_ifs(template, fields)
    values = F.create_map(
        *[c for n, v in fields.items() for c in (F.lit(n), F.coalesce(v.cast("string"), F.lit("")))]
    )
    marks = F.regexp_extract_all(text, F.lit(_MARK), F.lit(1))
    between = F.split(text, _MARK)
    filled = F.transform(
        F.arrays_zip(between, marks),
        lambda p: F.concat(
            p["0"], F.coalesce(F.try_element_at(values, F.coalesce(p["1"], F.lit(""))), F.lit(""))
        ),
    )
    return F.array_join(filled, "")


def prompt(
    template: Column, transcript: Column, metadata: Mapping[str, Column], examples: Column
) -> Column:
    """User prompt: examples first, then the filled template."""
    fields = {"transcript": transcript, "examples": examples}
    fields.update({f"metadata.{n}": v for n, v in metadata.items()})
    body = fill(template, fields)
    some = F.coalesce(examples, F.lit(""))
    return F.when(some != "", F.concat(some, F.lit("\n\n"), body)).otherwise(body)


def prompt_chars(template: Column, transcript_chars: Column) -> Column:
    """Length of a filled prompt without building it; only the transcript's mark counts."""
    marks = F.size(
        F.regexp_extract_all(template, F.lit(r"\{\{\s*(transcript)\s*\}\}"), F.lit(1))
    )
    bare = F.regexp_replace(F.regexp_replace(template, r"\n\z", ""), r"\{\{[^}]*\}\}", "")
    return F.length(bare) + marks * transcript_chars
