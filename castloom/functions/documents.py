"""Expressions on notes and model output: front matter, rendering, JSON checks, headings."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from castloom.functions.text import SPACE, lstrip, strip

#: Size of a model's answer in bytes and depth of its nesting.
MAX_JSON_BYTES, MAX_JSON_DEPTH = 5_000_000, 10
CONTEXT_CUT, CONTEXT_ITEMS = 50, 5


def front_matter_of(text: Column) -> Column:
    """YAML between the leading marks, null without both marks."""
    parts = F.split(text, "---\n", 3)
    return F.when(text.startswith("---\n") & (F.size(parts) == 3), F.get(parts, F.lit(1)))


def body_of(text: Column) -> Column:
    """Text after the front matter, or all of it."""
    parts = F.split(text, "---\n", 3)
    whole = text.startswith("---\n") & (F.size(parts) == 3)
    return F.when(whole, lstrip(F.get(parts, F.lit(2)))).otherwise(text)


def front_matter_value(front_matter: Column, name: str) -> Column:
    """A top-level scalar of front matter, without its quotes."""
    raw = F.regexp_extract(front_matter, rf"(?m)^{name}:[ ]*(.*)$", 1)
    bare = F.regexp_replace(strip(raw), r"""^'(.*)'$|^"(.*)"$""", "$1$2")
    return F.nullif(bare, F.lit(""))


def yaml_scalar(text: Column) -> Column:
    """Plain when YAML reads it back as the same text, else quoted."""
    plain = F.regexp_like(text, F.lit(r"^[\p{L}_/.(][^\n]*$")) & ~F.regexp_like(
        text, F.lit(r": |:$| #|\s$|(?i:^(?:true|false|yes|no|on|off|y|n|null)$)|^\.[0-9]|^\.(?i:inf|nan)$")
    )
    double = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(text, r"([\\\"])", r"\\$1"), "\n", r"\\n"), "\t", r"\\t"
    )
    return (
        F.when(plain, text)
        .when(F.contains(text, F.lit("\n")), F.concat(F.lit('"'), double, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'")))
    )


def template_tag(template: Column) -> Column:
    """Tag of a template's kind, the first that fits; null for others."""
    low = F.lower(template)
    tag = F.lit(None).cast("string")
    for part, name in (
        ("book", "books"), ("tool", "tools"), ("concept", "concepts"),
        ("summary", "summary"), ("quote", "quotes"),
    ):
        tag = F.when(F.contains(low, F.lit(part)), name).otherwise(tag)
    return tag


def _yes(flag: Column) -> Column:
    return F.when(flag, "true").otherwise("false")


def front_matter(day: Column, base_tags: Sequence[str] = ("podcast",)) -> Column:
    """Front matter of a result row, fields in fixed order, optional ones when given.

    Reads template_name, template_version, podcast, episode, provider, cost_usd,
    cost_known, billing_mode, model, bypassed, bypass_reason, url and source_kind.
    """
    c = F.col

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value)

    def given(name: str, column: str) -> Column:
        return F.when(F.coalesce(c(column), F.lit("")) != "", line(name, yaml_scalar(c(column))))

    cost = F.bround("cost_usd", 4).cast("string")
    tags = F.concat(
        F.lit("tags:" + "".join(f"\n- {t}" for t in base_tags)),
        F.coalesce(F.concat(F.lit("\n- "), template_tag(c("template_name"))), F.lit("")),
    )
    return F.concat_ws(
        "\n",
        F.lit("---"),
        line("template", yaml_scalar(c("template_name"))),
        line("template_version", yaml_scalar(c("template_version"))),
        line("podcast", yaml_scalar(F.coalesce("podcast", F.lit("Unknown")))),
        line("episode", yaml_scalar(F.coalesce("episode", F.lit("Unknown")))),
        line("date", yaml_scalar(F.date_format(day, "yyyy-MM-dd"))),
        line("extracted_with", F.coalesce(yaml_scalar(c("provider")), F.lit("null"))),
        line("cost_usd", cost),
        line("cost_known", _yes(c("cost_known"))),
        F.concat(
            F.lit("billing:\n  mode: "), c("billing_mode"), F.lit("\n  amount_usd: "),
            F.when(c("cost_known"), cost).otherwise("null"),
        ),
        given("model", "model"),
        F.when(c("bypassed"), "extraction_bypassed: true"),
        F.when(c("bypassed"), line("bypass_reason", yaml_scalar(c("bypass_reason")))),
        given("url", "url"),
        given("source_kind", "source_kind"),
        tags,
        F.lit("---"),
    )


@F.pandas_udf(StringType())
def _indented(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: None if t is None else json.dumps(json.loads(t), indent=2))


def _listing(content: Column, key: str, fields: Sequence[str], title: str, missing: str, row) -> Column:
    """Lines of an array of objects, or one line when the array is not there."""
    shape = f"struct<{key}:array<struct<{','.join(f'{f}:string' for f in fields)}>>>"
    items = F.from_json(content, shape)[key]
    lines = F.concat(F.array(F.lit(f"{title}\n")), F.flatten(F.transform(items, row)))
    return F.when(items.isNull(), missing).otherwise(F.array_join(lines, "\n"))


def _or(value: Column, text: str = "") -> Column:
    return F.coalesce(value, F.lit(text))


def _quote(q: Column, i: Column) -> Column:
    return F.array_compact(
        F.array(
            F.concat(F.lit("## Quote "), (i + 1).cast("string"), F.lit("\n")),
            F.concat(F.lit("> "), _or(q["text"]), F.lit("\n")),
            F.concat(F.lit("**Speaker:** "), _or(q["speaker"], "Unknown")),
            F.when(_or(q["timestamp"]) != "", F.concat(F.lit("**Timestamp:** "), q["timestamp"])),
            F.lit(""),
        )
    )


def _concept(x: Column) -> Column:
    told, context = _or(x["explanation"]), _or(x["context"])
    return F.array_compact(
        F.array(
            F.concat(F.lit("## "), _or(x["name"], "Unknown"), F.lit("\n")),
            F.when(told != "", F.concat(told, F.lit("\n"))),
            F.when(context != "", F.concat(F.lit("**Context:** "), context, F.lit("\n"))),
        )
    )


def _tool(x: Column, cut: int) -> Column:
    return F.array(
        F.concat(
            F.lit("| "), _or(x["name"], "Unknown"), F.lit(" | "), _or(x["category"], "N/A"),
            F.lit(" | "), F.substring(_or(x["context"]), 1, cut), F.lit(" |"),
        )
    )


def _book(x: Column) -> Column:
    context = _or(x["context"])
    return F.array_compact(
        F.array(
            F.concat(F.lit("## "), _or(x["title"], "Unknown"), F.lit("\n")),
            F.concat(F.lit("**Author:** "), _or(x["author"], "Unknown"), F.lit("\n")),
            F.when(context != "", F.concat(F.lit("**Mentioned:** "), context, F.lit("\n"))),
        )
    )


def render(
    template: Column, content_text: Column, content_json: Column, context_cut: int = CONTEXT_CUT
) -> Column:
    """Markdown of a result: text as it is, JSON by the template's kind, else an error note.

    A tool's context is cut at ``context_cut`` characters to fit its table.
    """
    low = F.lower(template)

    def is_kind(word: str) -> Column:
        return F.contains(low, F.lit(word))

    quotes = _listing(content_json, "quotes", ("text", "speaker", "timestamp"), "# Quotes",
                      "No quotes found.", _quote)
    concepts = _listing(content_json, "concepts", ("name", "explanation", "context"),
                        "# Key Concepts", "No concepts found.", _concept)
    table = "# Tools & Technologies Mentioned\n\n| Tool | Category | Context |\n|------|----------|---------|"
    tools = _listing(content_json, "tools", ("name", "category", "context"), table,
                     "No tools found.", lambda x: _tool(x, context_cut))
    tools = F.replace(tools, F.lit("|---------|\n\n"), F.lit("|---------|\n"))
    tools = F.regexp_replace(tools, r"(\|---------\|)\n\z", "$1")
    books = _listing(content_json, "books", ("title", "author", "context"),
                     "# Books & Publications", "No books found.", _book)
    known = is_kind("quote") | is_kind("concept") | is_kind("tool") | is_kind("book")
    generic = F.when(content_json.isNotNull() & ~known, content_json)
    block = F.concat(F.lit("# Extracted Data\n\n```json\n"), _indented(generic), F.lit("\n```"))
    by_kind = (
        F.when(is_kind("quote"), quotes)
        .when(is_kind("concept"), concepts)
        .when(is_kind("tool"), tools)
        .when(is_kind("book"), books)
        .otherwise(block)
    )
    return (
        F.when(content_json.isNotNull(), by_kind)
        .when(content_text.isNotNull(), content_text)
        .otherwise("# Error\n\nNo content extracted.")
    )


_HEADING = rf"^(#{{1,3}}){SPACE}+(.+)$"


def is_heading(line: Column) -> Column:
    return F.contains(line, F.lit("#")) & F.regexp_like(strip(line), F.lit(_HEADING))


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(strip(line), _HEADING, 1)).cast("bigint")


def heading_text(line: Column) -> Column:
    """The text of a heading line without the marks at either end."""
    return strip(F.regexp_replace(F.regexp_extract(strip(line), _HEADING, 2), rf"{SPACE}+#+$", ""))


def json_problem(
    text: Column, max_bytes: int = MAX_JSON_BYTES, max_depth: int = MAX_JSON_DEPTH
) -> Column:
    """Why a text is not acceptable JSON, null when it is.

    Depth is found on the brackets alone: each pass removes one level of empty pairs, so
    what is left after ``max_depth`` passes is too deep. Empty objects add no depth.
    """
    bare = F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "0")
    filled = F.regexp_replace(bare, r"\{\s*\}|\[\s*\]", "0")
    brackets = F.regexp_replace(filled, r"[^\[\]{}]+", "")
    for _ in range(max_depth):
        brackets = F.regexp_replace(brackets, r"\{\}|\[\]", "")
    return (
        F.when(text.isNull(), "invalid")
        .when(F.octet_length(text) > max_bytes, "too large")
        .when(F.try_parse_json(text).isNull(), "invalid")
        .when(brackets != "", "too deep")
    )


def json_in_text(text: Column) -> Column:
    """From the first opening to the last closing brace, null without both."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def context_block(
    podcast: Column, episode: Column, summary: Column, quotes: Column, concepts: Column,
    most: int = CONTEXT_ITEMS,
) -> Column:
    """What an interviewer is told: summary, first ``most`` quotes and concepts."""

    def section(title: str, items: Column) -> Column:
        listed = F.transform(F.slice(items, 1, most), lambda x: F.concat(F.lit("- "), x))
        lines = F.concat(F.array(F.lit(""), F.lit(title)), listed)
        some = F.coalesce(F.size(items) > 0, F.lit(False))
        return F.when(some, lines).otherwise(F.array().cast("array<string>"))

    head = F.array(
        F.concat(F.lit("Podcast: "), podcast), F.concat(F.lit("Episode: "), episode),
        F.lit(""), F.lit("Summary:"), summary,
    )
    return F.array_join(
        F.concat(head, section("Key Quotes:", quotes), section("Key Concepts:", concepts)), "\n"
    )


def result_label(
    success: Column, template: Column, from_cache: Column, seconds: Column, cost: Column,
    cost_known: Column, error: Column,
) -> Column:
    """One line on a result."""
    cached = F.when(from_cache, " (cached)").otherwise("")
    price = F.when(cost_known, F.format_string("$%.3f", cost)).otherwise("unknown (runtime-managed)")
    return F.when(
        success, F.format_string("✓ %s: Success%s (%.1fs, %s)", template, cached, seconds, price)
    ).otherwise(F.concat(F.lit("✗ "), template, F.lit(": Failed - "), F.coalesce(error, F.lit("None"))))
