"""Running the caller's own functions (models, recognisers) inside Spark jobs.

The functions are slow or paid, so results are checkpointed at once: later actions read
them instead of calling again. Bound the number of calls at a time by the partitions of
the input (``repartition(n)``), never by collecting.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from castloom.functions.text import redact
from castloom.operators.results import parse_output
from castloom.operators.transcripts import merge_chunks, merge_pages, ocr_lines, parse_transcript
from castloom.session import shared_dir

_ANSWER = "raw_content string, input_tokens bigint, output_tokens bigint, cost_usd double, cost_known boolean"


def _patiently(call: Callable, attempts: int, first_wait: float, longest_wait: float):
    """Value and error of ``call``, tried again with growing, jittered waits."""
    wait = first_wait
    for attempt in range(1, attempts + 1):
        try:
            return call(), None
        except Exception as error:  # any failure of the caller's function fails its row only
            if attempt == attempts:
                return None, f"{type(error).__name__}: {error}"
            time.sleep(min(wait, longest_wait) * random.uniform(0.75, 1.25))
            wait *= 2


def _per_row(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], answer: str, keep: list[str],
    attempts: int, first_wait: float, longest_wait: float,
) -> DataFrame:
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    names = [part.strip().split(" ")[0] for part in answer.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.iloc[[i]].reset_index(drop=True)
                got, error = _patiently(lambda r=row: fn(r), attempts, first_wait, longest_wait)
                # An empty answer is one row of nulls, so that its row of work is not lost.
                told = got is not None and len(got) > 0
                out = pd.concat([row[keep]] * (len(got) if told else 1), ignore_index=True)
                for name in names:
                    out[name] = got[name].to_numpy() if told else None
                out["error"] = error
                yield out

    return df.mapInPandas(run, f"{kept}, {answer}, error string")


def run_extraction(
    work: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    *,
    attempts: int = 3,
    first_wait: float = 1.0,
    longest_wait: float = 10.0,
) -> DataFrame:
    """Call ``fn`` for each row of work and read its answer by the template's format.

    ``fn`` gets a frame of one row (prompt, template_name, provider, …) and returns
    raw_content, input_tokens, output_tokens, cost_usd and cost_known. A row whose calls
    all fail is a failed result, its message without API keys.
    """
    shared_dir(work.sparkSession)
    keep = [c for c in work.columns if c != "prompt"]
    called = _per_row(work, fn, _ANSWER, keep, attempts, first_wait, longest_wait).checkpoint()
    safe = called.withColumn("error", redact(F.col("error"))).fillna(
        {"input_tokens": 0, "output_tokens": 0, "cost_usd": 0.0, "cost_known": True}
    )
    return parse_output(safe)


def run_transcription(
    chunks: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    *,
    attempts: int = 3,
    first_wait: float = 1.0,
    longest_wait: float = 10.0,
) -> tuple[DataFrame, DataFrame]:
    """Merged segments of chunks (episode_id, chunk, …) that ``fn`` turns into text.

    Also the chunks that failed.
    """
    shared_dir(chunks.sparkSession)
    called = _per_row(
        chunks, fn, "text string", chunks.columns, attempts, first_wait, longest_wait
    ).checkpoint()
    segments = parse_transcript(called.where("error IS NULL"), "episode_id", "chunk")
    failed = called.where("error IS NOT NULL").select("episode_id", "chunk", redact(F.col("error")).alias("error"))
    return merge_chunks(segments), failed


_WORDS = (
    "word_no bigint, word string, block_no int, par_no int, line_no int, confidence double"
)


def run_ocr(
    images: DataFrame,
    pages: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    mode: str = "auto",
    *,
    attempts: int = 3,
    first_wait: float = 1.0,
    longest_wait: float = 10.0,
) -> tuple[DataFrame, DataFrame]:
    """Documents from page images (doc_id, page_no, content) that ``fn`` turns into words,
    merged with selectable page text; and the rejects."""
    shared_dir(images.sparkSession)
    called = _per_row(
        images, fn, _WORDS, ["doc_id", "page_no"], attempts, first_wait, longest_wait
    ).checkpoint()
    read = ocr_lines(called.where("error IS NULL AND word IS NOT NULL"))
    seen = called.where("error IS NULL").select("doc_id", "page_no").distinct()
    full = seen.join(read, ["doc_id", "page_no"], "left").fillna({"text": "", "confidence": 0.0})
    return merge_pages(pages, full, mode)


def render_with(results: DataFrame, fn: Callable[[pd.DataFrame], pd.Series]) -> Column:
    """Text of each result by the caller's function over frames of result rows."""

    @F.pandas_udf(StringType())
    def text(rows: pd.DataFrame) -> pd.Series:
        return fn(rows)

    return text(F.struct(*results.columns))
