"""Token totals by source, language and tokenizer version, kept up to date by signed deltas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from castloom.llm.base import pick

INSERT, REVISE, DELETE = "insert", "revise", "delete"
_STATE = "doc_id bigint, version string, source string, lang string, tokens bigint, deleted boolean, batch bigint"
_DELTAS = "source string, lang string, version string, docs bigint, tokens bigint, batch bigint"
_COMMITS = "batch bigint"


@dataclass
class Rollup:
    """Totals in a shared folder: signed deltas, the state of each document, and commits.

    A batch writes its part of `state` and `deltas` into folders of its own and its commit
    last. Readers see committed batches only, so a batch that was lost half way is written
    again as a whole, and one that is committed is not applied again.
    """

    spark: SparkSession
    folder: str

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        if not there:
            return self.spark.createDataFrame([], schema)
        parts = self.spark.read.schema(schema).option("recursiveFileLookup", "true")
        return parts.parquet(f"{self.folder}/{name}")

    def batches(self) -> list[int]:
        """Committed batches: one number each, whatever their size."""
        return sorted(r[0] for r in self._read("commits", _COMMITS).distinct().collect())

    def _committed(self, name: str, schema: str, batches: list[int]) -> DataFrame:
        return self._read(name, schema).where(F.col("batch").isin(batches))

    def state(self) -> DataFrame:
        """What is known of each document and version: the rows of its latest batch."""
        return _latest(self._committed("state", _STATE, self.batches()), F.col("batch"))

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Commit one batch of changes (op, doc_id, version, source, lang, tokens and optionally
        seq); False if the batch is committed already.

        insert and revise set a document's count under a version, whatever was there before;
        delete takes it away, and does nothing to a document that is not there. Of several
        changes of one document and version in a batch, the one with the greatest seq counts,
        of equal ones a delete, then the largest count. Null ids, versions, sources and
        languages are keys like any other, null counts are 0. Batches come in rising numbers.
        """
        done = self.batches()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}")
        seq = F.col("seq") if "seq" in changes.columns else F.lit(0)
        new = changes.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            "version",
            "source",
            "lang",
            F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("tokens"),
            (F.col("op") == DELETE).alias("deleted"),
            F.lit(batch).cast("long").alias("batch"),
            seq.alias("seq"),
        )
        order = F.struct("seq", F.col("deleted"), "tokens", "source", "lang")
        new = _latest(new, order).drop("seq")
        path = lambda name: f"{self.folder}/{name}/{batch}"
        new.write.mode("overwrite").parquet(path("state"))
        new = self.spark.read.schema(_STATE).parquet(path("state"))

        # Only documents that change are looked up; both sides have one row a key.
        before = self._committed("state", _STATE, done)
        keys = new.select(F.col("doc_id").alias("d"), F.col("version").alias("v"))
        same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("version").eqNullSafe(F.col("v"))
        before = _latest(before.join(keys, same, "left_semi"), F.col("batch"))
        signed = before.where("not deleted").select("source", "lang", "version", F.lit(-1).alias("sign"), "tokens")
        signed = signed.unionByName(
            new.where("not deleted").select("source", "lang", "version", F.lit(1).alias("sign"), "tokens")
        )
        deltas = signed.groupBy("source", "lang", "version").agg(
            F.sum("sign").cast("long").alias("docs"),
            F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("tokens"),
        )
        deltas = deltas.where("docs <> 0 or tokens <> 0").withColumn("batch", F.lit(batch).cast("long"))
        deltas.write.mode("overwrite").parquet(path("deltas"))
        commit = self.spark.range(1).select(F.lit(batch).cast("long").alias("batch"))
        commit.write.mode("overwrite").parquet(path("commits"))
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens: the sum of all committed deltas."""
        deltas = self._committed("deltas", _DELTAS, self.batches())
        sums = deltas.groupBy("source", "lang", "version").agg(
            F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")
        )
        return sums.where("n_docs <> 0 or n_tokens <> 0")


def _latest(rows: DataFrame, order: Column) -> DataFrame:
    """One row for each document and version: the one with the greatest order."""
    others = [c for c in rows.columns if c not in ("doc_id", "version")]
    best = F.max(F.struct(order.alias("order"), F.struct(*others).alias("row"))).alias("best")
    return rows.groupBy("doc_id", "version").agg(best).select(
        "doc_id", "version", *(F.col(f"best.row.{c}").alias(c) for c in others)
    )


def changes(
    docs: DataFrame,
    op: str,
    version: str,
    tokens: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
) -> DataFrame:
    """The same change for each document; `tokens` is an expression over `text`."""
    rows = pick(docs, doc_id=doc_id, text=text, source=source, lang=lang)
    return rows.select(
        F.lit(op).alias("op"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.lit(version).alias("version"),
        "source",
        "lang",
        tokens.cast("long").alias("tokens"),
    )


#: Twin of the totals of query op6, for DuckDB.
TOTALS_SQL = r"""
WITH counted AS (
    SELECT source, lang, coalesce(text, '') AS t,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
    FROM documents
), versions AS (
    SELECT source, lang, 'words-1' AS version, words AS n,
        len(list_filter(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), lambda w: w <> '|')) AS revised,
        t LIKE '%|%' AS bars, words
    FROM counted
    UNION ALL
    SELECT source, lang, 'quarters-1', (length(t) + 3) // 4, 0, false, words FROM counted
)
SELECT source, lang, version, count(*) AS n_docs,
    CAST(sum(CASE WHEN bars THEN revised ELSE n END) AS BIGINT) AS n_tokens
FROM versions WHERE words >= 10 GROUP BY ALL
"""
