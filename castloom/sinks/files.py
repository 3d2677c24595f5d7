"""Many small text files, one to a folder, as people keep notes and transcripts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import groupby
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: Characters that Spark escapes in the names of partition folders, and its name for null.
ESCAPED = {*map(chr, range(1, 32)), *"\"#%'*/:=?\\\x7f{[]^"}
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _folder(name: str, value: str | None) -> str:
    safe = "".join(f"%{ord(c):02X}" if c in ESCAPED else c for c in value or NO_VALUE)
    return f"{name}={safe}"


def write_texts(rows: DataFrame, folder: str, keys: Sequence[str]) -> None:
    """One file per value of the keys, in folders ``key=value``; a line for each ``value``.

    The layout of a partitioned text table. On a mounted disk Spark's own writer starts a
    process for each file and folder it makes, if Hadoop's native code is missing, which takes
    longer than all the rest; there each task opens its files itself, and one that runs again
    writes the same. Other stores are left to Spark.
    """
    place = urlsplit(folder)
    if place.scheme not in ("", "file"):
        rows.select(*keys, "value").repartition(*keys).write.partitionBy(*keys).text(folder)
        return
    Path(place.path).mkdir(parents=True)
    texts = rows.select(*(F.col(k).cast("string").alias(k) for k in keys), "value")
    dealt = texts.repartition(*keys).sortWithinPartitions(*keys)
    dealt.foreachPartition(lambda part: _write(part, place.path, keys))


def _write(rows: Iterable[Row], folder: str, keys: Sequence[str]) -> None:
    for values, some in groupby(rows, lambda r: [r[k] or None for k in keys]):
        place = Path(folder, *map(_folder, keys, values))
        place.mkdir(parents=True, exist_ok=True)
        with open(place / "text.txt", "wb") as out:
            out.writelines(f"{r['value'] or ''}\n".encode() for r in some)
