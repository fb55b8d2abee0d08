"""Sinks: JSONL folders, and single files for results of a bounded size."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SINGLE_BYTES = 256 << 20


def write_jsonl(documents: DataFrame, path: str, json_col: str = "json", compression: str = "none") -> None:
    """A folder of JSONL parts; Spark's committer makes it appear whole.  ``gzip`` parts are read by ``read_jsonl`` as they are."""
    documents.select(F.col(json_col).alias("value")).write.mode("overwrite").text(path, compression=compression)


def low_confidence(documents: DataFrame, minimum: float) -> DataFrame:
    return documents.filter(F.col("confidence") < F.lit(minimum))


def write_single(documents: DataFrame, path: str, pretty: bool = False, json_col: str = "json", max_bytes: int = MAX_SINGLE_BYTES) -> int:
    """One local .json or .jsonl file, put in place only when it is whole; returns the number of documents.

    A result of more than ``max_bytes`` is an error: it belongs in ``write_jsonl``.  A .json file holds the
    document itself if there is one, else an array.
    """
    size, n = documents.agg(F.coalesce(F.sum(F.octet_length(json_col)), F.lit(0)), F.count("*")).first()
    if size > max_bytes:
        raise ValueError(f"{size} bytes are too many for one file; write_jsonl takes any number")
    temporary = f"{path}.tmp"
    try:
        with open(temporary, "w", encoding="utf-8") as f:
            if path.lower().endswith(".jsonl"):
                for row in documents.select(json_col).toLocalIterator():
                    f.write(row[0] + "\n")
            else:
                items = [json.loads(row[0]) for row in documents.select(json_col).toLocalIterator()]
                json.dump(items[0] if len(items) == 1 else items, f, ensure_ascii=False, indent=2 if pretty else None)
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise
    return n
