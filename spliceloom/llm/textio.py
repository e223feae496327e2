"""Shared plumbing of the per-document operators: Arrow batches in, Arrow batches out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of A-Z lower-cased, nothing else.
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def per_document(docs: DataFrame, schema: str, rows: Callable[[int, str | None], tuple], id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``rows(id, text, *also)`` gives its values in the order of ``schema``.

    Only the named columns are read. Ids may be null or repeat; each input row gives one row.
    """
    from pyspark.sql.types import _parse_datatype_string  # the public way to parse a DDL string needs a session
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [rows(*v) for v in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            cols = list(zip(*out, strict=True)) if out else [()] * len(target)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target, strict=True)], schema=target)

    return docs.select(F.col(id_col), F.col(text_col), *(F.col(c) for c in also)).mapInArrow(run, schema)
