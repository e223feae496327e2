"""Removing attributes from GTF lines, and matrices of a source attribute."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Attributes that are always kept, and how those of merged files begin.
ALWAYS, OWN = ("gene_id", "transcript_id"), "ISOM_"


def chopped(attrs: Column, keep: Sequence[str] = (), *, everything: bool = False, check_case: bool = False) -> Column:
    """Attributes without those of merged files, or without all, that are not kept; ``.`` where none is left."""
    fold = (lambda c: c) if check_case else F.lower
    kept = sorted({k if check_case else k.lower() for k in (*ALWAYS, *(x.strip() for x in keep)) if k})

    def stays(a: Column) -> Column:
        key = fold(F.regexp_extract(a, r"^([^ \t=]*)", 1))
        listed = key.isin(*kept)
        return listed if everything else listed | ~key.startswith(OWN if check_case else OWN.lower())

    parts = F.filter(F.transform(F.split(attrs, ";"), lambda a: F.regexp_replace(a, r"^[ \t\r\n\f]+|[ \t\r\n\f]+$", "")), lambda a: a != "")
    left = F.transform(F.filter(parts, stays), lambda a: F.concat(a, F.lit(";")))
    return F.when(F.size(left) == 0, ".").otherwise(F.array_join(left, " "))


def chop_lines(value: Column, **options) -> Column:
    """Whole lines; comments and lines with fewer than 9 columns pass as they are, a carriage return stays."""
    body = F.regexp_extract(value, r"(?s)^((?:[^\t]*\t){8})(.*?)(\r?)$", 1)
    attrs, end = F.regexp_extract(value, r"(?s)^(?:[^\t]*\t){8}(.*?)(\r?)$", 1), F.regexp_extract(value, r"(?s)^(?:[^\t]*\t){8}(.*?)(\r?)$", 2)
    return F.when(value.startswith("#") | (body == ""), value).otherwise(F.concat(body, chopped(attrs, **options), end))


def projection(merged: DataFrame) -> DataFrame:
    """(file_id, src_tx_id, merged_tx_id) from (merged_tx_id, src, line_no): the last line wins a source transcript."""
    p = merged.select("merged_tx_id", "line_no", F.explode(F.split("src", r"\|")).alias("rec"))
    c = F.split("rec", ":", 3)
    number = F.regexp_replace(c[0], "^S*", "").try_cast("int")
    ok = F.coalesce((F.size(c) >= 2) & (number > 0) & (c[1] != ""), F.lit(False))
    number = F.when(ok, number).otherwise(F.raise_error(F.concat(F.lit("bad source record: "), F.coalesce("rec", F.lit("")))).cast("int"))
    return p.select("merged_tx_id", "line_no", number.alias("file_id"), c[1].alias("src_tx_id")).groupBy("file_id", "src_tx_id").agg(F.max_by("merged_tx_id", "line_no").alias("merged_tx_id"))


def value_rows(projected: DataFrame, source: DataFrame) -> DataFrame:
    """Source rows (file_id, src_tx_id, value, line_no) with the merged transcript they belong to, if any."""
    return source.join(projected, ["file_id", "src_tx_id"], "left")


def value_cells(merged: DataFrame, rows: DataFrame, files: Sequence[int]) -> DataFrame:
    """(transcript_id, cells): the cells (at, value) of a merged transcript that have a value, by place in ``files``; the last value of a file wins."""
    spark = merged.sparkSession
    places = spark.createDataFrame([(i, at) for at, i in enumerate(files)], "file_id int, at int")
    known = rows.filter("merged_tx_id is not null and value <> ''").groupBy("merged_tx_id", "file_id").agg(F.max_by("value", "line_no").alias("value"))
    # one row an input; a merged transcript has at most as many cells
    placed = known.join(F.broadcast(places), "file_id").groupBy("merged_tx_id").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("cells"))
    out = merged.select(F.col("merged_tx_id").alias("transcript_id")).join(placed, F.col("transcript_id") == F.col("merged_tx_id"), "left")
    return out.select("transcript_id", F.coalesce("cells", F.array().cast("array<struct<at:int,value:string>>")).alias("cells"))


def filled_line(cells: Column, n: int, default: str, sep: str = "\t") -> Column:
    """n fields in one text: ``cells`` (at, value), sorted by distinct places, and ``default`` in between. Work grows with the cells and the text, not with columns of a plan."""
    gap = lambda c, i: c["at"] - F.coalesce(F.get(cells, i - 1)["at"], F.lit(-1)) - 1
    shown = F.transform(cells, lambda c, i: F.concat(F.repeat(F.lit(default + sep), gap(c, i)), c["value"]))
    rest = F.repeat(F.lit(sep + default), F.lit(n - 1) - F.get(cells, F.size(cells) - 1)["at"])
    return F.when(F.size(cells) == 0, F.lit(sep.join([default] * n))).otherwise(F.concat(F.array_join(shown, sep), rest))


def value_matrix(merged: DataFrame, rows: DataFrame, files: list[tuple[int, str]], default: str = "0.0") -> DataFrame:
    """transcript_id and one column per (file id, name), for a few files; ``default`` stands where there is no value."""
    cells = value_cells(merged, rows, [i for i, _ in files]).withColumn("by", F.map_from_entries("cells"))
    return cells.select("transcript_id", *(F.coalesce(F.element_at("by", F.lit(at)), F.lit(default)).alias(name) for at, (_, name) in enumerate(files)))


def value_stats(rows: DataFrame) -> DataFrame:
    """Per file: values taken, transcripts without the attribute, transcripts not in the merged set."""
    known = F.col("merged_tx_id").isNotNull()
    return rows.groupBy("file_id").agg(
        F.count_if(known & (F.col("value") != "")).alias("extracted"), F.count_if(known & (F.col("value") == "")).alias("attr_missing"), F.count_if(~known).alias("src_tx_not_in_merged")
    )
