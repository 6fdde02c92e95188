"""Bounded snippets of text files with their language and the lines they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions.text import language_of_path

HEAD_LINES, MOST_CHARS = 60, 2000
MARK = "… (truncated)"


def snippet(content: Column, line_from: Column, line_to: Column) -> Column:
    """Struct (snippet, line_from, line_to): the lines asked for, clamped, or the file's head; -1 where cut by characters."""
    lines = F.split(content, "\n", -1)
    n = F.size(lines)
    low = F.coalesce(F.least(F.greatest(line_from, F.lit(1)), n), F.lit(1)).cast("int")
    high = F.when(line_from.isNull(), F.greatest(F.lit(1), F.least(F.lit(HEAD_LINES), n))).otherwise(F.least(F.greatest(line_to, line_from), n)).cast("int")
    high = F.greatest(low, high)
    body = F.array_join(F.slice(lines, low, high - low + 1), "\n")
    long = F.char_length(body) > MOST_CHARS
    cut = F.when(long, F.substring(body, 1, MOST_CHARS)).otherwise(body)
    gap = F.when((cut == "") | cut.endswith("\n"), "").otherwise("\n")
    marked = F.when(long | (high < n), F.concat(cut, gap, F.lit(MARK))).otherwise(cut)
    return F.struct(marked.alias("snippet"), low.cast("long").alias("line_from"), F.when(long, F.lit(-1)).otherwise(high).cast("long").alias("line_to"))


def read_files(spark: SparkSession, paths: str | list[str], asked: DataFrame | None = None) -> DataFrame:
    """Rows (path, lang, snippet, line_from, line_to) of whole text files; asked (path, line_from, line_to) names ranges.

    Files without content have no row: Spark's readers do not open them.
    """
    files = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.decode("content", "UTF-8").alias("content"))
    if asked is None:
        files = files.withColumns({"line_from": F.lit(None).cast("long"), "line_to": F.lit(None).cast("long")})
    else:
        files = files.join(asked, "path", "left")
    return files.select("path", language_of_path(F.col("path")).alias("lang"), snippet(F.col("content"), F.col("line_from"), F.col("line_to")).alias("s")).select("path", "lang", "s.*")
