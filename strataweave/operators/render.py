"""Rendering of recalled facts into text that keeps to a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.text import est_tokens, ymd


# Fixed values of the rendered format: the arrow, the header's `## Memory — `, the note on omitted lines, the heading of raw notes.
def pointer(path: Column, line_from: Column, line_to: Column) -> Column:
    """A file as a pointer: its path in backticks and the lines, if it has any."""
    lines = F.when(line_from.isNotNull() & (line_to != line_from), F.concat(F.lit(":"), line_from.cast("string"), F.lit("–"), line_to.cast("string")))
    return F.concat(F.lit("`"), path, F.lit("`"), F.coalesce(lines, F.concat(F.lit(":"), line_from.cast("string")), F.lit("")))


def timeline_line(statement: Column, valid_from: Column, valid_to: Column, recorded_at: Column, invalidated_at: Column) -> Column:
    """`start → end  statement` of a fact; the end is `now` while nothing has retracted it."""
    end = F.when(invalidated_at.isNotNull(), ymd(F.coalesce(valid_to, invalidated_at))).otherwise("now")
    return F.concat(ymd(F.coalesce(valid_from, recorded_at)), F.lit(" → "), end, F.lit("  "), F.trim(statement))


def with_pointers(lines: DataFrame, refs: DataFrame) -> DataFrame:
    """lines (..., line, episode_id) with the files (episode_id, path, line_from, line_to) of their episode below the line's text, by first line and path."""
    order = F.struct(F.coalesce("line_from", F.lit(0).cast("long")).alias("a"), "path", "line_from", "line_to")
    files = refs.groupBy("episode_id").agg(F.array_sort(F.collect_list(order)).alias("_files"))
    marks = F.array_join(F.transform("_files", lambda f: F.concat(F.lit("\n    "), pointer(f["path"], f["line_from"], f["line_to"]))), "")
    return lines.join(files, "episode_id", "left").withColumn("line", F.concat("line", F.coalesce(marks, F.lit("")))).drop("_files")


def within_budget(lines: DataFrame, budget: int) -> DataFrame:
    """Lines (query_id, pick, id, line, head) with `used`: best first, as many as the budget holds, the first one always.

    The header `head` is charged; running sums only grow, so the cut is a prefix.
    """
    order = Window.partitionBy("query_id").orderBy("pick").rowsBetween(Window.unboundedPreceding, 0)
    costs = lines.withColumn("used", est_tokens(F.col("head")) + F.sum(est_tokens(F.col("line"))).over(order))
    return costs.where((F.col("pick") == 1) | (F.col("used") <= budget))


def render(lines: DataFrame, budget: int) -> DataFrame:
    """Rows (query_id, text, ids): header, the lines that fit, and a note on how many were left out.

    The picks of a query are few (they come diversified and limited), so they are gathered per query.
    """
    shown = within_budget(lines, budget).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("pick", "id", "line"))).alias("l"), F.first("head").alias("head"), F.count("*").alias("shown")
    )
    total = lines.groupBy("query_id").agg(F.count("*").alias("total"))
    left = F.col("total") - F.col("shown")
    note = F.when(left > 0, F.concat(F.lit("- … "), left.cast("string"), F.lit(" more memories not shown (raise the budget or narrow the query)\n"))).otherwise("")
    return shown.join(total, "query_id").select("query_id", F.concat("head", F.array_join("l.line", ""), note).alias("text"), F.col("l.id").alias("ids"))


def pack(heads: DataFrame, lines: DataFrame, notes: DataFrame, budget: int) -> DataFrame:
    """Rows (query_id, text) for every query of heads (query_id, head): the rendered lines and, while the budget lasts, raw notes (query_id, rank, note).

    The note on omitted lines and the heading of the raw notes are not charged, notes have no first one that always
    shows, and a query with neither lines nor notes has an empty text.
    """
    shown = within_budget(lines, budget).groupBy("query_id").agg(F.max("used").alias("used"))
    cost = F.sum(est_tokens(F.col("note"))).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    costs = notes.join(heads.select("query_id", "head"), "query_id").join(shown, "query_id", "left").withColumn("used", F.coalesce("used", est_tokens(F.col("head"))) + cost)
    raw = costs.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.col("used") <= budget, F.struct("rank", "note")))).alias("n"))
    text = F.concat(
        F.coalesce("text", "head"),
        F.when(F.col("n").isNotNull(), F.concat(F.lit("\n### Raw notes\n"), F.array_join("n.note", ""))).otherwise(""),
    )
    both = heads.join(render(lines, budget).select("query_id", "text"), "query_id", "left").join(raw, "query_id", "left")
    return both.select("query_id", F.when(F.col("text").isNull() & F.col("n").isNull(), "").otherwise(text).alias("text"))


def raw_note(body: Column, recorded_at: Column) -> Column:
    """An episode as a line under the raw notes."""
    return F.concat(F.lit("- ("), ymd(recorded_at), F.lit(") "), F.trim(body), F.lit("\n"))
