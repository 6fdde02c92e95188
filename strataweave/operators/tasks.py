"""Task checkpoints: the state of a scope's task from the events that saved and closed it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Fixed values of the kept text: `[closed]`, `[in-progress task]`, `goal: `, `(status: closed)`.
def current(events: DataFrame) -> DataFrame:
    """Rows (scope_id, goal, state, files, opened_at, updated_at, closed) from events (scope_id, ts, action, state, goal, files, note).

    A save replaces the state and the files, keeps the first time and, unless it names one, the goal; a `done` adds a
    closing mark with its note. A scope without any save has no row.
    """
    saves = events.where("action = 'save'").groupBy("scope_id").agg(
        F.max_by(F.struct(F.trim("state").alias("state"), "files", "ts"), "ts").alias("s"),
        F.max_by("goal", F.when(F.col("goal").isNotNull(), F.col("ts"))).alias("goal"),
        F.min("ts").alias("opened_at"),
    )
    marks = events.where("action = 'done'").join(saves.select("scope_id", "s.ts").withColumnRenamed("ts", "_saved"), "scope_id").where("ts > _saved")
    marks = marks.groupBy("scope_id").agg(F.array_sort(F.collect_list(F.struct("ts", F.concat_ws(" ", F.lit("[closed]"), "note").alias("mark")))).alias("m"))
    both = saves.join(marks, "scope_id", "left")
    state = F.array_join(F.concat(F.array("s.state"), F.coalesce(F.col("m.mark"), F.array().cast("array<string>"))), "\n\n")
    return both.select("scope_id", "goal", state.alias("state"), "s.files", "opened_at", F.col("s.ts").alias("updated_at"), F.col("m").isNotNull().alias("closed"))


def as_note(goal: Column, state: Column, closed: Column) -> Column:
    """The text under which a checkpoint is kept as an episode."""
    return F.concat(
        F.lit("[in-progress task]\n"), F.when(goal.isNotNull(), F.concat(F.lit("goal: "), goal, F.lit("\n"))).otherwise(""), state, F.when(closed, "\n(status: closed)").otherwise("")
    )
