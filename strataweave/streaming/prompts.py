"""The event path on Structured Streaming: prompts become episodes as they arrive, once each, and current values follow."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strataweave.functions import secrets, text

# Where agents put the prompt.
PROMPT_FIELDS = ("prompt", "user_prompt", "message", "text", "input")


def prompt_text(raw: str = "value") -> F.Column:
    """The prompt in a raw event: the first known field of its JSON, else the event as it stands."""
    fields = [F.get_json_object(raw, f"$.{f}") for f in PROMPT_FIELDS]
    return F.when(F.trim(raw).startswith("{"), F.coalesce(*fields)).otherwise(F.col(raw))


def kept_prompts(events: DataFrame, body: str = "body", globs: list[str] = (), most_chars: int = 4000) -> DataFrame:
    """Events worth keeping: skip rules, then redaction, then clipping, then the kind of statement and its identity.

    Works alike on a table and on a stream: only row-wise steps.
    """
    worth = events.where(text.skip_reason(F.col(body)).isNull())
    masked = worth.withColumn("_r", secrets.redact(F.col(body), list(globs)))
    out = masked.withColumns({body: text.clip(F.col("_r.text"), most_chars), "masked": F.col("_r.secrets") + F.col("_r.paths")}).drop("_r")
    return out.withColumns({"salient": text.salience(F.col(body)), "key": text.identity(text.normalize_text(F.col(body)))})


def run(events: DataFrame, out_path: str, checkpoint: str, body: str = "body", scope: str = "scope_id") -> StreamingQuery:
    """Drains a stream of prompts into Parquet, each (scope, normalized body) once for ever, late or not."""
    kept = kept_prompts(events, body).dropDuplicates([scope, "key"])
    return kept.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CURRENT = "scope_id long, src string, rel string, hash string, since long, changes long"


def current_values(facts: DataFrame) -> DataFrame:
    """Rows (CURRENT) per update: the live value of each single-valued (scope_id, src, rel) of a stream of facts.

    State holds one value per key. Order is that of arrival, also for facts that became valid in the past.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, since, changes = state.get if state.exists else (None, 0, 0)
        for b in batches:
            for h, ts in b.sort_values(["ts", "id"])[["hash", "ts"]].itertuples(index=False):
                if h != now:
                    now, since, changes = h, int(ts), changes + 1
        state.update((now, since, changes))
        yield pd.DataFrame([[*key, now, since, changes]], columns=[c.split()[0] for c in CURRENT.split(", ")])

    return facts.groupBy("scope_id", "src", "rel").applyInPandasWithState(update, CURRENT, "hash string, since long, changes long", "update", GroupStateTimeout.NoTimeout)


def drain(queue: DataFrame, consolidate, checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch of pending episodes to `consolidate(batch, batch_id)`; the checkpoint remembers what is done."""
    return queue.writeStream.foreachBatch(consolidate).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answer_then_keep(batch: DataFrame, facts: DataFrame, entities: DataFrame, now_ts: int, limit: int = 6, globs: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(picks, kept) of a micro-batch of prompts (id, scope_id, body), for use inside foreachBatch.

    Recall comes before the store, so that no prompt is answered with itself: `facts` are those before the batch. Prompts
    too short to keep are answered, acknowledgements, commands and empty ones are not. picks: query_id, id, score, pick.
    """
    from strataweave.operators import fusion

    reason = F.coalesce(text.skip_reason(F.col("body")), F.lit(""))
    asked = batch.where(reason.isin("", "too short")).select(F.col("id").alias("query_id"), F.col("body").alias("text"), "scope_id")
    return fusion.recall(asked, facts, entities, now_ts, limit), kept_prompts(batch, globs=globs)


def on_session_end(store: DataFrame, now_ts: int, most: int = 200):
    """A function (batch, batch_id) for `drain`: hands the pending episodes of each batch to the consolidation of `store` facts and counts them."""
    from strataweave.operators import writes

    report: list[tuple[int, DataFrame, int]] = []

    def run(batch: DataFrame, batch_id: int) -> None:
        facts, done = writes.consolidate(store, batch, now_ts, most)
        report.append((batch_id, facts, done.count()))

    run.report = report
    return run
