"""The write side as set operations: deduplication, entity resolution, supersession, retraction, maintenance.

Every operator takes snapshots and returns the new one; nothing is changed in place. Times come in as parameters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions import secrets, text
from strataweave.operators import vectors
from strataweave.operators.intervals import borders, in_shards, same_keys
from strataweave.session import kept

# Relations of which a subject holds one value at a time.
SINGLE_VALUED = "uses prefers is has_status runs_on lives_in assigned_to version named defaults_to targets".split()
DAY = text.DAY


def with_identity(episodes: DataFrame, body: str = "body") -> DataFrame:
    """episodes with `key`, the hash of the normalized body under which equal notes are one."""
    return episodes.withColumn("key", text.identity(text.normalize_text(F.col(body))))


def first_episodes(episodes: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Of the episodes with one (scope_id, hash) the first by (recorded_at, id); none that `existing` already has.

    The first is found by an aggregation, not by a window, so that a body that a third of all rows share is no problem.
    """
    rows = episodes if existing is None else episodes.join(existing.select("scope_id", "hash"), ["scope_id", "hash"], "left_anti")
    first = rows.groupBy("scope_id", "hash").agg(F.min_by("id", F.struct("recorded_at", "id")).alias("id"))
    return rows.join(first.select("id"), "id", "left_semi")


def resolve_entities(names: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """names (scope_id, name, ...) with norm and entity_id: by alias first, then by norm; null where neither knows it."""
    rows = names.withColumn("norm", text.normalize_text(F.col("name")))
    by_alias = aliases.groupBy("scope_id", "norm").agg(F.max("entity_id").alias("_alias"))
    by_norm = entities.groupBy("scope_id", "norm").agg(F.min("id").alias("_own"))
    out = rows.join(by_alias, ["scope_id", "norm"], "left").join(by_norm, ["scope_id", "norm"], "left")
    return out.withColumn("entity_id", F.coalesce("_alias", "_own")).drop("_alias", "_own")


def upsert_aliases(aliases: DataFrame, changes: DataFrame) -> DataFrame:
    """aliases (entity_id, scope_id, norm) with those of changes (entity_id, scope_id, norm, seq) in their place; of several the last by (seq, entity_id)."""
    last = changes.where("norm <> ''").groupBy("scope_id", "norm").agg(F.max_by("entity_id", F.struct("seq", "entity_id")).alias("entity_id"))
    kept_ = aliases.select("entity_id", "scope_id", "norm").join(last.select("scope_id", "norm"), ["scope_id", "norm"], "left_anti")
    return kept_.unionByName(last)


def new_entities(names: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows (scope_id, norm, name, kind) to insert: unknown names once, with the first name and the first kind not null."""
    unknown = resolve_entities(names, entities, aliases).where(F.col("entity_id").isNull() & (F.col("norm") != ""))
    order = F.struct("seq", "name")
    return unknown.groupBy("scope_id", "norm").agg(F.min_by("name", order).alias("name"), F.min_by("kind", F.when(F.col("kind").isNotNull(), order)).alias("kind"))


def supersedes(rel: Column, src: Column, flag: Column) -> Column:
    """Whether a fact replaces the live ones of its key: as its flag says, else if its relation holds one value."""
    return src.isNotNull() & F.coalesce(flag, F.lower(rel).isin(*SINGLE_VALUED))


REPLAYED = "scope_id long, src string, rel string, hash string, id long, valid_from long, valid_to long, recorded_at long, confidence double, invalidated_at long, invalidated_by long"
_KEY = ["scope_id", "src", "rel"]


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by key and time: keeps the live facts of the key at hand, hands out what is closed."""
    at, live = None, {}
    columns = [c.split()[0] for c in REPLAYED.split(", ")]

    def done(facts) -> list[list]:
        return [[*at, h, *f] for h, f in facts.items()]

    for b in batches:
        out: list[list] = []
        clean = b.astype(object).where(b.notna(), None)
        for scope, src, rel, h, i, ts, start, end, sure, over in clean[["scope_id", "src", "rel", "hash", "id", "ts", "valid_from", "valid_to", "confidence", "over"]].itertuples(index=False):
            if (scope, src, rel) != at:
                out += done(live)
                at, live = (scope, src, rel), {}
            if h in live:
                live[h][3], live[h][4] = max(live[h][3], ts), max(live[h][4], sure)
                continue
            begin = ts if start is None else start
            if over:
                for f in live.values():
                    f[2], f[5], f[6] = begin if f[2] is None else f[2], ts, i
                out += done(live)
                live = {}
            live[h] = [i, begin, end, ts, sure, None, None]
        yield pd.DataFrame(out, columns=columns)
    if at is not None:
        yield pd.DataFrame(done(live), columns=columns)


def _runs(rows: DataFrame, shards: int | None) -> DataFrame:
    """Rows (key, hash, id, begin, valid_to, recorded_at, confidence, born, next): successive equal facts of a key as one.

    next holds (begin, born, id) of the run that follows. Rows are cut into time shards of equal size, and runs are found
    per shard; what a shard begins with is joined to the run that an earlier shard ends with over a table that has at
    most two rows per shard.
    """
    by = ["shard", *_KEY]
    w = Window.partitionBy(*by).orderBy("ts", "id")
    runs = in_shards(rows, _KEY, ["ts", "id"], shards).withColumn("new", (~F.lag("hash").over(w).eqNullSafe(F.col("hash"))).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = lambda c: F.min_by(c, F.struct("ts", "id")).alias(c)
    runs = runs.groupBy(*by, "run").agg(first("hash"), first("id"), first("begin"), first("valid_to"), F.max("ts").alias("recorded_at"), F.max("confidence").alias("confidence"), F.min("ts").alias("born"))
    follower = F.struct("begin", "born", "id")
    runs = kept(runs.withColumn("next", F.lead(follower).over(Window.partitionBy(*by).orderBy("run"))))
    ends = runs.groupBy(*by).agg(
        F.max("run").alias("n"), F.min_by("hash", "run").alias("head"), F.max_by("hash", "run").alias("tail"),
        F.min_by(F.struct(follower.alias("own"), "next", "recorded_at", "confidence"), "run").alias("one"),
    )
    over = Window.partitionBy(*_KEY).orderBy("shard")
    ends = borders(ends, _KEY).withColumn("goes_on", F.coalesce(F.lag("tail").over(over) == F.col("head"), F.lit(False)))
    # A shard that goes on and has one run only passes on the run that reaches it.
    origin = F.last(F.when(~F.col("goes_on") | (F.col("n") > 1), F.col("shard")), ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    own = F.when(~F.col("goes_on"), F.col("one.own")).otherwise(F.col("one.next"))
    ends = kept(ends.withColumns({"origin": F.when(F.col("goes_on"), origin), "beyond": F.first(own, ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing))}))
    added = ends.where("goes_on").groupBy(*_KEY, F.col("origin").alias("shard")).agg(F.max("one.recorded_at").alias("more_rec"), F.max("one.confidence").alias("more_conf"))
    side = lambda l, r: (F.col(f"{l}.shard") == F.col(f"{r}.shard")) & same_keys(l, r, _KEY)
    ends = ends.alias("e").join(F.broadcast(added).alias("a"), side("e", "a"), "left").select("e.*", "more_rec", "more_conf")
    out = runs.alias("l").join(F.broadcast(ends).alias("e"), side("l", "e"), "left").where(~F.coalesce(F.col("goes_on") & (F.col("run") == 1), F.lit(False)))
    is_last = F.col("run") == F.col("n")
    return out.select(
        *[F.col(f"l.{c}").alias(c) for c in _KEY], "hash", "id", "begin", "valid_to", "born",
        F.greatest("recorded_at", F.when(is_last, F.col("more_rec"))).alias("recorded_at"), F.greatest("confidence", F.when(is_last, F.col("more_conf"))).alias("confidence"),
        F.coalesce("next", F.when(is_last, F.col("beyond"))).alias("next"),
    )


def replay(inserts: DataFrame, shards: int | None = None) -> DataFrame:
    """The facts (REPLAYED) that inserting `inserts` in the order of (ts, id) leaves, closed ones included.

    inserts: scope_id, src, rel, hash, id, ts, valid_from, valid_to, confidence, over (whether the fact supersedes).
    A fact equal to a live one only refreshes it. Keys whose rows all supersede go by window functions in time shards
    (`shards` of them, `spark.sql.shuffle.partitions` if not given), keys of which none does by aggregation; the rest,
    where one row's effect hangs on all before it, is folded in one pass over rows sorted by key, holding the live facts of one key only. A null src supersedes nothing
    and is closed by nothing. Repeated (ts, id) are not expected; no rows give no facts.
    """
    kinds = inserts.groupBy(*_KEY).agg(F.bool_and("over").alias("every"), F.bool_or("over").alias("some"))
    rows = inserts.alias("i").join(kinds.alias("k"), same_keys("i", "k", _KEY)).select("i.*", "every", "some")
    rows = rows.withColumn("begin", F.coalesce("valid_from", "ts"))

    runs = _runs(rows.where("every").select(*_KEY, "hash", "id", "ts", "begin", "valid_to", "confidence"), shards)
    out = [*_KEY, "hash", "id", F.col("begin").alias("valid_from")]
    replaced = runs.select(*out, F.coalesce("valid_to", "next.begin").alias("valid_to"), "recorded_at", "confidence", F.col("next.born").alias("invalidated_at"), F.col("next.id").alias("invalidated_by"))

    first = lambda c: F.min_by(c, F.struct("ts", "id")).alias(c)
    kept = rows.where(~F.col("some")).groupBy(*_KEY, "hash").agg(first("id"), first("begin"), first("valid_to"), F.max("ts").alias("recorded_at"), F.max("confidence").alias("confidence"))
    none = F.lit(None).cast("long")
    kept = kept.select(*out, "valid_to", "recorded_at", "confidence", none.alias("invalidated_at"), none.alias("invalidated_by"))

    mixed = rows.where(F.col("some") & ~F.col("every")).select("scope_id", "src", "rel", "hash", "id", "ts", "valid_from", "valid_to", "confidence", "over")
    folded = mixed.repartition(*_KEY).sortWithinPartitions(*_KEY, "ts", "id").mapInPandas(_fold, REPLAYED)
    return replaced.unionByName(kept).unionByName(folded)


def derive_facts(episodes: DataFrame) -> DataFrame:
    """Rows (episode_id, scope_id, src, rel, dst, statement): the fact that a note states, anchored at its first two entities."""
    named = episodes.withColumn("e", secrets.extract_entities(F.col("body")))
    return named.select(F.col("id").alias("episode_id"), "scope_id", F.get("e", F.lit(0)).alias("src"), text.relation_of_kind(F.col("kind")).alias("rel"), F.get("e", F.lit(1)).alias("dst"), F.col("body").alias("statement"))


def remember(notes: DataFrame, given: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What storing notes (note_id, scope_id, kind, body, recorded_at, derive) leaves to write: (episodes, facts).

    given: note_id, seq, src, rel, dst, statement, valid_from, valid_to, confidence, supersede; existing: id, scope_id, hash.
    A note whose identity its scope knows, from `existing` or from an earlier note by (recorded_at, note_id), adds no
    episode, but its facts are written all the same and belong to the known episode. Facts that were given win; a note
    without any states one itself if `derive` says so, and such a fact never supersedes. Blank notes are left out.

    episodes: id (the note's), scope_id, kind, body, hash, recorded_at. facts: note_id, episode_id, scope_id, seq,
    src, rel, dst, statement, valid_from, valid_to, confidence, recorded_at, over, derived.
    """
    rows = notes.withColumn("body", F.regexp_replace("body", f"^{text.BLANKS}+|{text.BLANKS}+$", "")).where("body <> ''")
    rows = kept(rows.withColumn("hash", text.identity(text.normalize_text(F.col("body")))))
    first = rows.groupBy("scope_id", "hash").agg(F.min_by("note_id", F.struct("recorded_at", "note_id")).alias("first"))
    known = existing.groupBy("scope_id", "hash").agg(F.min("id").alias("known"))
    keys = kept(first.join(known, ["scope_id", "hash"], "left"))
    new = rows.join(keys.where("known IS NULL").select(F.col("first").alias("note_id")), "note_id", "left_semi")
    episodes = new.select(F.col("note_id").alias("id"), "scope_id", "kind", "body", "hash", "recorded_at")
    of = rows.join(keys, ["scope_id", "hash"]).select("note_id", "scope_id", F.coalesce("known", "first").alias("episode_id"), "recorded_at")
    told = given.join(of, "note_id").select(
        "note_id", "episode_id", "scope_id", "seq", "src", "rel", "dst", "statement", "valid_from", "valid_to", "confidence", "recorded_at",
        supersedes(F.col("rel"), F.col("src"), F.col("supersede")).alias("over"), F.lit(False).alias("derived"),
    )
    silent = rows.where("derive").join(given.select("note_id").distinct(), "note_id", "left_anti").withColumn("id", F.col("note_id"))
    own = derive_facts(silent).withColumnRenamed("episode_id", "note_id").drop("scope_id").join(of, "note_id")
    none = F.lit(None).cast("long")
    own = own.select(
        "note_id", "episode_id", "scope_id", F.lit(0).cast("long").alias("seq"), "src", "rel", "dst", "statement", none.alias("valid_from"), none.alias("valid_to"),
        F.lit(1.0).alias("confidence"), "recorded_at", F.lit(False).alias("over"), F.lit(True).alias("derived"),
    )
    return episodes, told.unionByName(own)


def forget(facts: DataFrame, ids: DataFrame, now_ts: int) -> DataFrame:
    """facts with those of ids (id) retracted at now_ts; facts already retracted stay as they are.

    Where ids have a scope_id, a fact is retracted only by a row of its own scope.
    """
    on = ["id", "scope_id"] if "scope_id" in ids.columns else ["id"]
    named = facts.join(ids.select(*on, F.lit(True).alias("_named")).distinct(), on, "left")
    now = F.lit(now_ts).cast("long")
    hit = F.col("_named").isNotNull() & F.col("invalidated_at").isNull()
    return named.withColumns({"valid_to": F.when(hit, F.coalesce("valid_to", now)).otherwise(F.col("valid_to")), "invalidated_at": F.when(hit, now).otherwise(F.col("invalidated_at"))}).drop("_named")


def purge(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """facts without those of ids (id)."""
    return facts.join(ids.select("id"), "id", "left_anti")


def purge_episodes(facts: DataFrame, episodes: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, episodes) without the episodes of ids (id) and the facts that came from them."""
    return facts.join(ids.select(F.col("id").alias("episode_id")), "episode_id", "left_anti"), episodes.join(ids.select("id"), "id", "left_anti")


def mark_hits(facts: DataFrame, shown: DataFrame, now_ts: int) -> DataFrame:
    """facts with their hits raised by how often they stand in shown (id)."""
    times = shown.groupBy("id").agg(F.count("*").alias("_n"))
    out = facts.join(times, "id", "left")
    return out.withColumns({"hits": F.col("hits") + F.coalesce("_n", F.lit(0)), "last_hit": F.when(F.col("_n") > 0, F.lit(now_ts).cast("long")).otherwise(F.col("last_hit"))}).drop("_n")


def prunable(facts: DataFrame, now_ts: int, days: int = 90) -> DataFrame:
    """Facts retracted more than `days` days ago that nobody ever read."""
    return facts.where((F.col("invalidated_at") < now_ts - days * DAY) & (F.col("hits") == 0))


def pending(episodes: DataFrame, done: DataFrame, most: int | None = None) -> DataFrame:
    """Episodes not in done (id), first come first; at most `most` when a batch size is given."""
    rows = episodes.join(done.select("id"), "id", "left_anti").orderBy("id")
    return rows.limit(most) if most else rows


def file_references(texts: DataFrame, id_: str, column: str) -> DataFrame:
    """Rows (episode_id, path, lang): the files that a text names, each once per text."""
    paths = F.array_distinct(F.regexp_extract_all(column, F.lit(r"(?:^|[\s`(\"'])((?:[\w.-]+/)+[\w-]+\.[A-Za-z0-9]{1,10})"), F.lit(1)))
    rows = texts.select(F.col(id_).alias("episode_id"), F.explode(paths).alias("path"))
    return rows.withColumn("lang", text.language_of_path(F.col("path")))


def file_ranges(texts: DataFrame, id_: str, column: str) -> DataFrame:
    """Rows (episode_id, path, lang, line_from, line_to): the files that a text names, each path once per text.

    Lines may follow the path, as in `src/a.py:12-40` or `src/a.py:12`; of several mentions the first line counts, those without lines last.
    """
    named = F.regexp_extract_all(column, F.lit(r"(?:^|[\s`(\"'])((?:[\w.-]+/)+[\w-]+\.[A-Za-z0-9]{1,10}(?::\d{1,9}(?:[-–]\d{1,9})?)?)"), F.lit(1))
    rows = texts.select(F.col(id_).alias("episode_id"), F.explode(F.array_distinct(named)).alias("m"))
    part = lambda i: F.when(F.col("m").contains(":"), F.nullif(F.regexp_extract("m", r":(\d+)(?:[-–](\d+))?$", i), F.lit("")).cast("long"))
    rows = rows.select("episode_id", F.substring_index("m", ":", 1).alias("path"), part(1).alias("line_from"), F.coalesce(part(2), part(1)).alias("line_to"))
    order = F.struct(F.col("line_from").isNull(), "line_from", "line_to")
    one = rows.groupBy("episode_id", "path").agg(F.min_by(F.struct("line_from", "line_to"), order).alias("l"))
    return one.select("episode_id", "path", text.language_of_path(F.col("path")).alias("lang"), "l.*")


def consolidate(facts: DataFrame, pending_: DataFrame, now_ts: int, most: int = 200, embed=None) -> tuple[DataFrame, DataFrame]:
    """(facts, done): the facts after a pass over the queue, and the ids of the pending episodes (id) that it took, at most `most`, first come first.

    An empty queue changes nothing. Near-duplicate live facts of a scope are merged into the newer one, which takes over
    the hits of those that go; see `vectors.merge_equal_and_near`.
    """
    done = kept(pending_.select("id").orderBy("id").limit(most))
    if done.isEmpty():
        return facts, done
    live = facts.where("invalidated_at IS NULL")
    index = kept(live.select("id", "scope_id", "recorded_at", "hits", (embed or vectors.hashed_embedding)(F.col("statement")).alias("q")))
    merged = kept(vectors.merge_equal_and_near(index, now_ts))
    gained = merged.groupBy(F.col("keep").alias("id")).agg(F.sum("hits").alias("_more"))
    lost = merged.select(F.col("gone").alias("id"), F.col("keep").alias("_by"))
    out = facts.join(gained, "id", "left").join(lost, "id", "left")
    gone = F.col("_by").isNotNull()
    now = F.lit(now_ts).cast("long")
    return out.withColumns({
        "hits": F.col("hits") + F.coalesce("_more", F.lit(0)), "invalidated_at": F.when(gone, now).otherwise(F.col("invalidated_at")),
        "invalidated_by": F.when(gone, F.col("_by")).otherwise(F.col("invalidated_by")), "valid_to": F.when(gone, F.coalesce("valid_to", now)).otherwise(F.col("valid_to")),
    }).drop("_more", "_by"), done
