"""Snapshot history: states are (drawing, element_id, commit_seq, ...) with every live element of every commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["drawing", "element_id"]


def latest(state: DataFrame) -> DataFrame:
    """(drawing, commit_seq) of each drawing's last commit: small, and joined back by drawing only."""
    return state.groupBy("drawing").agg(F.max("commit_seq").alias("commit_seq"))


def current(state: DataFrame) -> DataFrame:
    return state.join(latest(state), ["drawing", "commit_seq"], "left_semi")


def at(state: DataFrame, commit_seq: int) -> DataFrame:
    return state.filter(F.col("commit_seq") == commit_seq)


def with_status(state: DataFrame, changed=None, status=None) -> DataFrame:
    """Adds status new, unchanged or value_changed, and a deleted row (old values) where an element is missing from the next commit.

    One window over (drawing, element) sees both neighbours; an element that
    comes back after a gap is new.  changed(now, before) says whether values
    differ; or status(now, before) gives the status itself, as
    identity.change_status does for whole elements.
    """
    w = Window.partitionBy(*KEYS).orderBy("commit_seq")
    rest = [c for c in state.columns if c not in (*KEYS, "commit_seq")]
    row = F.struct("commit_seq", *rest)
    s = state.withColumn("before", F.lag(row).over(w)).withColumn("after_seq", F.lead("commit_seq").over(w)).withColumn("last_seq", F.lit(None).cast("int"))
    known = F.coalesce(F.col("before.commit_seq") == F.col("commit_seq") - 1, F.lit(False))
    now = F.struct(*rest)
    differs = status(now, F.col("before")) if status else F.when(changed(now, F.col("before")), "value_changed").otherwise("unchanged")
    live = s.select(*KEYS, "commit_seq", *rest, F.when(~known, "new").otherwise(differs).alias("status"))
    top = state.agg(F.max("commit_seq").alias("top"))  # one row
    gone = s.filter(F.coalesce(F.col("after_seq") != F.col("commit_seq") + 1, F.lit(True))).crossJoin(F.broadcast(top)).filter("commit_seq < top")
    gone = gone.select(*KEYS, (F.col("commit_seq") + 1).alias("commit_seq"), *rest, F.lit("deleted").alias("status"))
    return live.unionByName(gone)


def changed_between(state: DataFrame, first: int, second: int) -> DataFrame:
    """(drawing, element_id, change, before, after) of one value column; equal rows are left out."""
    a = at(state, first).select(*KEYS, F.col("value").alias("before"), F.lit(True).alias("in_a"))
    b = at(state, second).select(*KEYS, F.col("value").alias("after"), F.lit(True).alias("in_b"))
    both = a.join(b, KEYS, "full_outer")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "deleted").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.withColumn("change", change).filter("change IS NOT NULL").select(*KEYS, "change", "before", "after")


def changed_fields(state: DataFrame, first: int, second: int, fields: list[str]) -> DataFrame:
    """(drawing, element_id, change, before, after) with structs of the fields; rows that agree in all of them are left out."""
    a = at(state, first).select(*KEYS, F.struct(*fields).alias("before"))
    b = at(state, second).select(*KEYS, F.struct(*fields).alias("after"))
    both = a.join(b, KEYS, "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.withColumn("change", change).filter("change IS NOT NULL").select(*KEYS, "change", "before", "after").orderBy(*KEYS)


def vanished_drawings(state: DataFrame, commits: DataFrame) -> DataFrame:
    """(drawing, commit_seq) of the first commit that a drawing is missing from after it was there."""
    held = state.select("drawing", "commit_seq").distinct()
    after = held.select("drawing", (F.col("commit_seq") + 1).alias("commit_seq"))
    return after.join(held, ["drawing", "commit_seq"], "left_anti").join(commits.select("commit_seq"), "commit_seq", "left_semi").select("drawing", "commit_seq")


def latest_commits(rows: DataFrame, key: str = "drawing") -> DataFrame:
    """(key, commit_seq, commit_date) of the last commit that has rows for it: facts, details or occurrences as well as states."""
    return rows.groupBy(key).agg(F.max_by(F.struct("commit_seq", "commit_date"), F.struct("commit_date", "commit_seq")).alias("c")).select(key, "c.*")


def element_history(status: DataFrame) -> DataFrame:
    """The first row of each element and all rows that aren't unchanged."""
    w = Window.partitionBy(*KEYS).orderBy("commit_seq")
    return status.withColumn("nth", F.row_number().over(w)).filter("nth = 1 OR status <> 'unchanged'").drop("nth")


def revisions(status: DataFrame) -> DataFrame:
    """(drawing, revision, commit_seq, counts by status, changed)."""
    kinds = ("new", "unchanged", "value_changed", "deleted")
    by = status.groupBy("drawing", "commit_seq").agg(*[F.count_if(F.col("status") == k).alias(f"n_{k}") for k in kinds], F.count_if(F.col("status") != "unchanged").alias("changed"))
    return by.withColumn("revision", F.row_number().over(Window.partitionBy("drawing").orderBy("commit_seq")))


def deleted_latest(status: DataFrame) -> DataFrame:
    """Elements that each drawing's last commit deleted."""
    return status.join(latest(status), ["drawing", "commit_seq"], "left_semi").filter("status = 'deleted'")


def last_write_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the one with the largest order: an upsert's result."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("row")).select(*keys, "row.*")


def insert_if_absent(known: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """known with those found rows whose key it doesn't hold."""
    return known.unionByName(found.dropDuplicates(keys).join(known.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def upsert_coalesce(known: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """known and found by key; where both have a row, a found value replaces the known one unless it's null."""
    cols = [c for c in known.columns if c not in keys]
    a, b = (df.select(*keys, F.struct(*cols).alias(n)) for df, n in ((known, "a"), (found, "b")))
    return a.join(b, keys, "full_outer").select(*keys, *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in cols])


def index_new(indexed: DataFrame, states: DataFrame, commits: DataFrame, status) -> DataFrame:
    """The index (states with status and commit_seq) after commits it doesn't hold yet, without commits that are gone.

    Only new commits and the last indexed snapshot before them are compared;
    status is as in with_status.  states: drawing, element_id, commit_seq, ....
    """
    kept = indexed.join(commits.select("commit_seq"), "commit_seq", "left_semi")
    new = commits.select("commit_seq").join(kept.select("commit_seq").distinct(), "commit_seq", "left_anti")
    wanted = new.select(F.explode(F.array(F.col("commit_seq"), F.col("commit_seq") - 1)).alias("commit_seq")).distinct()
    part = with_status(states.join(F.broadcast(wanted), "commit_seq", "left_semi"), status=status)  # one row a commit
    # a snapshot that was only read for comparison adds nothing, nor does what it seems to delete
    fresh = part.join(F.broadcast(new), "commit_seq", "left_semi")
    return kept.unionByName(fresh.select(kept.columns))


def ingest_summary(status: DataFrame, revisions_before: DataFrame | None = None) -> DataFrame:
    """(drawing, revision, total, counts by status, note) of an upload: rows of one commit's status."""
    kinds = ("new", "unchanged", "moved", "value_changed", "moved+value_changed", "deleted")
    by = status.groupBy("drawing").agg(F.count_if(F.col("status") != "deleted").alias("total"), *[F.count_if(F.col("status") == k).alias(f"n_{k.replace('+', '_')}") for k in kinds])
    before = F.lit(0).cast("long")
    if revisions_before is not None:
        by = by.join(revisions_before.groupBy("drawing").agg(F.max("revision").alias("_r")), "drawing", "left")
        before = F.coalesce("_r", F.lit(0)).cast("long")
    out = by.withColumn("revision", before + 1)
    same = (F.col("total") == F.col("n_unchanged")) & (F.col("n_deleted") == 0)
    return out.withColumn("note", F.when(F.col("revision") == 1, "first revision").when(same, "no change").otherwise("iteration")).drop("_r")


def pending_commits(commits: DataFrame, indexed: DataFrame) -> DataFrame:
    return commits.join(indexed, "commit_sha", "left_anti")


def prune(df: DataFrame, commits: DataFrame) -> DataFrame:
    """Rows of commits that still exist."""
    return df.join(commits, "commit_sha", "left_semi")
