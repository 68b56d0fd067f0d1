"""Report rows: the change history with currency flags and each row's bound facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .history import KEYS, latest


def report_rows(status: DataFrame, facts: DataFrame) -> DataFrame:
    """status (drawing, element_id, commit_seq, status, ...) with is_current, is_deleted_latest and facts.

    A row is current if its drawing's last commit has it and it wasn't deleted
    there.  facts is an array of the element's facts (all columns but the
    keys), sorted, and empty for elements without any.
    """
    last = latest(status).withColumnRenamed("commit_seq", "last_seq")  # one row per drawing
    rest = [c for c in facts.columns if c not in KEYS]
    bound = facts.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("facts"))
    rows = status.join(last, "drawing").withColumn("at_last", F.col("commit_seq") == F.col("last_seq"))
    gone = F.col("status") == "deleted"
    rows = rows.withColumn("is_current", F.col("at_last") & ~gone).withColumn("is_deleted_latest", F.col("at_last") & gone)
    none = F.array().cast(bound.schema["facts"].dataType)
    return rows.drop("last_seq", "at_last").join(bound, KEYS, "left").withColumn("facts", F.coalesce("facts", none))


def report_payload(rows: DataFrame, limit: int = 20_000) -> DataFrame:
    """The newest rows of a report, for a page."""
    return rows.orderBy(F.desc("commit_seq"), "drawing", "element_id").limit(limit)


def markdown(rows: DataFrame, columns: list[str], title: str = "Current elements") -> str:
    """Current rows as a Markdown table, by drawing and element; a report is read by people, so it's made on the driver."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    shown = rows.filter("is_current").orderBy("drawing", "element_id").select(*columns)
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in shown.toLocalIterator()]) + "\n"


def console_table(df: DataFrame, limit: int = 50, width: int = 40) -> str:
    """The first rows as text, long values shortened."""
    rows = [[("" if v is None else str(v)) for v in r] for r in df.limit(limit).collect()]
    short = lambda v: v if len(v) <= width else v[: width - 1] + "…"
    cells = [df.columns, *[[short(v) for v in r] for r in rows]]
    wide = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, wide, strict=True)).rstrip() for r in cells)


def near_hashes(hashes: DataFrame, limit: int = 32) -> DataFrame:
    """(drawing, a, z, distance) of pairs of one drawing whose hashes (arrays of longs) differ in at most `limit` bits, a < z.

    The bits are cut into limit + 1 bands: hashes that near agree in one band
    at least, so pairs meet in an equi-join on (drawing, band, its bits).
    """
    from ..functions import geometry as G

    words = F.transform("hash", lambda w: F.lpad(F.conv(F.hex(w), 16, 2), 64, "0"))
    rows = hashes.withColumn("bits", F.array_join(words, ""))
    n = limit + 1
    size = F.length("bits")
    cuts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("band"), F.col("bits").substr(F.floor(i * size / n).cast("int") + 1, F.floor((i + 1) * size / n).cast("int") - F.floor(i * size / n).cast("int")).alias("part")))
    spread = rows.select("drawing", "id", "hash", F.explode(cuts).alias("c")).select("drawing", "id", "hash", "c.band", "c.part")
    other = spread.select("drawing", "band", "part", F.col("id").alias("z"), F.col("hash").alias("of_z"))
    met = spread.join(other, ["drawing", "band", "part"]).filter(F.col("id") < F.col("z"))
    far = met.select("drawing", F.col("id").alias("a"), "z", G.hash_distance(F.col("hash"), F.col("of_z")).alias("distance"))
    return far.filter(F.col("distance") <= limit).distinct()
