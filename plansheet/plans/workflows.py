"""Whole jobs put together from the operators: ingest of drawings, the index over commits, and the questions people ask of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ShapeRules, SheetRules, TextRules, Words
from ..operators import attribution, history, identity, reassembly, report, review, search, segmentation, tree
from ..operators.tables import cut
from ..operators.vocabulary import edges_of, query_node
from ..sources import drawings, files
from ..vocabulary import Vocabulary

#: Rows and deletions that a page shows at most.
PAGE_ROWS, PAGE_DELETIONS = 2000, 500
FIELDS = ["text_raw", "geom", "parsed", "hatch_pattern", "dim_measurement", "dim_override"]


@dataclass
class Ingested:
    """What an upload gives: states with ids and status, the map of all ids, facts, details, open candidates, dimensions to confirm, and a summary."""

    state: DataFrame
    identity_map: DataFrame
    deleted: DataFrame
    facts: DataFrame
    details: DataFrame
    candidates: DataFrame
    reviews: DataFrame
    summary: DataFrame


def ingest_elements(elements: DataFrame, before: DataFrame, vocabulary: Vocabulary, known: DataFrame | None = None, text: TextRules | None = None, shapes: ShapeRules | None = None, sheets: SheetRules | None = None, words: Words | None = None, choose=None) -> Ingested:
    """Element rows as scanned (drawing, schemas.ELEMENT), matched with the states before (and the map of known ids)."""
    notes = reassembly.reassemble(elements, text, words)
    state = cut(identity.resolve(notes, before, None if known is None else identity.tombstones(known)))
    analysed = cut(attribution.analyse(state, shapes, words, choose))
    facts = attribution.facts(analysed)
    made = cut(segmentation.details(state, facts, analysed, vocabulary, sheets, words))
    here = state.select("drawing").distinct()
    deleted = before.join(here, "drawing", "left_semi").join(state.select("drawing", "element_id"), ["drawing", "element_id"], "left_anti")
    status = state.select("drawing", "status").unionByName(deleted.select("drawing", F.lit("deleted").alias("status")))
    reviews = analysed.select(F.explode("dim_review").alias("r")).select("r.*")
    details = segmentation.flatten(made)
    placed = reviews.join(details.select("drawing", "detail_id", F.explode("element_ids").alias("element_id")), ["drawing", "element_id"], "left")
    return Ingested(state, identity.identity_map(state, before, known), deleted, facts, details, segmentation.flatten(made, "candidates"), placed, history.ingest_summary(status))


def ingest_drawings(spark: SparkSession, path: str, before: DataFrame, vocabulary: Vocabulary, **options) -> Ingested:
    """All ASCII drawings below path."""
    return ingest_elements(drawings.read_drawings(spark, path, options.get("words")).drop("path", "version", "supported"), before, vocabulary, **options)


def ingest_pages(spans: DataFrame, paths: DataFrame | None, before: DataFrame, vocabulary: Vocabulary, **options) -> Ingested:
    """Pages given as spans of text and stroked paths; pages without text give nothing."""
    from ..operators.reassembly import page_elements, lines_of_pages

    elements = page_elements(lines_of_pages(spans), paths)
    return ingest_elements(elements.join(spans.select("drawing").distinct(), "drawing", "left_semi"), before, vocabulary, **options)


def index_states(states: DataFrame) -> DataFrame:
    """States of all commits (commit_seq) with status, rows of what each commit deleted, and what their texts say as columns."""
    said = {c: F.col(f"parsed.{c}") for c in ("material", "part", "value", "unit", "qualifier") if c not in states.columns}
    return history.with_status(states.withColumns(said), status=identity.change_status)


def index_occurrences(known: DataFrame, candidates: DataFrame) -> DataFrame:
    """The occurrences after those of new commits (candidates with commit_sha, commit_seq, commit_date) were added; decided ones stay."""
    return review.insert_new(known, review.with_uid(candidates))


def check(recomputed: Ingested, committed: DataFrame, committed_details: DataFrame) -> bool:
    """Do committed states and details say what a new run finds?"""
    cols = ["drawing", "element_id", "dxf_handle", "type", "layer", "text_raw", "fingerprint"]
    same = files.in_sync(recomputed.state.select(cols), committed.select(cols))
    return same and files.in_sync(recomputed.details, committed_details)


# --- questions


def find(status: DataFrame, facts: DataFrame, ever: bool = False, text: str | None = None, drawing: str | None = None, project: str | None = None, **conditions) -> DataFrame:
    """Elements (newest first within a drawing) with one fact that meets all conditions of search.fact_condition, now or ever."""
    rows = status if ever else history.current(status).filter("status <> 'deleted'")
    for kind, value in (("text", text), ("drawing", drawing), ("project", project)):
        if value is not None:
            rows = rows.filter(search.row_chip(kind, value))
    if any(v is not None for v in conditions.values()):
        rows = search.find(rows, facts, ["drawing", "element_id", "commit_seq"], **conditions)
    return rows.orderBy("drawing", F.desc("commit_seq"), "element_id")


def element(status: DataFrame, element_id: str) -> DataFrame:
    """An element's changes, oldest first."""
    return history.element_history(status.filter(F.col("element_id") == element_id)).orderBy("commit_seq")


def snapshot(status: DataFrame, commits: DataFrame, prefix: str, drawing: str | None = None) -> DataFrame:
    """What a commit, named by the beginning of its sha, held."""
    at = search.commit_of(commits, prefix).select("commit_seq")
    rows = status.join(F.broadcast(at), "commit_seq", "left_semi").filter("status <> 'deleted'")  # one row
    return rows if drawing is None else rows.filter(F.col("drawing") == drawing)


def changed(status: DataFrame, commits: DataFrame, first: str, second: str) -> DataFrame:
    """Field by field what differs between two commits."""
    a, b = (search.commit_of(commits, p).first()["commit_seq"] for p in (first, second))
    held = [c for c in FIELDS if c in status.columns]
    return history.changed_fields(status.filter("status <> 'deleted'"), a, b, held)


def tree_search(details: DataFrame, nodes: DataFrame, query: str, occurrences: DataFrame | None = None) -> dict[str, DataFrame]:
    """The node a query means, details that match, their pruned trees, facets, and open occurrences that hold the query."""
    hit = query_node(nodes, query).first()
    current, edges = tree.current_details(details), edges_of(nodes)
    out = {} if occurrences is None else {"unclassified": tree.unclassified(occurrences, query)}
    if hit is None:
        return out | {"results": current.limit(0)}
    from ..operators.vocabulary import descendants

    found = tree.search(current, edges, hit["node_id"])
    rows = current.join(found.select("detail_id"), "detail_id", "left_semi").select("detail_id", F.explode("classifications").alias("c")).select("detail_id", "c.path")
    below = descendants(edges, details.sparkSession.createDataFrame([(hit["node_id"],)], "seed string")).select("node")
    return out | {"results": found, "pruned": tree.pruned_forests(rows, below), "facets": tree.facets(found, current, edges)}


def queue(occurrences: DataFrame, log: DataFrame, nodes: DataFrame, vocabulary: Vocabulary, details: DataFrame | None = None, dismissed: DataFrame | None = None, actor: str | None = None, drawing: str | None = None) -> DataFrame:
    """The review queue as it stands."""
    pending = cut(review.still_open(review.load(occurrences, log, drawing), nodes, files.vocabulary_aliases(occurrences.sparkSession, vocabulary)))
    return review.clusters(pending, nodes, vocabulary, details, dismissed, actor)


def page(status: DataFrame, facts: DataFrame, chips: list[str], ever: bool = False, **options) -> dict[str, DataFrame]:
    """A stacked search as a page shows it: chips as text, rows and deletions capped."""
    shown, rows, deleted = search.search_stacked(status, facts, [search.parse_chip(c) for c in chips], ever, **options)
    return {"drawings": shown, "rows": rows.limit(PAGE_ROWS), "deleted": deleted.limit(PAGE_DELETIONS)}


def full_report(status: DataFrame, facts: DataFrame, columns: list[str]) -> tuple[str, DataFrame]:
    """The current elements as Markdown, and the newest rows with their facts for a page."""
    rows = report.report_rows(status, facts)
    return report.markdown(rows, columns), report.report_payload(rows)
