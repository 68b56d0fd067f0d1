"""The review queue: occurrences the vocabulary doesn't know, grouped into clusters, and the append-only log of what people decided.

Occurrences: uid, raw_string, normalised, level_guess, attribute, material,
part, value, qualifier, measure, element_id, detail_id, drawing, commit_seq,
commit_date, sibling_context.  The log: rid, event_seq, actor, action, target,
cluster_key, uids, detail_ids, synonyms_added, reverts, note.  What stands is
replayed from the log, so nothing is ever rewritten.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import FILLERS
from ..functions import reading as R
from ..functions import text as X
from ..vocabulary import Vocabulary
from . import vocabulary as V
from .history import last_write_wins
from .kernels import per_group
from .tables import small

#: Least likeness to a cluster's first member.
ALIKE = 0.85
LOG = "rid STRING, event_seq LONG, actor STRING, action STRING, target STRING, cluster_key STRING, uids ARRAY<STRING>, detail_ids ARRAY<STRING>, synonyms_added ARRAY<STRING>, reverts STRING, note STRING"
_CLOSING = {"assign": "resolved", "unsure": "resolved", "ignore": "ignored"}


def with_uid(candidates: DataFrame) -> DataFrame:
    """Candidates of a commit (commit_sha) with the uid that the same candidate always gets."""
    said = F.coalesce("normalised", X.folded(F.col("raw_string")))
    return candidates.withColumns({"normalised": said, "uid": X.occurrence_uid(said, F.col("level_guess"), F.col("element_id"), F.col("commit_sha"))})


def insert_new(known: DataFrame, found: DataFrame) -> DataFrame:
    """known with found occurrences whose uid it doesn't hold; what people decided on known ones stays."""
    return known.unionByName(found.dropDuplicates(["uid"]).join(known.select("uid"), "uid", "left_anti"), allowMissingColumns=True)


# --- what is open


def standing(log: DataFrame) -> DataFrame:
    """Entries that count: an entry that an undo reverts doesn't, unless that undo is itself reverted; undos are never standing."""
    undo = log.filter("action = 'undo'").select(F.col("rid").alias("u"), F.col("reverts").alias("of"), "event_seq")
    # an undo counts if no later undo that counts reverts it: along a chain of reverts every second one counts
    edges = undo.select(F.col("of").alias("parent"), F.col("u").alias("child"))
    chains = V.paths(edges).groupBy(F.col("path")[0].alias("rid")).agg((F.max(F.size("path")) - 1).alias("undos"))
    return log.filter("action <> 'undo'").join(chains, "rid", "left").filter("coalesce(undos, 0) % 2 = 0").drop("undos")


def statuses(log: DataFrame) -> DataFrame:
    """(uid, status, rid) that the last standing decision gives an occurrence."""
    closing = standing(log).filter(F.col("action").isin(*_CLOSING)).select(F.explode("uids").alias("uid"), "event_seq", "rid", F.when(F.col("action") == "ignore", "ignored").otherwise("resolved").alias("status"))
    return last_write_wins(closing, ["uid"], "event_seq").select("uid", "status", "rid")


def effective_status(log: DataFrame) -> DataFrame:
    """(uid, status) of the last action of each uid that no undo reverts; rows (rid, event_seq, uid, action, reverts) name one uid each."""
    undone = log.filter("action = 'undo'").select(F.col("reverts").alias("rid"))
    live = log.filter("action <> 'undo'").join(undone, "rid", "left_anti")
    return live.groupBy("uid").agg(F.max_by("action", "event_seq").alias("status"))


def load(occurrences: DataFrame, log: DataFrame | None = None, drawing: str | None = None, latest_only: bool = True, wanted: tuple[str, ...] = ("pending",)) -> DataFrame:
    """Occurrences of the wanted status (pending unless decided on), of each drawing's latest commit that has any."""
    rows = occurrences if drawing is None else occurrences.filter(F.col("drawing") == drawing)
    if latest_only:
        top = rows.groupBy("drawing").agg(F.max("commit_seq").alias("commit_seq"))
        rows = rows.join(top, ["drawing", "commit_seq"], "left_semi")
    decided = rows.select(*rows.columns, F.lit("pending").alias("status")) if log is None else rows.join(statuses(log).select("uid", "status"), "uid", "left").withColumn("status", F.coalesce("status", F.lit("pending")))
    return decided.filter(F.col("status").isin(*wanted))


def still_open(pending: DataFrame, nodes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Pending occurrences that the present vocabulary still doesn't cover; a text without a part only a person clears."""
    parts, materials = pending.filter("part <> ''").select("part"), pending.select("material").filter("material <> ''")
    known = V.resolve_tokens(parts, nodes, "part", aliases).unionByName(V.resolve_tokens(parts, nodes, "value", aliases)).filter("node_id IS NOT NULL").select(F.col("token").alias("part"))
    words = V.component_words(nodes).select(F.col("word").alias("_w"))
    covered = pending.filter("level_guess = 'part' AND part <> ''").withColumn("_w", X.folded(F.col("part")))
    by_part = covered.join(small(known.distinct()), "part", "left_semi").select("uid").unionByName(covered.join(small(words), "_w", "left_semi").select("uid"))
    named = V.resolve_tokens(materials, nodes, "value", aliases).filter("node_id IS NOT NULL").select(F.col("token").alias("material"))
    by_value = pending.filter("level_guess = 'value'").join(small(named), "material", "left_semi").select("uid")
    return pending.join(by_part.unionByName(by_value).distinct(), "uid", "left_anti")


# --- clusters


def _alike(a: str, b: str) -> bool:
    """R.similarity(a, b) >= ALIKE for normalised texts, with cheap bounds first."""
    if a == b:
        return bool(a)
    m = difflib.SequenceMatcher(None, a, b)
    return bool(a and b) and m.real_quick_ratio() >= ALIKE and m.quick_ratio() >= ALIKE and m.ratio() >= ALIKE


def group_texts(texts: list[str], vocabulary_words: frozenset[str]) -> list[int]:
    """For each text (distinct, in order) the place of its group's first one: a text joins the first group whose first text is like it or shares two words in a row.

    Only heads of about the text's length, or with a word pair in common, are compared.
    """
    heads: list[tuple[int, str]] = []
    by_pair: dict[str, int] = {}
    by_length: dict[int, list[int]] = {}
    out = []
    for at, said in enumerate(texts):
        text = R.normalised(said)
        words = [w for w in re.findall("[a-z0-9]+", said) if len(w) >= 3 and w not in FILLERS and w not in vocabulary_words]
        pairs = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}
        n = len(text)
        first = min((by_pair[p] for p in pairs if p in by_pair), default=len(heads))
        # a ratio of ALIKE needs lengths within a factor of ALIKE / (2 - ALIKE)
        near = sorted(i for k in range(int(n * ALIKE / (2 - ALIKE)), int(n * (2 - ALIKE) / ALIKE) + 2) for i in by_length.get(k, ()) if i < first)
        home = next((i for i in near if _alike(text, heads[i][1])), first)
        if home == len(heads):
            heads.append((at, text))
            by_length.setdefault(n, []).append(home)
            for p in pairs:
                by_pair.setdefault(p, home)
        out.append(heads[home][0])
    return out


def cluster(occurrences: DataFrame, vocabulary_words: list[str] = ()) -> DataFrame:
    """(uid, cluster_key): occurrences of one level that say about the same.

    Greedy in the order of occurrences, so it's one task a level; it gets the
    distinct texts only, as rows of one text go the same way.
    """
    words = frozenset(vocabulary_words)
    said = F.coalesce("normalised", X.folded(F.col("raw_string")))
    rows = occurrences.select("uid", said.alias("said"), F.coalesce("level_guess", F.lit("part")).alias("level_guess"), F.struct(*[F.coalesce(c, F.lit("")) for c in ("drawing", "detail_id", "element_id")], "commit_seq", "uid").alias("at"))
    distinct = rows.groupBy("level_guess", "said").agg(F.min("at").alias("at"))
    w = Window.partitionBy("level_guess").orderBy("at")
    distinct = distinct.select("level_guess", "said", F.row_number().over(w).alias("n"))

    def level(found: list[dict]):
        texts = [r["said"] for r in sorted(found, key=lambda r: r["n"])]
        for text, head in zip(texts, group_texts(texts, words), strict=True):
            yield {"level_guess": found[0]["level_guess"], "said": text, "cluster_key": f"{found[0]['level_guess']}|{texts[head]}"}

    homes = per_group(distinct, ["level_guess"], level, "level_guess STRING, said STRING, cluster_key STRING")
    return rows.select("uid", "said", "level_guess").join(homes, ["level_guess", "said"]).select("uid", "cluster_key")


def with_ids(keys: DataFrame) -> DataFrame:
    """(cluster_key, cluster_id) with a number behind ids that several keys share."""
    base = X.short_hash("c_", 3, F.col("cluster_key"))
    w = Window.partitionBy("base").orderBy("cluster_key")
    rows = keys.select("cluster_key").distinct().withColumn("base", base).withColumn("n", F.row_number().over(w))
    return rows.select("cluster_key", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "n")).alias("cluster_id"))


def clusters(pending: DataFrame, nodes: DataFrame, vocabulary: Vocabulary | None = None, details: DataFrame | None = None, dismissed: DataFrame | None = None, actor: str | None = None) -> DataFrame:
    """The review queue, largest clusters first: a row per cluster with its label (the longest text), variants, details, context and suggestions.

    pending: still_open() occurrences; details (detail_id, title); dismissed
    (cluster_key, actor): hidden from that actor.
    """
    words = sorted({w for r in V.names(nodes).select(F.explode(F.regexp_extract_all("folded", F.lit("([a-z0-9]+)"), F.lit(1))).alias("w")).distinct().collect() for w in [r["w"]]})  # the vocabulary's words
    rows = pending.join(cluster(pending, words), "uid")
    if dismissed is not None and actor is not None:
        rows = rows.join(dismissed.filter(F.col("actor") == actor).select("cluster_key"), "cluster_key", "left_anti")
    text = F.when(F.col("raw_string") != "", F.col("raw_string"))
    place = F.struct("drawing", "detail_id")
    by = rows.groupBy("cluster_key").agg(
        F.array_sort(F.collect_set(text)).alias("variants"), F.max_by(text, F.struct(F.length(text), F.lit(0))).alias("any"), F.first("level_guess").alias("level_guess"), F.min("attribute").alias("attribute"),
        F.count(F.lit(1)).alias("occurrence_count"), F.array_sort(F.collect_set(place)).alias("places"), F.array_sort(F.collect_list("uid")).alias("uids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("sibling_context", F.array().cast("array<string>")))))).alias("sibling_context"), F.min("commit_date").alias("oldest"), F.max("commit_date").alias("newest"),
    )
    longest = F.aggregate("variants", F.lit(""), lambda top, x: F.when(F.length(x) > F.length(top), x).otherwise(top))
    label = F.when(longest != "", longest).otherwise(F.substring_index("cluster_key", "|", -1))
    out = by.withColumn("label", label).drop("any").join(with_ids(by.select("cluster_key")), "cluster_key")
    if details is not None:
        named = rows.select("cluster_key", "detail_id").distinct().join(details.select("detail_id", "title"), "detail_id").groupBy("cluster_key").agg(F.array_sort(F.collect_set("title")).alias("titles"))
        out = out.join(named, "cluster_key", "left")
    if vocabulary is not None:
        out = out.withColumn("suggestions", _suggester(vocabulary)("label", "sibling_context"))
    return out.orderBy(F.desc("occurrence_count"), "label")


def _suggester(vocabulary: Vocabulary):
    @F.pandas_udf("array<struct<node: string, score: double>>")
    def suggest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for labels, context in batches:
            yield pd.Series([[{"node": n, "score": s} for n, s in vocabulary.suggest(t, c if c is not None else ())] for t, c in zip(labels, context, strict=True)])

    return suggest


def scoped(open_clusters: DataFrame, occurrences: DataFrame, key: str, only_detail: str | None = None) -> DataFrame:
    """Occurrences of the cluster with that key or id, of one detail if asked for."""
    uids = open_clusters.filter((F.col("cluster_key") == key) | (F.col("cluster_id") == key)).select(F.explode("uids").alias("uid"))
    rows = occurrences.join(uids, "uid", "left_semi")
    return rows if only_detail is None else rows.filter(F.col("detail_id") == only_detail)


def notification(mine: DataFrame, all_open: DataFrame, dimensions: DataFrame | None = None, cap: int = 5, many: int = 50) -> DataFrame:
    """One row for an uploader: the largest clusters of the drawing, how many more there are, and whether the queue is left to itself."""
    top = mine.orderBy(F.desc("occurrence_count"), "label").limit(cap).agg(F.array_sort(F.collect_list(F.struct((-F.col("occurrence_count")).alias("o"), "label", "cluster_id"))).alias("c"))
    counts = mine.agg(F.greatest(F.lit(0), F.count(F.lit(1)) - cap).alias("more"), F.size(F.array_distinct(F.flatten(F.collect_list(F.transform("places", lambda p: p["detail_id"]))))).alias("details_indexed"))
    total = all_open.agg(F.count(F.lit(1)).alias("pending_total"))
    one = F.lit(1).alias("one")
    out = top.select(one, F.transform("c", lambda x: x["cluster_id"]).alias("clusters")).join(counts.select(one, "*"), "one").join(total.select(one, "*"), "one")
    if dimensions is not None:
        out = out.join(dimensions.orderBy("drawing", "detail_id", "element_id").limit(cap).agg(F.collect_list("uid").alias("dimensions")).select(one, "*"), "one")
    return out.withColumn("banner", F.col("pending_total") > many).drop("one")


def digest(open_clusters: DataFrame, since: str, least: int = 10) -> DataFrame:
    """One row: new clusters since a date, all and their occurrences, the oldest date, and those of at least so many occurrences."""
    return open_clusters.agg(
        F.count_if(F.col("newest") >= since).alias("new_clusters"), F.count(F.lit(1)).alias("pending_total"), F.coalesce(F.sum("occurrence_count"), F.lit(0)).alias("pending_occurrences"),
        F.min("oldest").alias("oldest_pending"), F.count_if(F.col("occurrence_count") >= least).alias("high_impact"),
    )


def to_promote(open_clusters: DataFrame, nodes: DataFrame, least: int = 10, sheets: int = 3, enabled: bool = False) -> DataFrame:
    """Clusters that may become values of a free-text attribute by themselves: frequent, on several sheets, and new; none unless enabled."""
    free = nodes.filter("level = 'attribute' AND value_type = 'free_text'").select(F.col("node_id").alias("attribute"))
    drawings = F.size(F.array_distinct(F.transform("places", lambda p: p["drawing"])))
    rows = open_clusters.filter((F.col("level_guess") == "value") & (F.col("occurrence_count") >= least) & (drawings >= sheets) & F.lit(enabled)).join(free, "attribute", "left_semi")
    return rows.withColumn("node_id", F.concat(F.lit("value."), X.slug(F.col("label")))).join(nodes.select("node_id"), "node_id", "left_anti").withColumn("review_needed", F.lit(True))


# --- decisions


def _event(log: DataFrame, actor: str, action: str, **fields) -> DataFrame:
    """One row to append to the log, numbered behind its last."""
    last = log.agg(F.max("event_seq")).first()[0] or 0
    row = {"rid": f"res_{last + 1:05d}", "event_seq": last + 1, "actor": actor, "action": action, **fields}
    schema = T.StructType.fromDDL(LOG)
    return log.sparkSession.createDataFrame([tuple(row.get(f.name) for f in schema)], schema)


def _uids(rows: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """uids, details and texts of one cluster's occurrences: what a log entry names."""
    got = rows.agg(F.array_sort(F.collect_set("uid")), F.array_sort(F.collect_set("detail_id")), F.array_sort(F.collect_set(F.when(F.trim("raw_string") != "", F.trim("raw_string"))))).first()
    return tuple(got)


def assign(log: DataFrame, rows: DataFrame, vocabulary: Vocabulary, key: str, target: str, actor: str = "cli", unsure: bool = False) -> tuple[DataFrame, Vocabulary]:
    """The log with a cluster's occurrences (scoped()) assigned to a node, and the vocabulary with their texts as its synonyms."""
    node = vocabulary.resolve(target)
    uids, details, texts = _uids(rows)
    if node not in vocabulary.nodes or not uids:
        raise ValueError(f"unknown node {target}" if uids else "scope matched no pending occurrences")
    n = vocabulary.nodes[node]
    have = {R.folded(x) for x in vocabulary.names(n)}
    added = [t for t in {R.folded(t): t for t in reversed(texts)}.values() if R.folded(t) not in have]
    entry = _event(log, actor, "unsure" if unsure else "assign", target=node, cluster_key=key, uids=uids, detail_ids=details, synonyms_added=sorted(added))
    return log.unionByName(entry), vocabulary.with_node(n | {"synonyms": sorted([*(n.get("synonyms") or []), *added])})


def ignore(log: DataFrame, rows: DataFrame, vocabulary: Vocabulary, key: str, actor: str = "cli") -> tuple[DataFrame, Vocabulary]:
    """The log with a cluster set aside for good, and the vocabulary that ignores its texts."""
    uids, details, texts = _uids(rows)
    added = sorted({R.folded(t) for t in texts} - {R.folded(e) for e in vocabulary.ignore})
    entry = _event(log, actor, "ignore", cluster_key=key, uids=uids, detail_ids=details, synonyms_added=added)
    return log.unionByName(entry), Vocabulary(vocabulary.nodes.values(), vocabulary.aliases, sorted([*vocabulary.ignore, *added]), vocabulary.ignore_patterns)


def dismiss(dismissed: DataFrame, key: str, actor: str) -> DataFrame:
    """(cluster_key, actor) with a cluster hidden from one actor."""
    return dismissed.unionByName(dismissed.sparkSession.createDataFrame([(key, actor)], "cluster_key string, actor string")).distinct()


def undo(log: DataFrame, rid: str, vocabulary: Vocabulary, actor: str = "cli") -> tuple[DataFrame, Vocabulary]:
    """The log with an entry reverted, and the vocabulary without what it added."""
    row = standing(log).filter(F.col("rid") == rid).first()
    if row is None:
        raise ValueError(f"{rid} is unknown or already undone")
    drop = {R.folded(x) for x in row["synonyms_added"] or []}
    if row["action"] in ("assign", "unsure") and row["target"] in vocabulary.nodes:
        n = vocabulary.nodes[row["target"]]
        vocabulary = vocabulary.with_node(n | {"synonyms": [s for s in n.get("synonyms") or [] if R.folded(s) not in drop]})
    elif row["action"] == "ignore":
        vocabulary = Vocabulary(vocabulary.nodes.values(), vocabulary.aliases, [e for e in vocabulary.ignore if R.folded(e) not in drop], vocabulary.ignore_patterns)
    entry = _event(log, actor, "undo", target=row["target"], cluster_key=row["cluster_key"], uids=row["uids"], reverts=rid, note=f"reverts {rid}")
    return log.unionByName(entry), vocabulary


def proposal_from(open_clusters: DataFrame, nodes: DataFrame, key: str, actor: str = "cli", parents: list[str] | None = None) -> DataFrame:
    """A proposal filled in from a cluster: its longest text as label, the others as synonyms, parents from its attribute or context; its definition is left blank."""
    c = open_clusters.filter((F.col("cluster_key") == key) | (F.col("cluster_id") == key)).first()
    if c is None:
        raise ValueError(f"unknown or already resolved cluster: {key}")
    level = "value" if c["level_guess"] == "value" else "part"
    if parents is None:
        parents = [c["attribute"]] if level == "value" and c["attribute"] else [x for x in c["sibling_context"] if x.startswith(("component.", "part."))]
    if not parents:
        raise ValueError("no parent inferable: pass parents")
    label = max(c["variants"] or [c["label"]], key=lambda t: (len(t), t))
    return V.propose(nodes, level, label.strip(), parents, "", [v for v in c["variants"] if v != label], f"resolution:{actor}")


def recent(log: DataFrame, limit: int = 20) -> DataFrame:
    return log.orderBy(F.desc("event_seq")).limit(limit)


def reclassified(log: DataFrame, occurrences: DataFrame, vocabulary: Vocabulary, components: DataFrame) -> DataFrame:
    """(drawing, detail_id, element_id, path, confidence, chain, exact_value, qualifier, review_needed) that standing assignments give occurrences: what details gain by replay.

    components (detail_id, components): facet components of the latest details;
    without any, components in the occurrence's context.
    """
    done = standing(log).filter(F.col("action").isin("assign", "unsure")).select(F.explode("uids").alias("uid"), "target", "action", "event_seq")
    done = last_write_wins(done, ["uid"], "event_seq")
    rows = occurrences.join(done, "uid").join(components.select("detail_id", "components"), "detail_id", "left")

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                node = vocabulary.nodes[vocabulary.resolve(r["target"])]
                own = list(r["components"]) if r["components"] is not None and len(r["components"]) else [s for s in (r["sibling_context"] if r["sibling_context"] is not None else []) if s.startswith("component.")]
                value = None if pd.isna(r["value"]) else float(r["value"])
                part, material = None, r["material"]
                if node["level"] == "part":
                    part, material = node["id"], material if vocabulary.material(material) else None
                elif node["level"] == "value":
                    part, material = vocabulary.part(r["part"]), node["id"].split(".", 1)[1]
                for p in vocabulary.compose(own, part, material, value, r["measure"]):
                    out.append((r["drawing"], r["detail_id"], r["element_id"], p, "low" if r["action"] == "unsure" else "medium", "resolution", value, r["qualifier"], r["action"] == "unsure"))
            yield pd.DataFrame(out, columns=["drawing", "detail_id", "element_id", "path", "confidence", "chain", "exact_value", "qualifier", "review_needed"])

    schema = "drawing string, detail_id string, element_id string, path array<string>, confidence string, chain string, exact_value double, qualifier string, review_needed boolean"
    return rows.mapInPandas(paths, schema).dropDuplicates(["drawing", "detail_id", "element_id", "path"])


def latest_components(details: DataFrame) -> DataFrame:
    """(detail_id, components): component facets of each detail's latest record; details (detail_id, commit_date, commit_seq, facet_nodes)."""
    w = Window.partitionBy("detail_id").orderBy(F.desc("commit_date"), F.desc("commit_seq"))
    top = details.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return top.select("detail_id", F.filter("facet_nodes", lambda x: x.startswith("component.")).alias("components"))


# --- dimensions for a person to confirm


def dimensions_open(reviews: DataFrame, log: DataFrame | None = None, drawing: str | None = None) -> DataFrame:
    """Dimension reviews that nobody confirmed yet."""
    rows = reviews.filter("status = 'pending'") if drawing is None else reviews.filter((F.col("status") == "pending") & (F.col("drawing") == drawing))
    if log is not None:
        rows = rows.join(standing(log).filter("action = 'confirm-dim'").select(F.explode("uids").alias("uid")), "uid", "left_anti")
    return rows.orderBy("drawing", "detail_id", "element_id") if "detail_id" in rows.columns else rows.orderBy("drawing", "element_id")


def confirm_dimension(log: DataFrame, reviews: DataFrame, uid: str, actor: str = "cli") -> DataFrame:
    """The log with a dimension confirmed; it must name a material."""
    row = reviews.filter(F.col("uid") == uid).first()
    if row is None or not row["material"]:
        raise ValueError(f"unknown dimension review: {uid}" if row is None else f"{uid} names no material")
    return log.unionByName(_event(log, actor, "confirm-dim", target=row["material"], cluster_key=uid, uids=[uid], note=f"{uid} confirmed"))


def confirmed_facts(facts: DataFrame, reviews: DataFrame, log: DataFrame) -> DataFrame:
    """facts in which confirmed dimensions (by element and value to 0.01) bind at medium confidence as vision+human."""
    done = standing(log).filter("action = 'confirm-dim'").select(F.explode("uids").alias("uid"))
    keys = reviews.join(done, "uid", "left_semi").select("drawing", "element_id", F.round("value", 2).alias("_v"), F.lit(True).alias("_ok")).distinct()
    rows = facts.withColumn("_v", F.round("value", 2)).join(keys, ["drawing", "element_id", "_v"], "left")
    low = F.coalesce("_ok", F.lit(False)) & (F.col("chain") == "vision")
    return rows.withColumns({"confidence": F.when(low, "medium").otherwise(F.col("confidence")), "chain": F.when(low, "vision+human").otherwise(F.col("chain"))}).drop("_v", "_ok").select(*facts.columns)


def upsert_reviews(known: DataFrame, found: DataFrame) -> DataFrame:
    """Reviews by uid: a found one replaces what it names and keeps what it leaves null; a confirmed one stays confirmed."""
    cols = [c for c in known.columns if c != "uid"]
    a, b = known.select("uid", *[F.col(c).alias(f"a_{c}") for c in cols]), found.select("uid", *[F.col(c).alias(f"b_{c}") for c in cols])
    both = a.join(b, "uid", "full_outer")
    return both.select("uid", *[(F.when(F.col("a_status") == "confirmed", "confirmed").otherwise(F.coalesce("b_status", "a_status")) if c == "status" else F.coalesce(f"b_{c}", f"a_{c}")).alias(c) for c in cols])


