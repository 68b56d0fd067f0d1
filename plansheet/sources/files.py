"""Readers and writers of the engine's own files: element states, identity maps, details, commits, vocabulary and settings."""

from __future__ import annotations

import json
import os
import subprocess
from dataclasses import fields, replace
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schemas
from ..config import ShapeRules, TextRules, Words
from ..vocabulary import Vocabulary, VocabularyError

_FILE_PARSED = schemas.PARSED.replace("delegated_to: STRING, bare_to: STRING", "spec_delegated: STRUCT<`to`: STRING>, `to`: STRING")
#: One element record a line, as files hold it.
_LINE = f"element_id STRING, {schemas.ELEMENT}".replace(schemas.PARSED, _FILE_PARSED)
COMMITS = "commit_seq INT, commit_sha STRING, commit_date STRING, author STRING, commit_message STRING"


def with_project(df: DataFrame) -> DataFrame:
    """df with the project: the drawing's first folder, '' if it lies in none."""
    return df.withColumn("project", F.when(F.contains("drawing", F.lit("/")), F.split_part("drawing", F.lit("/"), F.lit(1))).otherwise(""))


def _below(path: str, ending: str):
    """A file's path below `path`, without its ending."""
    last = path.rstrip("/").rpartition("/")[2].replace(".", r"\.")
    return F.regexp_extract(F.col("_metadata.file_path"), rf"^.*?{last}/(.*)\.{ending}$", 1)


def _from_file(rows: DataFrame) -> DataFrame:
    said = F.col("parsed")
    kept = [f.name for f in schemas.struct(f"p {schemas.PARSED}")["p"].dataType if f.name not in ("delegated_to", "bare_to")]
    parsed = F.struct(*[said[n].alias(n) for n in kept], said["spec_delegated"]["to"].alias("delegated_to"), said["to"].alias("bare_to"))
    return rows.withColumn("parsed", F.when(said.isNotNull(), parsed))


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """States (project, schemas.STATE) of all *.jsonl under path; the drawing is the path below it.  Malformed lines are skipped."""
    rows = spark.read.schema(_LINE).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(path)
    return with_project(_from_file(rows.withColumn("drawing", _below(path, "jsonl"))))


def read_state_history(spark: SparkSession, path: str, commits: DataFrame) -> DataFrame:
    """States of all commits, from folders path/<commit_sha>/.../<drawing>.jsonl, with commit_seq and commit_date; folders of unknown commits are left out."""
    rows = read_states(spark, path).withColumn("commit_sha", F.split_part("drawing", F.lit("/"), F.lit(1))).withColumn("drawing", F.regexp_replace("drawing", "^[^/]*/", ""))
    return with_project(rows).join(F.broadcast(commits.select("commit_sha", "commit_seq", "commit_date")), "commit_sha")  # one row a commit


def state_files(states: DataFrame) -> DataFrame:
    """(commit_sha, drawing) that states hold."""
    return states.select("commit_sha", "drawing").distinct()


def read_identity_maps(spark: SparkSession, path: str) -> DataFrame:
    """(drawing, element_id, deleted, place and texts) of *.idmap.json files: every id that ever was."""
    of = f"STRUCT<dxf_handle: STRING, fingerprint: STRING, type: STRING, layer: STRING, x: DOUBLE, y: DOUBLE, bbox: ARRAY<DOUBLE>, text_raw: STRING, parsed: {_FILE_PARSED}, hatch_pattern: STRING, dim_measurement: DOUBLE, dim_override: STRING, deleted: BOOLEAN>"
    maps = spark.read.schema(f"drawing STRING, elements MAP<STRING, {of}>").option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.idmap.json").json(path)
    rows = maps.select("drawing", F.explode("elements").alias("element_id", "e")).select("drawing", "element_id", "e.*")
    geom = F.struct("x", "y", "bbox").alias("geom")
    known = _from_file(rows).select("drawing", "element_id", F.coalesce("deleted", F.lit(False)).alias("deleted"), "dxf_handle", F.filter(F.split("dxf_handle", r"\|"), lambda h: h != "").alias("handles"), "type", "layer", geom, "text_raw", "parsed", "hatch_pattern", "dim_measurement", "dim_override", "fingerprint")
    return known


def read_details(spark: SparkSession, path: str) -> DataFrame:
    """A row per detail of details files (drawing, details[...]); rows without a detail id are left out."""
    rows = spark.read.option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path).select("drawing", F.explode("details").alias("d"))
    return rows.select("drawing", "d.*").filter("detail_id IS NOT NULL")


# --- writers


def _drop_null(v):
    return {k: _drop_null(x) for k, x in v.items() if x is not None} if isinstance(v, dict) else v


def state_line(r: dict) -> str:
    """One element as its line: keys sorted, what was only found while matching left out."""
    out = {k: v for k, v in r.items() if k not in ("status", "match_tier", "match_confidence", "previous_text", "drawing", "project", "ord")}
    if out.get("parsed"):
        said = {k: (int(v) if isinstance(v, float) and v.is_integer() else v) for k, v in _drop_null(out["parsed"]).items()}
        to, bare = said.pop("delegated_to", None), said.pop("bare_to", None)
        out["parsed"] = said | ({"spec_delegated": {"to": to}} if to else {}) | ({"to": bare} if bare else {})
    return json.dumps(out, sort_keys=True, ensure_ascii=False)


def state_lines(state: DataFrame) -> DataFrame:
    """(drawing, line_no, line): states as the bytes of their files, in state order, for drawings as they are."""
    from ..operators.kernels import per_group

    def lines(rows: list[dict]):
        ordered = sorted(rows, key=lambda r: (r["layer"] or "", r["type"] or "", r["geom"]["x"], r["geom"]["y"], r["text_raw"] or "", r.get("element_id") or ""))
        return [{"drawing": r["drawing"], "line_no": i, "line": state_line(r)} for i, r in enumerate(ordered)]

    return per_group(state, ["drawing"], lines, "drawing STRING, line_no INT, line STRING")


def write_states(state: DataFrame, path: str) -> None:
    """A folder drawing=... of one text file each; the same states give the same lines."""
    state_lines(state).repartition("drawing").sortWithinPartitions("drawing", "line_no").select("drawing", "line").write.mode("overwrite").partitionBy("drawing").text(path)


def in_sync(recomputed: DataFrame, committed: DataFrame, volatile: tuple[str, ...] = ("thumbnail", "phash", "near_duplicates")) -> bool:
    """Do two states (or details) hold the same rows, volatile columns aside?"""
    cols = [c for c in recomputed.columns if c not in volatile and c in committed.columns]
    a, b = (df.select(F.to_json(F.struct(*sorted(cols))).alias("r")) for df in (recomputed, committed))
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def details_json(drawing: str, rows: list[dict], **more) -> str:
    """The stable form of one sheet's details."""
    return json.dumps({"drawing": drawing, "details": rows, **more}, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def write_details(sheets: DataFrame, path: str) -> None:
    """(drawing, details, candidates) rows as a folder drawing=... of one JSON document each."""
    def text(batches):
        import pandas as pd

        for b in batches:
            docs = [details_json(d, json.loads(x), quarantine_candidates=json.loads(c)) for d, x, c in zip(b["drawing"], b["x"], b["c"], strict=True)]
            yield pd.DataFrame({"drawing": b["drawing"], "value": docs})

    rows = sheets.select("drawing", F.to_json("details").alias("x"), F.to_json(F.coalesce("candidates", F.array())).alias("c"))
    rows.mapInPandas(text, "drawing string, value string").write.mode("overwrite").option("lineSep", "").partitionBy("drawing").text(path)


# --- commits


class _Git(DataSourceReader):
    def __init__(self, schema, options) -> None:
        self.repo = options["path"]

    def partitions(self):
        return [InputPartition(0)]  # one log

    def read(self, partition):
        mark = "\x01"
        run = subprocess.run(["git", "-C", self.repo, "log", "--reverse", "--date-order", f"--format=%H{mark}%aI{mark}%an{mark}%s"], capture_output=True, check=False)
        lines = run.stdout.decode("utf-8", "replace").splitlines() if run.returncode == 0 else []
        for n, line in enumerate(lines):
            sha, date, author, message = line.split(mark, 3)
            yield n, sha, date, author, message


class GitLog(DataSource):
    """Commits of a repository, oldest first; a folder that is none has no rows."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return COMMITS

    def reader(self, schema) -> DataSourceReader:
        return _Git(schema, self.options)


def read_commits(spark: SparkSession, repo: str) -> DataFrame:
    spark.dataSource.register(GitLog)
    return spark.read.format("gitlog").load(repo)


class _Blobs(DataSourceReader):
    def __init__(self, schema, options) -> None:
        self.repo, self.names = options["path"], options["files"].split("\n")

    def partitions(self):
        return [InputPartition(k) for k in range(0, len(self.names), 100)]

    def read(self, partition):
        for line in self.names[partition.value : partition.value + 100]:
            sha, _, name = line.partition(" ")
            run = subprocess.run(["git", "-C", self.repo, "show", f"{sha}:{name}"], capture_output=True, check=False)
            if run.returncode == 0:
                yield sha, name, run.stdout


class GitBlobs(DataSource):
    """Contents of files at commits; those that don't exist are left out."""

    @classmethod
    def name(cls) -> str:
        return "gitblobs"

    def schema(self) -> str:
        return "commit_sha STRING, file STRING, content BINARY"

    def reader(self, schema) -> DataSourceReader:
        return _Blobs(schema, self.options)


def read_blobs(spark: SparkSession, repo: str, files: list[tuple[str, str]]) -> DataFrame:
    """(commit_sha, file, content) of (sha, file) pairs."""
    spark.dataSource.register(GitBlobs)
    return spark.read.format("gitblobs").option("files", "\n".join(f"{s} {f}" for s, f in files)).load(repo)


def first_blob(blobs: DataFrame, candidates: list[str]) -> DataFrame:
    """(commit_sha, content) of the first candidate file that a commit has."""
    rank = F.coalesce(*[F.when(F.col("file") == f, i) for i, f in enumerate(candidates)], F.lit(None))
    return blobs.withColumn("rank", rank).filter("rank IS NOT NULL").groupBy("commit_sha").agg(F.min_by("content", "rank").alias("content"))


def existing(rows: DataFrame, files: DataFrame, column: str = "file") -> DataFrame:
    """Rows whose file is listed."""
    return rows.join(files.select(F.col("file").alias(column)).distinct(), column, "left_semi")


def list_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(file, stem, modified, size) of files below path, contents unread."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select(F.col("path").alias("file"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def unindexed(files: DataFrame, drawings: DataFrame) -> DataFrame:
    """Files that belong to no known drawing (by their name without ending)."""
    known = drawings.select(F.lower(F.element_at(F.split("drawing", "/"), -1)).alias("_s")).distinct()
    return files.withColumn("_s", F.lower("stem")).join(known, "_s", "left_anti").drop("_s")


def ingest_kind(files: DataFrame) -> DataFrame:
    """files with kind: dxf, dwg (to be converted), pdf, image or other; a PDF beside a drawing of its name is its twin and not read."""
    ending = F.lower(F.regexp_extract("file", r"\.([^./]*)$", 1))
    kind = F.when(ending.isin("dxf", "dwg", "pdf"), ending).when(ending.isin("png", "jpg", "jpeg", "gif", "webp"), "image").otherwise("other")
    rows = files.withColumn("kind", kind)
    drawn = rows.filter("kind IN ('dxf', 'dwg')").select("stem").distinct().withColumn("_d", F.lit(True))
    return rows.join(drawn, "stem", "left").withColumn("kind", F.when((F.col("kind") == "pdf") & F.col("_d"), "pdf-twin").otherwise(F.col("kind"))).drop("_d")


# --- vocabulary and settings


def _yaml(path: str):
    import yaml

    try:
        with open(path, encoding="utf-8-sig") as f:
            return yaml.safe_load(f) or {}
    except OSError:
        return {}


def load_vocabulary(folder: str) -> Vocabulary:
    """A folder of YAML files: nodes (a list, or under 'nodes'), aliases.yaml, ignore.yaml; it must be sound."""
    nodes, other = [], {"aliases.yaml", "ignore.yaml", "settings.yaml"}
    for name in sorted(os.listdir(folder)):
        if name.endswith((".yaml", ".yml")) and name not in other:
            data = _yaml(os.path.join(folder, name))
            nodes += data if isinstance(data, list) else data.get("nodes", [])
    aliases, ignore = _yaml(os.path.join(folder, "aliases.yaml")), _yaml(os.path.join(folder, "ignore.yaml"))
    found = Vocabulary(nodes, aliases.get("aliases", aliases), ignore.get("ignored", []), ignore.get("patterns", []))
    if problems := found.problems():
        raise VocabularyError("; ".join(problems))
    return found


@lru_cache(maxsize=8)
def _cached(folder: str, newest: float) -> Vocabulary:
    return load_vocabulary(folder)


def cached_vocabulary(folder: str) -> Vocabulary:
    """load_vocabulary(), read again when a file changed."""
    return _cached(folder, max((os.path.getmtime(os.path.join(folder, n)) for n in os.listdir(folder)), default=0.0))


def write_vocabulary(vocabulary: Vocabulary, folder: str) -> None:
    """The nodes sorted by id, a file a level, and aliases and ignored texts."""
    import yaml

    os.makedirs(folder, exist_ok=True)

    def put(name: str, data) -> None:
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            yaml.safe_dump(data, f, sort_keys=False, allow_unicode=True)

    for level in sorted({n["level"] for n in vocabulary.nodes.values()}):
        put(f"{level}s.yaml", {"nodes": sorted((n for n in vocabulary.nodes.values() if n["level"] == level), key=lambda n: n["id"])})
    put("aliases.yaml", {"aliases": dict(sorted(vocabulary.aliases.items()))})
    put("ignore.yaml", {"ignored": sorted(vocabulary.ignore), "patterns": vocabulary.ignore_patterns})


def vocabulary_nodes(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """The vocabulary's nodes as a table in the order of its files (ord)."""
    text, many = ("level", "label", "definition", "deprecated_by", "value_type", "slug"), ("synonyms", "parents", "enum_members")
    rows = [(n["id"], i, *[n.get(k) for k in text], *[list(n.get(k) or []) for k in many]) for i, n in enumerate(vocabulary.nodes.values())]
    return spark.createDataFrame(rows, "node_id string, ord int, " + ", ".join([*(f"{k} string" for k in text), *(f"{k} array<string>" for k in many)]))


def vocabulary_aliases(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """(alias, target) of aliases and deprecations."""
    gone = {i: n["deprecated_by"] for i, n in vocabulary.nodes.items() if n.get("deprecated_by")}
    return spark.createDataFrame(sorted((gone | vocabulary.aliases).items()), "alias string, target string")


def load_words(path: str) -> Words:
    """A materials file as words to read by; what it leaves out keeps its default."""
    data, base = _yaml(path), Words()
    mats = data.get("materials") or {}
    got = {"materials": {m: [str(k).lower() for k in (s or {}).get("keywords") or []] for m, s in mats.items()} or base.materials, "profiles": [p for s in mats.values() for p in (s or {}).get("profiles") or []] or base.profiles}
    qualifiers = [str(q) for q in data.get("qualifiers") or []]
    qualifiers += [q for s in mats.values() for q in map(str, (s or {}).get("qualifiers") or []) if q not in qualifiers]
    return replace(base, **got, hatches=data.get("hatch_map") or base.hatches, parts=[str(p) for p in data.get("parts") or base.parts], qualifiers=list(dict.fromkeys(qualifiers)) or base.qualifiers)


def load_rules(path: str, rules: TextRules | ShapeRules):
    """A settings file over the given rules, by field name."""
    data = _yaml(path)
    return replace(rules, **{f.name: tuple(data[f.name]) if isinstance(data[f.name], list) else data[f.name] for f in fields(rules) if data.get(f.name) is not None})
