"""Rows of the engine as Spark DDL strings."""

from __future__ import annotations

from pyspark.sql import types as T

PARSED = "STRUCT<material: STRING, value: DOUBLE, unit: STRING, qualifier: STRING, profile: STRING, dims: ARRAY<DOUBLE>, r_value: DOUBLE, part: STRING, measure: STRING, delegated_to: STRING, bare_to: STRING>"
GEOM = "STRUCT<x: DOUBLE, y: DOUBLE, bbox: ARRAY<DOUBLE>>"
#: An element of a drawing.
ELEMENT = (
    f"dxf_handle STRING, handles ARRAY<STRING>, type STRING, layer STRING, geom {GEOM}, text_raw STRING, parsed {PARSED}, hatch_pattern STRING, hatch_scale DOUBLE, hatch_area DOUBLE, "
    "dim_measurement DOUBLE, dim_override STRING, dim_defpoints ARRAY<ARRAY<DOUBLE>>, dim_style STRING, fingerprint STRING, height DOUBLE, rotation DOUBLE, vertices ARRAY<ARRAY<DOUBLE>>, "
    "length DOUBLE, linetype STRING, closed BOOLEAN, insert_x DOUBLE, insert_y DOUBLE, source STRING, leader_endpoint ARRAY<DOUBLE>, leader_id STRING, "
    "source_lines ARRAY<STRUCT<text: STRING, bbox: ARRAY<DOUBLE>, entity_handle: STRING, insert: ARRAY<DOUBLE>>>, "
    "reassembly STRUCT<signal: STRING, confidence: STRING, leader_id: STRING, alternatives_considered: INT, ai_used: BOOLEAN>"
)
STATE = f"drawing STRING, element_id STRING, {ELEMENT}"
REGION = "drawing STRING, region_id STRING, polygon ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>, bbox ARRAY<DOUBLE>, cx DOUBLE, cy DOUBLE, layer STRING, hatch_pattern STRING, material STRING, thickness DOUBLE, source_element_id STRING"
#: A value bound to a material, before and after rival evidence is reconciled.
FACT = (
    "drawing STRING, element_id STRING, region_id STRING, material STRING, part STRING, value DOUBLE, unit STRING, qualifier STRING, measure STRING, confidence STRING, chain STRING, conflict BOOLEAN, "
    "leader_own_value BOOLEAN, review_needed BOOLEAN, dim_uid STRING, ord INT"
)


#: A dimension for a person to confirm.
REVIEW = (
    "uid STRING, drawing STRING, element_id STRING, value DOUBLE, unit STRING, label STRING, anchor ARRAY<DOUBLE>, status STRING, chain STRING, confidence STRING, material STRING, region_id STRING, "
    "regions ARRAY<STRUCT<region_id: STRING, measured_width: DOUBLE, material: STRING, layer: STRING>>"
)


def as_fields(ddl: str) -> str:
    """Columns as the fields of a STRUCT."""
    out, depth = [""], 0
    for c in ddl:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return ", ".join(": ".join(x.split(None, 1)) for x in out)


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
