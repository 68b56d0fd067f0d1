"""Default tables and tolerances of the engine; callers pass their own in place of any of them."""

from __future__ import annotations

from dataclasses import dataclass, field

# Keywords, patterns and tolerances that readings must agree on.
MATERIALS: dict[str, list[str]] = {
    "glass": ["glass", "glazing", "laminated", "toughened"],
    "plywood": ["plywood", "ply"],
    "steel": ["steel", "shs", "rhs", "ub", "uc", "pfc"],
    "insulation": ["insul", "insulation", "batt", "batts", "earthwool", "bradford", "pink"],
    "concrete": ["concrete", "conc"],
    "timber": ["timber", "hardwood", "softwood", "pine", "stud", "joist"],
    "plasterboard": ["plasterboard", "plaster", "gwb", "gyprock"],
    "aluminium": ["aluminium", "aluminum", "alum", "alu"],
    "tile": ["tile", "tiles"],
    "quirk": ["quirk"],
}
PROFILES = ["SHS", "RHS", "UB", "UC", "PFC", "EA", "UA"]
HATCHES = {"ANSI31": "steel", "ANSI32": "steel", "ANSI33": "steel", "ANSI37": "steel", "AR-CONC": "concrete", "AR-SAND": "concrete", "AR-HBONE": "concrete", "EARTH": "earth", "GRASS": "earth", "SOLID": "solid"}
PARTS = (
    "architrave skirting threshold lining decking cladding jamb reveal membrane flashing gutter grate insulation plasterboard "
    "door entry window wall floor slab tile board mat outlet drain"
).split()
QUALIFIERS = "toughened laminated clear low-e lowe obscure tinted fire-rated acoustic nominal tbc varies min max typical indeterminate".split()
DOTTED = {"nom": "nominal", "tbc": "tbc", "typ": "typical", "min": "min", "max": "max", "var": "varies"}
FREE_QUALIFIERS = ["varies", "tbc", "nominal", "typical"]
MEASURES = {
    **dict.fromkeys(["setdowns", "setdown"], "setdown"),
    **dict.fromkeys(["falls", "fall"], "fall"),
    **dict.fromkeys(["setbacks", "setback"], "setback"),
    **dict.fromkeys(["clearances", "clearance", "overlaps", "overlap", "upstands", "upstand", "returns", "return", "gaps", "gap"], "dimension"),
    **dict.fromkeys(["thickness", "thick", "thk"], "thickness"),
}
TRADES = {r"\bENG(?:INEER(?:ING)?)?\b": "engineering", r"\bSTRUCT(?:URAL)?\b": "structural", r"\bHYDRAULIC\b": "hydraulic", r"\bELECTRICAL\b": "electrical"}
CONTINUATION = ["FOR", "TO", "ON", "WITH", "AT", "AND", "OF", "REFER", "DWGS"]
SHEET_WORDS = (
    "DETAIL DETAILS DRAWING SHEET PLAN SECTION ELEVATION NOTES NOTE GENERAL TYPICAL NOMINAL VERIFY VERIFIED SITE DIMENSIONS DIMENSION "
    "UNLESS NOTED OTHERWISE SUPPLY INSTALL EXISTING PROPOSED REFER SCALE NORTH FINISH FINISHES PAINT"
).split()
FILLERS = "the and for with from fixed through into onto per via all any are was notes note typical nom tbc min max typ ref refer detail details dwg".split()
UNIT_WORDS = ["MM", "THK", "NOM", "TYP", "MIN", "MAX"]
JUNCTIONS = {
    "door_jamb": ["door", "jamb"], "window_head": ["window", "head"], "window_sill": ["window", "sill"], "architrave": ["architrave"], "threshold": ["threshold"],
    "movement": ["movement", "expansion", "control joint"], "sill": ["sill", "cill"], "head": ["head"], "jamb": ["jamb"], "capping": ["capping", "coping", "parapet cap"],
    "parapet": ["parapet"], "skirting": ["skirting"], "eave": ["eave"], "corner": ["corner"],
}
ASSEMBLIES = {
    "internal_partition": ["partition", "stud wall"], "external_wall": ["external wall", "cavity wall", "brick veneer", "facade"], "curtain_wall": ["curtain wall"],
    "window": ["window"], "door": ["door"], "roof": ["roof"], "floor": ["floor"], "ceiling": ["ceiling"], "stair": ["stair"], "balustrade": ["balustrade"],
    "threshold": ["threshold"], "parapet": ["parapet"],
}
CONTEXTS = {"exterior": ["external", "exterior", "facade", "outside", "outdoor"], "interior": ["internal", "interior", "inside", "wet area", "bathroom", "kitchen", "ensuite", "laundry"]}
PROJECTIONS = {"plan": ["plan"], "section": ["section", "detail"], "elevation": ["elevation"], "axonometric": ["axonometric", "iso"]}
CONTEXT_NAMES, PROJECTION_NAMES = ("interior", "exterior", "both"), ("plan", "section", "elevation", "axonometric")
JUNCTION_NODES = {
    "door_jamb": "part.jamb", "window_head": "part.head", "window_sill": "part.sill", "architrave": "part.architrave", "threshold": "part.threshold",
    "movement": "part.movement_joint", "sill": "part.sill", "head": "part.head", "jamb": "part.jamb", "capping": "part.capping", "parapet": "part.capping",
    "skirting": "part.skirting", "eave": "part.eave",
}
ASSEMBLY_NODES = {
    "internal_partition": "component.internal_wall", "external_wall": "component.external_wall", "curtain_wall": "component.curtain_wall", "window": "component.window",
    "door": "component.door", "roof": "component.roof", "floor": "component.floor", "ceiling": "component.ceiling", "stair": "component.stair", "balustrade": "component.balustrade",
}
MEASURE_NODES = {m: f"attr.{m}" for m in ("thickness", "setdown", "fall", "setback", "dimension")}
CHAIN_RANKS = {"leader+dimension+geometry": 0, "leader+geometry": 1, "leader": 2, "dimension": 3, "extension_trace": 4, "geometry": 5, "vision": 6}
CONFIDENCES = ("high", "medium", "low")


@dataclass(frozen=True)
class Words:
    """What annotations are read by."""

    materials: dict[str, list[str]] = field(default_factory=lambda: MATERIALS)
    profiles: list[str] = field(default_factory=lambda: PROFILES)
    hatches: dict[str, str] = field(default_factory=lambda: HATCHES)
    parts: list[str] = field(default_factory=lambda: PARTS)
    qualifiers: list[str] = field(default_factory=lambda: QUALIFIERS)
    measures: dict[str, str] = field(default_factory=lambda: MEASURES)
    trades: dict[str, str] = field(default_factory=lambda: TRADES)
    continuation: list[str] = field(default_factory=lambda: CONTINUATION)


@dataclass(frozen=True)
class TextRules:
    """Tolerances of annotation reassembly (mm, shares, degrees, multiples of the text height)."""

    edge: float = 1.5
    height: float = 0.15
    gap: tuple[float, float] = (0.9, 1.7)
    rotation: float = 1.0
    same_layer: bool = True
    capture: float = 8.0
    note_layers: tuple[str, ...] = ("ANNO", "TEXT", "NOTE", "LEAD")


@dataclass(frozen=True)
class ShapeRules:
    """Tolerances of attribution (mm, degrees)."""

    snap: float = 0.5
    close_gap: float = 1.0
    least_area: float = 1.0
    pair: float = 25.0
    conflict: float = 1.0
    value_conflict: float = 1.0
    probe: float = 3.0
    parallel: float = 2.0
    cluster: float = 15.0
    candidates: float = 60.0
    wide_records: int = 10_000


@dataclass(frozen=True)
class SheetRules:
    """Tolerances of sheet segmentation (mm, shares)."""

    bubble: tuple[float, float] = (3.0, 25.0)
    search: float = 150.0
    least_share: float = 0.05
    island_gap: float = 25.0
    overlap: float = 0.5
    border_layers: tuple[str, ...] = ("VIEWPORT", "VPORT", "VIEW_PORT", "GRID", "SHEET")
    border_area: float = 10_000.0
