"""Annotation text as Column expressions: normalisers, keyword look-ups, numbers and the semantic parser."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DOTTED, FREE_QUALIFIERS, SHEET_WORDS, UNIT_WORDS, Words
from .reading import MM, NUMBER

#: Sheet numbers such as A.109.
REFERENCE = r"\b([A-Z]{1,3}\.\d{2,4}(?:/\d{2,4})?)\b"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def folded(c: Column) -> Column:
    """Lower case, white space collapsed."""
    return squeeze(F.lower(c))


def normalise(c: Column) -> Column:
    """Lower case, . _ - / as spaces, white space collapsed."""
    return squeeze(F.regexp_replace(F.lower(c), r"[._\-/]+", " "))


def tag(c: Column) -> Column:
    """Upper case, white space collapsed."""
    return squeeze(F.upper(c))


def slug(c: Column, joint: str = "_") -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", joint), f"^{joint}+|{joint}+$", "")


def node_id(level: str, c: Column) -> Column:
    return F.concat(F.lit(f"{level}."), slug(c))


def amount_node(c: Column) -> Column:
    """value.3mm, value.6.38mm."""
    return F.concat(F.lit("value."), F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string")), F.lit("mm"))


def unescape_mtext(c: Column) -> Column:
    """A multi-line text string as one line: codes and breaks are spaces, stacked fractions a/b, braces go, signs resolve."""
    steps = [
        (r"\\[Pp]", " "), (r"%%[dD]", "°"), (r"%%[pP]", "±"), (r"%%[cC]", "Ø"), (r"\\S([^;^]*)\^([^;]*);", "$1/$2"),
        (r"\\(?:[LOKloPXpm\d;?. ]|f[^;]*;|H[\d.]+x?;|[CTQWA]\d+;)", " "), (r"[{}]", ""),
    ]
    return squeeze(reduce(lambda x, s: F.regexp_replace(x, *s), steps, c))


def first_number(c: Column) -> Column:
    """First number, thousands' commas dropped."""
    return F.regexp_extract(F.regexp_replace(c, ",", ""), r"\d+(?:\.\d+)?", 0).try_cast("double")


def _first_of(low: Column, tests: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(low.rlike(p), F.lit(name)) for p, name in tests], F.lit(None).cast("string"))


def longest_keyword(c: Column, keywords: dict[str, str], plural: bool = False) -> Column:
    """Name of the longest word-bounded keyword in the text; earlier entries win ties; null if none occurs."""
    ranked = sorted(enumerate(keywords.items()), key=lambda x: (-len(x[1][0]), x[0]))
    return _first_of(F.lower(c), [(rf"\b{re.escape(k.lower())}{'s?' if plural else ''}\b", name) for _, (k, name) in ranked])


def first_keyword(c: Column, keywords: dict[str, str]) -> Column:
    """Name of the first listed keyword that occurs as words."""
    return _first_of(F.lower(c), [(rf"\b{re.escape(k)}\b", name) for k, name in keywords.items()])


def material(c: Column, words: Words | None = None) -> Column:
    return longest_keyword(c, {k: m for m, ks in (words or Words()).materials.items() for k in ks})


def layer_material(c: Column, words: Words | None = None) -> Column:
    return material(F.translate(c, "-_", "  "), words)


def hatch_material(c: Column, words: Words | None = None) -> Column:
    return F.coalesce(*[F.when(F.upper(c) == k.upper(), F.lit(m)) for k, m in (words or Words()).hatches.items()], F.lit(None).cast("string"))


def part(c: Column, words: Words | None = None) -> Column:
    return longest_keyword(c, {p: p.lower() for p in (words or Words()).parts}, plural=True)


def qualifier(c: Column, words: Words | None = None) -> Column:
    """Dotted abbreviations first, then the listed words in their order."""
    named = [*(words or Words()).qualifiers, *FREE_QUALIFIERS]
    return _first_of(F.lower(c), [(rf"\b{k}\.", v) for k, v in DOTTED.items()] + [(rf"\b{re.escape(q.lower())}\b", q.lower()) for q in named])


def measure(c: Column, words: Words | None = None) -> Column:
    return first_keyword(c, (words or Words()).measures)


def delegated_to(c: Column, words: Words | None = None) -> Column:
    return F.when(c.rlike(r"(?i)\bREFER\b"), _first_of(c, [(f"(?i){p}", t) for p, t in (words or Words()).trades.items()]))


def profile(c: Column, words: Words | None = None) -> Column:
    names = "|".join(map(re.escape, (words or Words()).profiles))
    return F.nullif(F.upper(F.regexp_extract(c, rf"(?i)\b({names})\b", 1)), F.lit(""))


def references(c: Column, pattern: str = REFERENCE) -> Column:
    """Ordered distinct matches of the pattern's first group in upper case."""
    return F.array_distinct(F.regexp_extract_all(F.upper(c), F.lit(pattern), F.lit(1)))


def wet_area(texts: Column) -> Column:
    return F.exists(texts, lambda t: F.coalesce(F.contains(F.lower(t), F.lit("wet area")), F.lit(False)))


def scale_of(c: Column) -> Column:
    """'1:n', 'NTS', or null."""
    n = F.regexp_extract(c, r"\b1\s*:\s*(\d+(?:\.\d+)?)\b", 1)
    return F.when(n != "", F.concat(F.lit("1:"), n)).when(c.rlike(r"(?i)\b(?:NTS|NOT\s+TO\s+SCALE|DO\s+NOT\s+SCALE)\b"), "NTS")


def tells_scale(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)\bscale\b"), F.lit(False)) | scale_of(c).isNotNull()


def ignored(c: Column, entries: list[str], patterns: list[str] = ()) -> Column:
    """Blank, or equal to, beginning with or holding (as words) an entry, or matching a pattern."""
    said, out = folded(c), folded(c) == ""
    for e in filter(None, (" ".join(x.lower().split()) for x in entries)):
        out = out | said.startswith(e) | said.rlike(rf"\b{re.escape(e)}\b")
    for p in patterns:
        out = out | c.rlike(f"(?i){p}")
    return out


def unknown_noun(c: Column, words: Words | None = None) -> Column:
    """The longest word of capitals (four letters at least) that no table holds; the first of equals."""
    w = words or Words()
    known = sorted({*SHEET_WORDS, *UNIT_WORDS, *(k.upper() for ks in w.materials.values() for k in ks), *(q.upper() for q in w.qualifiers)})
    found = F.filter(F.regexp_extract_all(c, F.lit(r"\b([A-Z]{4,})\b"), F.lit(1)), lambda x: ~x.isin(known))
    best = F.aggregate(found, F.lit(""), lambda top, x: F.when(F.length(x) > F.length(top), x).otherwise(top))
    return F.nullif(F.lower(best), F.lit(""))


def content_words(c: Column, vocabulary: list[str], fillers: list[str]) -> Column:
    """Words of three letters and more that neither the vocabulary nor the fillers hold."""
    return F.filter(F.regexp_extract_all(folded(c), F.lit("([a-z0-9]+)"), F.lit(1)), lambda x: (F.length(x) >= 3) & ~x.isin([*fillers, *vocabulary]))


def bigrams(words: Column) -> Column:
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) > 1, F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def length_mm(c: Column) -> Column:
    """The first number in mm (or before THK), else the first number, cm and m turned into mm; null without any."""
    found = F.regexp_extract_all(F.lower(c), F.lit(NUMBER), F.lit(0))
    pick = F.coalesce(F.get(F.filter(found, lambda x: x.rlike("(?:mm|thk)$")), F.lit(0)), F.get(found, F.lit(0)))
    unit = F.regexp_extract(pick, "[a-z]*$", 0)
    factor = reduce(lambda x, u: x.when(unit == u[0], u[1]), MM.items(), F.when(F.lit(False), 1.0)).otherwise(1.0)
    return F.regexp_extract(pick, r"^\d+(?:\.\d+)?", 0).try_cast("double") * factor


def parse(c: Column, words: Words | None = None) -> Column:
    """Struct of what an annotation says; null for blank or meaningless text.

    material, value, unit, qualifier, profile, dims, r_value, part, measure
    (null for thickness), delegated_to, and bare_to (a trade where the text
    says nothing but to refer to it).
    """
    text = F.trim(c)
    named, of, said, word, trade = material(text, words), part(text, words), qualifier(text, words), measure(text, words), delegated_to(text, words)
    other = F.when(word != "thickness", word)
    shape = profile(text, words)
    dims = [F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*[xX×?]\s*(\d+(?:\.\d+)?)", i).try_cast("double") for i in (1, 2)]
    rated = F.when(shape.isNull() & ((named == "insulation") | F.contains(F.lower(text), F.lit("insul"))), F.regexp_extract(text, r"(?i)\bR\s*(\d+(?:\.\d+)?)\b", 1).try_cast("double"))
    kind = F.when(shape.isNotNull(), F.coalesce(named, F.lit("steel"))).when(rated.isNotNull(), F.coalesce(named, F.lit("insulation"))).otherwise(named)
    ratio = F.coalesce((word == "fall") & text.rlike(r"\d\s*:\s*\d"), F.lit(False))
    value = F.when(shape.isNull() & rated.isNull() & (named.isNotNull() | other.isNotNull()) & ~ratio, length_mm(text))
    means = kind.isNotNull() | other.isNotNull() | of.isNotNull() | F.coalesce(said.isin("varies", "tbc"), F.lit(False))
    out = F.struct(
        kind.alias("material"), value.alias("value"), F.when(value.isNotNull(), "mm").alias("unit"), F.when(means, said).alias("qualifier"), shape.alias("profile"),
        F.when(shape.isNotNull() & dims[0].isNotNull(), F.array(*dims)).alias("dims"), rated.alias("r_value"), of.alias("part"), other.alias("measure"),
        F.when(means, trade).alias("delegated_to"), F.when(~means, trade).alias("bare_to"),
    )
    return F.when((text != "") & (means | trade.isNotNull()), out)


def completeness(parsed: Column) -> Column:
    """How much a reading says: 2 for a material or a measured value, 1 for a value, 0.5 for a part or a delegation."""
    value = parsed["value"].isNotNull()
    score = F.when(parsed["material"].isNotNull() | parsed["measure"].isNotNull() & value, 2.0).otherwise(0.0)
    score = score + F.when(value, 1.0).otherwise(0.0) + F.when(parsed["part"].isNotNull() | parsed["delegated_to"].isNotNull(), 0.5).otherwise(0.0)
    return F.coalesce(score, F.lit(0.0))


def fingerprint(r: Column) -> Column:
    """Digest of an element's type, layer, place (0.1 mm, which the readers round to) and texts; r: a record (geom.bbox of four)."""
    numbers = [r["geom"]["x"], r["geom"]["y"], *(r["geom"]["bbox"][i] for i in range(4))]
    place = F.concat_ws(",", *[F.format_string("%.1f", F.coalesce(n, F.lit(0.0))) for n in numbers])
    text = lambda name: F.coalesce(r[name].cast("string"), F.lit(""))
    said = F.concat_ws("|", text("type"), text("layer"), place, text("text_raw"), text("hatch_pattern"), text("dim_measurement"), text("dim_override"))
    return F.concat(F.lit("sha1:"), F.sha1(said))


def short_hash(prefix: str, length: int, *parts: Column, joint: str = "|") -> Column:
    """prefix and the first digits of the digest of the parts (null: empty)."""
    said = F.concat_ws(joint, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha1(said), 1, length))


def detail_id(drawing: Column, tag_: Column) -> Column:
    return short_hash("d_", 4, drawing, tag_, joint="::")


def occurrence_uid(normalised_: Column, level: Column, element: Column, commit: Column) -> Column:
    return short_hash("u_", 6, normalised_, level, element, commit)


def dimension_uid(drawing: Column, element: Column, value: Column) -> Column:
    return short_hash("vd_", 6, drawing, element, value)
