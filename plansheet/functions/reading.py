"""What an annotation says, in plain Python: for grouped kernels, where a reading decides how lines are joined.

text.py says the same in Column expressions; tests hold the two together.
"""

from __future__ import annotations

import difflib
import hashlib
import re
from collections.abc import Iterable
from functools import cached_property

from ..config import DOTTED, FREE_QUALIFIERS, SHEET_WORDS, UNIT_WORDS, Words

NUMBER = r"(\d+(?:\.\d+)?)\s*(mm|thk|cm|m)?\b"
MM = {"cm": 10.0, "m": 1000.0}


def squeeze(text: str | None) -> str:
    """White space collapsed and trimmed."""
    return re.sub(r"\s+", " ", text or "").strip()


def folded(text: str | None) -> str:
    return squeeze((text or "").casefold())


def normalised(text: str | None) -> str:
    """Folded, with . _ - / as spaces."""
    return squeeze(re.sub(r"[._\-/]+", " ", (text or "").casefold()))


def similarity(a: str | None, b: str | None) -> float:
    """Ratio of matching blocks of the normalised texts; 0 where either is empty."""
    a, b = normalised(a), normalised(b)
    if not a or not b:
        return 0.0
    return 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()


def text_likeness(a: str | None, b: str | None) -> float:
    """Ratio of the texts as they are; two empty ones are alike."""
    if not a or not b:
        return float(not a and not b)
    return difflib.SequenceMatcher(None, a, b).ratio()


def plain_mtext(text: str | None) -> str:
    """A multi-line text string as one line: codes and breaks are spaces, stacked fractions a/b, braces go, signs resolve."""
    s = re.sub(r"\\[Pp]", " ", text or "")
    for sign, char in (("d", "°"), ("p", "±"), ("c", "Ø")):
        s = s.replace(f"%%{sign}", char).replace(f"%%{sign.upper()}", char)
    s = re.sub(r"\\S([^;^]*)\^([^;]*);", r"\1/\2", s)
    s = re.sub(r"\\(?:[LOKloPXpm\d;?. ]|f[^;]*;|H[\d.]+x?;|[CTQWA]\d+;)", " ", s)
    return squeeze(re.sub(r"[{}]", "", s))


def short_hash(prefix: str, content: str, length: int) -> str:
    return prefix + hashlib.sha1(content.encode()).hexdigest()[:length]


def number_text(v) -> str:
    """A value as Python prints it; '' for None."""
    return "" if v is None else str(v)


def fingerprint(type_: str, layer: str, x: float, y: float, bbox: list[float], text, hatch, measurement, override) -> str:
    place = ",".join(f"{v:.1f}" for v in (x, y, *bbox))
    said = "|".join([type_, layer, place, text or "", hatch or "", number_text(measurement), override or ""])
    return "sha1:" + hashlib.sha1(said.encode()).hexdigest()


def _longest_first(names: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    return sorted(names, key=lambda x: -len(x[0]))


class Reader:
    """Reads annotations by a table of words."""

    def __init__(self, words: Words | None = None) -> None:
        self.words = words or Words()

    @cached_property
    def _materials(self):
        return [(re.compile(rf"\b{re.escape(k.lower())}\b"), m) for k, m in _longest_first((k, m) for m, ks in self.words.materials.items() for k in ks if k)]

    @cached_property
    def _parts(self):
        return [(re.compile(rf"\b{re.escape(p)}s?\b", re.I), p.lower()) for p, _ in _longest_first((p, p) for p in self.words.parts if p.strip())]

    @cached_property
    def _qualifiers(self):
        dotted = [(re.compile(rf"\b{k}\."), v) for k, v in DOTTED.items()]
        return dotted + [(re.compile(rf"\b{re.escape(q.lower())}\b"), q.lower()) for q in [*self.words.qualifiers, *FREE_QUALIFIERS]]

    @cached_property
    def _measures(self):
        return [(re.compile(rf"\b{re.escape(k)}\b"), m) for k, m in self.words.measures.items()]

    @cached_property
    def _trades(self):
        return [(re.compile(k, re.I), t) for k, t in self.words.trades.items()]

    @cached_property
    def _known_words(self) -> frozenset[str]:
        keywords = [k.upper() for ks in self.words.materials.values() for k in ks]
        return frozenset([*SHEET_WORDS, *UNIT_WORDS, *keywords, *(q.upper() for q in self.words.qualifiers)])

    @staticmethod
    def _first(tests, text: str) -> str | None:
        return next((name for pattern, name in tests if pattern.search(text)), None)

    def material(self, text: str | None) -> str | None:
        return self._first(self._materials, (text or "").lower())

    def layer_material(self, layer: str | None) -> str | None:
        return self.material(re.sub("[-_]", " ", layer or ""))

    def hatch_material(self, pattern: str | None) -> str | None:
        return {k.upper(): v for k, v in self.words.hatches.items()}.get((pattern or "").upper())

    def _value(self, text: str, measure: str | None) -> float | None:
        found = re.findall(NUMBER, text, re.I)
        if not found or measure == "fall" and re.search(r"\d\s*:\s*\d", text):
            return None
        number, unit = next((x for x in found if x[1].lower() in ("mm", "thk")), found[0])
        return float(number) * MM.get(unit.lower(), 1.0)

    def read(self, text: str | None) -> dict | None:
        """Fields that the text names (those absent are left out); None if it names none."""
        raw = (text or "").strip()
        if not raw:
            return None
        low = raw.lower()
        measure = self._first(self._measures, low)
        measure = None if measure == "thickness" else measure
        trade = self._first(self._trades, raw) if re.search(r"\bREFER\b", raw, re.I) else None
        said = {"material": self.material(raw), "part": self._first(self._parts, raw), "qualifier": self._first(self._qualifiers, low), "measure": measure, "delegated_to": trade}
        profile = re.search(rf"\b({'|'.join(map(re.escape, self.words.profiles))})\b", raw, re.I) if self.words.profiles else None
        rating = re.search(r"\bR\s*(\d+(?:\.\d+)?)\b", raw, re.I)
        if profile:
            size = re.search(r"(\d+(?:\.\d+)?)\s*[xX×?]\s*(\d+(?:\.\d+)?)", raw)
            said |= {"material": said["material"] or "steel", "profile": profile[1].upper(), "dims": [float(size[1]), float(size[2])] if size else None}
        elif rating and (said["material"] == "insulation" or "insul" in low):
            said |= {"material": said["material"] or "insulation", "r_value": float(rating[1])}
        elif said["material"] or measure:
            value = self._value(raw, self._first(self._measures, low))
            said |= {"value": value, "unit": "mm" if value is not None else None}
        elif not said["part"]:
            if said["qualifier"] not in ("varies", "tbc"):
                # a bare delegation names no field of the drawing
                return {"to": trade} if trade else None
        return {k: v for k, v in said.items() if v is not None}

    def read_element(self, text: str | None, hatch: str | None) -> dict | None:
        """The text's reading, else the hatch's material."""
        found = self.read(text)
        if found is None and (material := self.hatch_material(hatch)):
            return {"material": material}
        return found

    def score(self, text: str) -> tuple[float, bool]:
        """How complete a reading is, and whether it stands on its own."""
        said = self.read(text) or {}
        valued = said.get("value") is not None
        score = 2.0 * bool(said.get("material") or said.get("measure") and valued) + 1.0 * valued + 0.5 * bool(said.get("delegated_to") or said.get("part"))
        return score, score >= 2

    def continues(self, text: str) -> bool:
        """Does the text begin as the rest of another one?"""
        s = text.lstrip().upper()
        return any(s == w or s.startswith((w + " ", w + ".")) for w in map(str.upper, self.words.continuation))

    def is_continued(self, text: str) -> bool:
        """Does the text end as if another one went on?"""
        s = text.rstrip()
        if not s or s.endswith(("-", ",")):
            return bool(s)
        last = s.split()[-1].rstrip(".,;:").upper()
        return last in map(str.upper, self.words.continuation) or bool(re.match(r"^[A-Z]{1,4}\.$", last))

    def should_merge(self, lines: list[str]) -> bool:
        """Is the joined text a better reading than its lines are?"""
        whole, stands = self.score(" ".join(t.strip() for t in lines if t.strip()))
        apart, orphans = 0.0, 0
        for before, t in zip(["", *lines], lines, strict=False):
            score, complete = self.score(t.strip())
            if not complete and (self.continues(t) or before and self.is_continued(before)):
                orphans, score = orphans + 1, score - 3
            apart += score
        return stands and (orphans > 0 or whole > apart)

    def unknown_noun(self, text: str | None) -> str | None:
        """The longest word of capitals (four letters at least) that no table holds; the first of equals."""
        words = [w for w in re.findall(r"\b[A-Z]{4,}\b", text or "") if w not in self._known_words]
        return max(words, key=len).lower() if words else None


def ignored(text: str | None, entries: list[str], patterns: list[str] = ()) -> bool:
    """Blank, or equal to, beginning with or holding (as words) an entry, or matching a pattern."""
    said = folded(text)
    if not said:
        return True
    for e in filter(None, map(folded, entries)):
        if said.startswith(e) or re.search(rf"\b{re.escape(e)}\b", said):
            return True
    return any(re.search(p, text or "", re.I) for p in patterns)


def scale_of(text: str | None) -> str | None:
    """'1:n', 'NTS', or None."""
    m = re.search(r"\b1\s*:\s*(\d+(?:\.\d+)?)\b", text or "")
    return f"1:{m[1]}" if m else "NTS" if re.search(r"\b(?:NTS|NOT\s+TO\s+SCALE|DO\s+NOT\s+SCALE)\b", text or "", re.I) else None


def tells_scale(text: str | None) -> bool:
    return bool(re.search(r"\bscale\b", text or "", re.I)) or scale_of(text) is not None


def first_number(text: str | None) -> float | None:
    m = re.search(r"\d+(?:\.\d+)?", (text or "").replace(",", ""))
    return float(m[0]) if m else None


def references(text: str | None) -> list[str]:
    """Sheet numbers such as A.109, in order, each once."""
    return list(dict.fromkeys(re.findall(r"\b([A-Z]{1,3}\.\d{2,4}(?:/\d{2,4})?)\b", (text or "").upper())))


def slug(text: str | None, empty: str = "") -> str:
    return re.sub("[^a-z0-9]+", "_", (text or "").casefold()).strip("_") or empty


def amount_node(value: float) -> str:
    return f"value.{int(value) if float(value).is_integer() else float(value)}mm"
