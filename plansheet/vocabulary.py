"""The vocabulary as an object for kernels and small decisions: a graph of components, parts, attributes and values with several parents each.

It is a table of some hundred nodes that a firm keeps by hand; what grows with
the drawings is handled by operators/vocabulary.py as DataFrames.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cached_property

from .config import ASSEMBLIES, ASSEMBLY_NODES, CONTEXT_NAMES, CONTEXTS, JUNCTION_NODES, JUNCTIONS, MEASURE_NODES, PROJECTION_NAMES, PROJECTIONS
from .functions import reading as R

LEVELS = ("component", "part", "attribute", "value")
#: The first part of ids of each level.
PREFIX = {"component": "component", "part": "part", "attribute": "attr", "value": "value"}
_LEVEL_RANK = {"part": 0, "component": 1, "value": 2, "attribute": 3}


class VocabularyError(ValueError):
    pass


class Vocabulary:
    """nodes: dicts of id, level, label, synonyms, definition, parents, deprecated_by, value_type, enum_members, slug (absent: empty)."""

    def __init__(self, nodes: Iterable[dict], aliases: dict[str, str] | None = None, ignore: Iterable[str] = (), ignore_patterns: Iterable[str] = ()) -> None:
        self.nodes = {n["id"]: n for n in nodes}
        self.aliases, self.ignore, self.ignore_patterns = dict(aliases or {}), list(ignore), list(ignore_patterns)

    @cached_property
    def children(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for i, n in self.nodes.items():
            for p in n.get("parents") or []:
                out.setdefault(p, []).append(i)
        return {p: sorted(c, key=lambda i: self.label(i)) for p, c in out.items()}

    def label(self, i: str) -> str:
        """The node's label; of an unknown id what stands behind its dot."""
        return (self.nodes.get(i) or {}).get("label") or (i.split(".", 1)[1].replace("_", " ") if "." in i else i)

    def names(self, n: dict) -> list[str]:
        return [n.get("label") or "", *(n.get("synonyms") or [])]

    def current(self) -> Iterable[dict]:
        return (n for n in self.nodes.values() if not n.get("deprecated_by"))

    def resolve(self, i: str) -> str:
        """Where aliases and deprecations lead; in a circle, the first id met again."""
        seen = set()
        while i not in seen:
            seen.add(i)
            after = self.aliases.get(i) or (self.nodes.get(i) or {}).get("deprecated_by")
            if not after or after == i:
                return i
            i = after
        return i

    def _walk(self, i: str, step) -> set[str]:
        out, todo = set(), [i]
        while todo:
            new = [x for x in step(todo.pop()) if x not in out]
            out.update(new)
            todo += new
        return out

    def ancestors(self, i: str) -> set[str]:
        return self._walk(i, lambda x: (self.nodes.get(x) or {}).get("parents") or [])

    def descendants(self, i: str) -> set[str]:
        return self._walk(i, lambda x: self.children.get(x, []))

    def paths(self, i: str) -> list[list[str]]:
        """Every way from a root."""
        parents = (self.nodes.get(i) or {}).get("parents") or []
        return [[*p, i] for x in parents for p in self.paths(x)] if parents else [[i]]

    def covers(self, node: str, i: str) -> bool:
        """Is the node i, or above it?"""
        return i == node or node in self.ancestors(i)

    # --- search

    def search(self, query: str, limit: int = 25, deprecated: bool = False) -> list[tuple[dict, float]]:
        """Nodes by their best name: 1 equal, 0.85 one in the other, else shared words or likeness; 0.5 by definition; 0.5 at least."""
        q = R.normalised(query)
        if not q:
            return []
        words = set(q.split())

        def rate(name: str) -> float:
            n = R.normalised(name)
            if not n or n == q:
                return float(bool(n))
            return 0.85 if q in n or n in q else max(0.9 * len(words & set(n.split())) / len(words), 0.7 * R.similarity(q, n))

        out = []
        for n in self.nodes.values() if deprecated else self.current():
            best = max(map(rate, self.names(n)))
            if best < 0.5 and q in R.normalised(n.get("definition")):
                best = 0.5
            if best >= 0.5:
                out.append((n, round(best, 3)))
        return sorted(out, key=lambda x: (-x[1], x[0]["label"]))[:limit]

    def node_for(self, query: str) -> str | None:
        """The node a query means: of the five best one named exactly so (a part before others), else the best."""
        hits = [n for n, _ in self.search(query, 5)]
        exact = [n for n in hits if R.normalised(query) in map(R.normalised, self.names(n))]
        exact.sort(key=lambda n: (_LEVEL_RANK.get(n["level"], 9), n["label"]))
        best = next(iter([*exact, *hits]), None)
        return best and self.resolve(best["id"])

    def duplicates(self, label: str, synonyms: Iterable[str] = (), threshold: float = 0.75) -> list[tuple[dict, float, str]]:
        """Nodes with a name that is like the proposed ones, best first."""
        out = []
        for n in self.current():
            score, name = max(((R.similarity(p, x), x) for p in [label, *synonyms] for x in self.names(n)), key=lambda x: x[0])
            if score > threshold:
                out.append((n, round(score, 3), name))
        return sorted(out, key=lambda x: (-x[1], x[0]["id"]))

    def suggest(self, text: str, context: Iterable[str] = (), limit: int = 3) -> list[tuple[str, float]]:
        """Nodes for a text, those on the same detail or below such first."""
        around, out = set(context), []
        for n, score in self.search(text, 8):
            more = 0.25 if n["id"] in around else 0.15 if self.ancestors(n["id"]) & around else 0.0
            out.append((n["id"], round(min(1.0, score + more) if more else score, 2)))
        return sorted(out, key=lambda x: (-x[1], x[0]))[:limit]

    # --- words to nodes

    def _named(self, text: str | None, level: str | None, ordered: Iterable[dict]) -> str | None:
        said = R.folded(text)
        hit = next((n for n in ordered if said and not n.get("deprecated_by") and level in (None, n["level"]) and said in map(R.folded, self.names(n))), None)
        return hit and self.resolve(hit["id"])

    def _token(self, level: str, text: str | None) -> str | None:
        if not text:
            return None
        i = f"{level}.{R.slug(text)}"
        return self.resolve(i) if i in self.nodes else self._named(text, level, self.nodes.values())

    def material(self, text: str | None) -> str | None:
        return self._token("value", text)

    def part(self, text: str | None) -> str | None:
        return self._token("part", text)

    def known(self, text: str | None) -> str | None:
        return self._named(text, None, (self.nodes[i] for i in sorted(self.nodes)))

    def is_component_word(self, text: str | None) -> bool:
        """Is the word a component's name, or the last word of one?"""
        said = R.folded(text)
        return bool(said) and " " not in said and any(n["level"] == "component" and any(R.folded(x).split()[-1:] == [said] for x in self.names(n)) for n in self.current())

    def ignores(self, text: str | None) -> bool:
        return R.ignored(text, self.ignore, self.ignore_patterns)

    # --- classification

    def compose(self, components: Iterable[str], part: str | None, material: str | None, value: float | None, measure: str | None = "thickness") -> list[list[str]]:
        """Paths for one fact: part, attribute and value under every component that applies."""
        part = self.resolve(part) if part else None
        part = part if part in self.nodes else None
        kind = self.material(material)
        known = {c for c in map(self.resolve, components) if c in self.nodes}
        if part:
            known &= self.ancestors(part) | {part}
        leaf = MEASURE_NODES.get(measure or "thickness", "attr.thickness")
        said = [["attr.material", kind]] if kind else []
        said += [[leaf, R.amount_node(value)]] if value is not None and (kind or not part) else []
        tails = [[part, *t] for t in said] or [[part]] if part else said
        return [[c, *t] for t in tails for c in sorted(known)] if known else tails

    def classify(self, fact: dict, components: Iterable[str]) -> tuple[list[dict], dict | None]:
        """A fact's classifications, or what is unknown about it."""
        part = self.part(fact.get("part"))
        if fact.get("part") and not part and not self.material(fact["part"]) and not self.is_component_word(fact["part"]):
            return [], {"level_guess": "part", "attribute": None, "reason": f"unknown-part:{fact['part']}"}
        if fact.get("material") and not self.material(fact["material"]):
            return [], {"level_guess": "value", "attribute": "attr.material", "reason": f"unknown-material:{fact['material']}"}
        paths = self.compose(components, part, fact.get("material"), fact.get("value"), fact.get("measure"))
        if not paths:
            return [], {"level_guess": "part", "attribute": None, "reason": "unresolvable"}
        shown = {"confidence": fact.get("confidence"), "attribution_chain": fact.get("chain"), "element_id": fact.get("element_id"), "exact_value": fact.get("value"), "qualifier": fact.get("qualifier")}
        return [{"path": p, **shown} for p in paths], None

    def facet_nodes(self, facets: dict) -> list[str]:
        """Nodes that a detail's junction and assembly stand for."""
        known = ASSEMBLY_NODES | JUNCTION_NODES
        wanted = [known.get(facets.get(k)) for k in ("junction_type", "assembly")]
        return sorted({self.resolve(i) for i in wanted if i in self.nodes})

    def facet_components(self, facets: dict) -> list[str]:
        return [i for i in self.facet_nodes(facets) if (self.nodes.get(i) or {}).get("level") == "component"]

    def refacet(self, record: dict, facets: dict) -> dict:
        """A detail with facets that a person confirmed: its paths get the new components in front, once each."""
        for name, allowed in (("context", CONTEXT_NAMES), ("projection", PROJECTION_NAMES)):
            if facets.get(name) not in (None, *allowed):
                raise ValueError(f"{name} must be one of {allowed}")
        out = record | {k: facets[k] for k in ("junction_type", "assembly", "context", "projection") if facets.get(k) is not None}
        out["classified_by"], out["facet_nodes"] = facets.get("classified_by", "human"), self.facet_nodes(out)
        components = self.facet_components(out)
        found: dict[tuple, dict] = {}
        for c in record.get("classifications") or []:
            rest = [e for e in c.get("path") or [] if not e.startswith("component.")]
            part = next((e for e in rest if e.startswith("part.")), None)
            use = [x for x in components if part is None or self.covers(x, part)]
            for path in [[x, *rest] for x in use] or [rest]:
                found.setdefault((tuple(path), c.get("element_id"), c.get("attribution_chain")), c | {"path": path})
        out["classifications"] = sorted(found.values(), key=lambda c: (c["path"], c.get("element_id") or ""))
        return out

    # --- upkeep

    def problems(self) -> list[str]:
        """What is wrong with the nodes; empty if nothing is."""
        out = []
        for i, n in self.nodes.items():
            level, parents = n.get("level"), n.get("parents") or []
            if level not in LEVELS:
                out.append(f"{i}: bad level {level!r}")
                continue
            if not n.get("label"):
                out.append(f"{i}: label is required")
            if i.split(".", 1)[0] != PREFIX[level]:
                out.append(f"{i}: id prefix must be {PREFIX[level]!r}")
            if level != "value" and not n.get("definition"):
                out.append(f"{i}: definition is required")
            if level in ("component", "attribute") and parents:
                out.append(f"{i}: {level}s take no parents")
            if level in ("part", "value") and not parents:
                out.append(f"{i}: {level}s need a parent")
            allowed = {"part": ("component", "part"), "value": ("attribute",)}.get(level, ())
            for p in parents:
                above = self.nodes.get(p)
                if above is None:
                    out.append(f"{i}: unknown parent {p}")
                elif allowed and above.get("level") not in allowed:
                    out.append(f"{i}: parent {p} must be one of {allowed}")
                elif level == "value" and above.get("value_type") == "enum" and R.normalised(n.get("slug") or i.split(".", 1)[1]) not in map(R.normalised, above.get("enum_members") or []):
                    out.append(f"{i}: not admitted under enum {p}")
        return out + [f"cycle: {' -> '.join(c)}" for c in self.cycles()]

    def cycles(self) -> list[list[str]]:
        """Ways from a node over parents back to it, one for each circle met."""
        out, done = [], set()

        def visit(i: str, way: list[str]) -> None:
            if i in way:
                out.append([*way[way.index(i) :], i])
            elif i not in done and i in self.nodes:
                for p in self.nodes[i].get("parents") or []:
                    visit(p, [*way, i])
                done.add(i)

        for i in self.nodes:
            visit(i, [])
        return out

    def with_node(self, node: dict) -> Vocabulary:
        """A copy that holds the node (in place of one with its id), if that is sound."""
        out = Vocabulary([*(n for n in self.nodes.values() if n["id"] != node["id"]), node], self.aliases, self.ignore, self.ignore_patterns)
        if problems := out.problems():
            raise VocabularyError("; ".join(problems))
        return out

    def merged(self, loser: str, winner: str) -> Vocabulary:
        """A copy in which one node is deprecated in favour of another: an alias leads there, children and synonyms move."""
        if loser not in self.nodes or winner not in self.nodes or loser == winner:
            raise VocabularyError(f"cannot merge {loser} into {winner}")
        gone, out = self.nodes[loser], []
        for n in self.nodes.values():
            parents = list(dict.fromkeys(winner if p == loser else p for p in n.get("parents") or [] if not (n["id"] == winner and p == loser)))
            n = n | {"parents": parents}
            if n["id"] == loser:
                n |= {"deprecated_by": winner}
            elif n["id"] == winner:
                n |= {"synonyms": sorted({*(n.get("synonyms") or []), *filter(None, self.names(gone))})}
            out.append(n)
        return Vocabulary(out, self.aliases | {loser: winner}, self.ignore, self.ignore_patterns)

    def tree(self, root: str | None = None) -> list[tuple[list[str], str]]:
        """(path, label) of all nodes below the root (else below all components), depth first, by label."""
        if root is not None and root not in self.nodes:
            raise VocabularyError(f"unknown node: {root}")
        tops = [root] if root else sorted((n["id"] for n in self.current() if n["level"] == "component" and not n.get("parents")), key=self.label)

        def below(path: list[str]):
            yield path, self.label(path[-1])
            for c in self.children.get(path[-1], []):
                if not self.nodes[c].get("deprecated_by"):
                    yield from below([*path, c])

        return [x for t in tops for x in below([t])]


def facets_of(title: str | None, texts: Iterable[str]) -> dict:
    """Junction, assembly, context and projection that a detail's title and texts tell of."""
    said = R.folded(f"{title or ''} {' '.join(texts)}")
    has = lambda w: bool(re.search(rf"\b{re.escape(w)}\b", said))
    first = lambda rules, test: next((k for k, words in rules.items() if test(map(has, words))), None)
    out = {"junction_type": first(JUNCTIONS, all), "assembly": first(ASSEMBLIES, all), "context": first(CONTEXTS, any), "projection": first(PROJECTIONS, any)}
    return out | {"classified_by": "auto" if any(out.values()) else "none"}
