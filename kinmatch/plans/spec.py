"""A search specification: which fields must or should match, how closely, and with what weight."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from kinmatch.functions.text import EMBEDDING_SUFFIX, camel_case, embedding_name, source_name

VECTOR, EXACT, IGNORE = "VECTOR", "EXACT", "IGNORE"
ROLES = (VECTOR, EXACT, IGNORE)


@dataclass(frozen=True)
class Clause:
    field: str
    kind: str  # "vector" or "exact"
    occur: str = "should"  # "must" or "should"
    weight: float = 1.0
    min_score: float = 0.0  # vector clauses only
    label: str = ""  # the name that a stored clause gives itself

    def __post_init__(self):
        if self.kind not in ("vector", "exact") or self.occur not in ("must", "should"):
            raise ValueError(f"bad clause {self}")
        if not self.weight >= 0:
            raise ValueError(f"weight of {self.field} is negative")
        if self.label == f"{self.column}_function":
            object.__setattr__(self, "label", "")  # the name that a clause has anyway

    @property
    def column(self) -> str:
        return embedding_name(self.field) if self.kind == "vector" else self.field

    @property
    def name(self) -> str:
        return self.label or f"{self.column}_function"


def _leading_int(value, default: int) -> int:
    found = re.match(r"\s*([+-]?\d+)", str(value)) if value is not None else None
    return int(found.group(1)) if found else default


def edited_number(value, default: float) -> float:
    """What the editor makes of a typed number: its leading digits count; nothing, text and zero give the default."""
    found = re.match(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", str(value)) if value is not None else None
    return (float(found.group(1)) if found else 0.0) or default


def _clause(occur: str, node) -> Clause | None:
    scored = node.get("function_score") if isinstance(node, dict) else None
    if not scored:
        return None
    query = scored.get("query") or {}
    weight = scored.get("weight")
    weight = 1.0 if weight is None else float(weight)
    if query.get("knn"):
        column, body = next(iter(query["knn"].items()))
        least = body.get("min_score")
        return Clause(source_name(column), "vector", occur, weight, 0.0 if least is None else float(least), scored.get("_name") or "")
    if query.get("term"):
        return Clause(next(iter(query["term"])), "exact", occur, weight, 0.0, scored.get("_name") or "")
    return None


@dataclass(frozen=True)
class SearchSpec:
    clauses: tuple[Clause, ...] = field(default_factory=tuple)
    size: int = 15
    explain: bool = True
    min_should: int = 0

    def __post_init__(self):
        if self.size < 1 or self.min_should < 0:
            raise ValueError("size must be positive and min_should not negative")

    @property
    def must(self) -> tuple[Clause, ...]:
        return tuple(c for c in self.clauses if c.occur == "must")

    @property
    def should(self) -> tuple[Clause, ...]:
        return tuple(c for c in self.clauses if c.occur == "should")

    # ---- construction -------------------------------------------------------------------------

    @classmethod
    def from_roles(cls, roles: Mapping[str, str]) -> SearchSpec:
        """Default specification: every configured column is an optional clause of weight 1."""
        kinds = {VECTOR: ("vector", 0.5), EXACT: ("exact", 0.0)}
        made = [Clause(camel_case(h), *_kind(kinds, r)) for h, r in roles.items() if r != IGNORE]
        return cls(tuple(made))

    @classmethod
    def vectors_required(
        cls,
        vectors: Mapping[str, tuple[float, float]],
        exacts: Mapping[str, float],
        size: int,
        min_should: int = 0,
        explain: bool = False,
    ) -> SearchSpec:
        """All vector fields required ((min_score, weight) each), all exact fields optional."""
        must = [Clause(f, "vector", "must", w, s) for f, (s, w) in vectors.items()]
        should = [Clause(f, "exact", "should", w) for f, w in exacts.items()]
        return cls(tuple(must + should), size, explain, min_should)

    @classmethod
    def from_json(cls, text: str | Mapping, strict: bool = False) -> SearchSpec:
        """Read a stored query in either of its written forms; text or parsed object. The editor takes one without query.bool
        for an empty specification; a search is `strict`, there it is an error."""
        try:
            doc = json.loads(text) if isinstance(text, str) else text
        except json.JSONDecodeError as e:
            raise ValueError(f"invalid JSON in search configuration: {e}") from e
        boolean = (doc.get("query") or {}).get("bool") if isinstance(doc, Mapping) else None
        if strict and not isinstance(boolean, Mapping):
            raise ValueError("search configuration has no query.bool")
        boolean = boolean or {}
        found = (_clause(occur, node) for occur in ("must", "should") for node in boolean.get(occur) or [])
        return cls(
            tuple(c for c in found if c),
            int(doc.get("size") or 10),
            bool(doc.get("explain") or False),
            _leading_int(boolean.get("minimum_should_match"), 0),
        )

    # ---- editing ------------------------------------------------------------------------------

    def fields(self) -> dict[str, Clause]:
        """Field table sorted by name; the last clause of a field counts."""
        return {f: c for f, c in sorted({c.field: c for c in self.clauses}.items())}

    def with_fields(self, changes: Iterable[Clause], remove: Iterable[str] = ()) -> SearchSpec:
        """Replace or add fields, and drop those set to none."""
        table = {**self.fields(), **{c.field: c for c in changes}}
        gone = set(remove)
        return replace(self, clauses=tuple(c for f, c in sorted(table.items()) if f not in gone))

    def edited(self, rows: Mapping[str, Mapping]) -> SearchSpec:
        """The specification after changes in the editor: `rows` maps fields to what was typed, any of kind (vector, exact or
        none), placement, weight and min_score. A weight of zero, or one that is no number, becomes 1; a least
        similarity that is no number becomes 0; a field switched to vector starts at 0; fields set to none go."""
        table, gone = self.fields(), {f for f, r in rows.items() if r.get("kind") == "none"}
        changes = []
        for name, typed in rows.items():
            if name in gone:
                continue
            old = table.get(name) or Clause(name, typed.get("kind", "exact"), "must")
            kind = typed.get("kind", old.kind)
            weight = edited_number(typed["weight"], 1.0) if "weight" in typed else old.weight
            least = edited_number(typed["min_score"], 0.0) if "min_score" in typed else old.min_score
            changes.append(Clause(name, kind, typed.get("placement", old.occur), weight, least if kind == "vector" else 0.0))
        return self.with_fields(changes, gone)

    # ---- output -------------------------------------------------------------------------------

    def to_dict(self, named: bool = False) -> dict:
        """Stored form: vector fields, then exact fields, in name order. `named=True` keeps the clause
        order and adds clause names and the long term form, as a new index is written."""
        ordered = self.clauses if named else sorted(self.fields().values(), key=lambda c: (c.kind == "exact", c.field))
        groups: dict[str, list] = {"must": [], "should": []}
        for c in ordered:
            if c.kind == "vector":
                query = {"knn": {c.column: {"vector": c.column, "min_score": c.min_score}}}
            else:
                query = {"term": {c.field: {"value": c.field} if named else c.field}}
            body = {"query": query, "weight": c.weight}
            if named:
                body["_name"] = c.name
            groups[c.occur].append({"function_score": body})
        boolean = {"minimum_should_match": str(self.min_should), **groups}
        return {"size": self.size, "explain": self.explain, "query": {"bool": boolean}}

    def to_json(self, named: bool = False) -> str:
        return json.dumps(self.to_dict(named), ensure_ascii=False)


def _kind(kinds: Mapping[str, tuple[str, float]], role: str) -> tuple[str, str, float, float]:
    if role not in kinds:
        raise ValueError(f"unknown role {role!r}; use one of {ROLES}")
    kind, least = kinds[role]
    return kind, "should", 1.0, least


def item_schema(roles: Mapping[str, str]) -> T.StructType:
    """Columns of the item table for the given roles."""
    columns: dict[str, T.DataType] = {}
    for header, role in roles.items():
        name = camel_case(header)
        columns[name] = T.StringType()
        if role == VECTOR:
            columns[name + EMBEDDING_SUFFIX] = T.ArrayType(T.FloatType())
    system = [("index_name", T.StringType()), ("item_id", T.StringType()), ("source_path", T.StringType())]
    system.append(("row_no", T.LongType()))
    return T.StructType([T.StructField(n, t) for n, t in system + list(columns.items())])
