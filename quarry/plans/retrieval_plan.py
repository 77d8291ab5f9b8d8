"""Driver-side planning of one request: cardinality, features of the query, strategy, sub-queries."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.text import STOPWORDS

# Defaults and limits of an answer by what it lists.
CAPS = {("document", "list"): 50, ("section", "list"): 50, ("section", "answer"): 24, ("entity", "list"): 100}
DEFAULT_COUNT = 8
_COUNT = re.compile(r"(?i)\b(?:liệt\s+kê|list|show|top|tìm|give(?:\s+me)?)\s+(?:\w+\s+)?(\d{1,4})\b|\b(\d{1,4})\s+(?:file|document|tài\s+liệu|section|result)s?\b")
_TIME = re.compile(r"(?i)\b(?:latest|current|newest|before|after|since|history|previous|mới\s+nhất|hiện\s+tại|trước|sau)\b|\b(?:19|20)\d{2}\b")
_RELATION = re.compile(r"(?i)\b(?:between|related?|relation|depends?|connected|compare|liên\s+quan|giữa|so\s+sánh)\w*")
_GLOBAL = re.compile(r"(?i)\b(?:overall|all|summary|summari[sz]e|overview|tổng\s+quan|toàn\s+bộ)\b")


@dataclass(frozen=True)
class QueryFeatures:
    terms: tuple[str, ...]
    exact: tuple[str, ...]
    identifiers: tuple[str, ...]
    paths: tuple[str, ...]
    dates: tuple[str, ...]
    temporal: bool
    relational: bool
    wide: bool
    multi_hop: bool


@dataclass(frozen=True)
class RetrievalPlan:
    count: int
    count_from: str
    target: str
    output: str
    strategy: str
    features: QueryFeatures
    sub_queries: tuple[str, ...] = field(default_factory=tuple)


def bridge_dates(query: str) -> tuple[str, ...]:
    """Dates of the query in both forms, DD/MM/YYYY and ISO."""
    out = []
    for d, m, y in re.findall(r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", query):
        out += [f"{int(d):02d}/{int(m):02d}/{y}", f"{y}-{int(m):02d}-{int(d):02d}"]
    for y, m, d in re.findall(r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", query):
        out += [f"{y}-{int(m):02d}-{int(d):02d}", f"{int(d):02d}/{int(m):02d}/{y}"]
    return tuple(dict.fromkeys(out))


def features(query: str) -> QueryFeatures:
    words = re.findall(r"[^\W_]+", query.lower())
    clauses = [c for c in re.split(r"[;,?]|\b(?:and|và|then|rồi)\b", query) if len(c.split()) >= 3]
    relations = {m.lower()[:6] for m in _RELATION.findall(query)}
    return QueryFeatures(
        terms=tuple(dict.fromkeys(w for w in words if w not in STOPWORDS)),
        exact=tuple(re.findall(r"[\"“]([^\"”]{2,80})[\"”]", query)),
        identifiers=tuple(re.findall(r"\b(?:[A-Z]{2,12}-\d[\w-]*|\w*\d+\w*[a-z]\w*)\b", query)),
        paths=tuple(re.findall(r"(?<![\w:/])/(?:[\w.{}-]+/)+[\w.{}-]*", query)),
        dates=bridge_dates(query),
        temporal=bool(_TIME.search(query)),
        relational=bool(relations),
        wide=bool(_GLOBAL.search(query)),
        multi_hop=len(relations) >= 2 or (bool(relations) and len(clauses) >= 2),
    )


def plan(query: str, api_count: int | None = None, target: str = "section", output: str = "list") -> RetrievalPlan:
    """The query's own number counts before the caller's, the caller's before the default; limits hold for all."""
    said = next((int(a or b) for a, b in _COUNT.findall(query)), None)
    count, origin = (said, "QUERY") if said is not None else (api_count, "API") if api_count is not None else (DEFAULT_COUNT, "DEFAULT")
    count = max(1, min(count, CAPS.get((target, output), 50)))
    f = features(query)
    strategy = "graph" if f.multi_hop else "global" if f.wide else "temporal" if f.temporal else "exact" if f.exact or f.identifiers or f.paths else "hybrid"
    parts = tuple(c.strip() for c in re.split(r"[;?]|\b(?:and|và)\b", query) if len(c.split()) >= 3)[:3]
    return RetrievalPlan(count, origin, target, output, strategy, f, parts if len(parts) > 1 else ())
