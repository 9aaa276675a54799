"""Find cubes, fields and terms by words or by vectors: BM25, cosine, rank fusion, diversity."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from cubeloom.catalog import Catalog, sees_field
from cubeloom.model import META, AuthContext

#: Fixed values of the ranking function and of rank fusion.
K1, B, FUSION = 1.2, 0.75, 60


@dataclass(frozen=True)
class Entry:
    """Something that can be found."""

    kind: str
    ref: str
    text: str


@dataclass(frozen=True)
class Hit:
    entry: Entry
    score: float


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def entries(catalog: Catalog, viewer: AuthContext | None = None) -> list[Entry]:
    """All that the viewer may know of."""
    out = []
    for cube in catalog.visible(viewer).values():
        if cube.backend == META or not cube.expose_in_prompt:
            continue
        out.append(Entry("cube", cube.name, " ".join([cube.name, cube.display_name or "", cube.description, *cube.questions, *cube.keywords])))
        out += [Entry(f.kind, f"{cube.name}.{f.name}", " ".join([f.name, f.display_name or "", f.description, *getattr(f, "aliases", ())])) for f in cube.fields() if sees_field(f, viewer)]
    out += [Entry("view", v.name, f"{v.name} {v.display_name or ''} {v.description}") for v in catalog.views.values()]
    out += [Entry("entity", e.name, " ".join([e.name, e.description, *e.questions, *e.keywords])) for e in catalog.entities.values()]
    out += [Entry("saved_query", s.name, " ".join([s.name, s.description, *s.questions, *s.keywords])) for s in catalog.saved_queries.values()]
    for g in catalog.glossary:
        out += [Entry("term", g.term, f"{g.term} {g.definition}"), *(Entry("term", g.term, a) for a in g.aliases)]
    return out


class WordIndex:
    """BM25 over entries."""

    def __init__(self, found: Iterable[Entry]):
        self.entries = list(found)
        self.counts = [Counter(words(e.text)) for e in self.entries]
        self.lengths = [c.total() for c in self.counts]
        self.mean = sum(self.lengths) / max(1, len(self.lengths))
        self.df = Counter(w for c in self.counts for w in c)

    def search(self, text: str, n: int = 10) -> list[Hit]:
        total = len(self.entries)
        hits = []
        for entry, count, length in zip(self.entries, self.counts, self.lengths, strict=True):
            score = 0.0
            for w in set(words(text)):
                if tf := count.get(w):
                    idf = math.log(1 + (total - self.df[w] + 0.5) / (self.df[w] + 0.5))
                    score += idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(self.mean, 1e-9)))
            if score > 0:
                hits.append(Hit(entry, score))
        return sorted(hits, key=lambda h: (-h.score, h.entry.ref))[:n]


def cosine(a: Sequence[float], b: Sequence[float]) -> float:
    norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / norm if norm else 0.0


class VectorIndex:
    """Cosine similarity of vectors that the caller's function makes."""

    def __init__(self, found: Iterable[Entry], embed: Callable[[list[str]], list[Sequence[float]]]):
        self.entries = list(found)
        self.embed = embed
        self.vectors = embed([e.text for e in self.entries]) if self.entries else []

    def search(self, text: str, n: int = 10) -> list[Hit]:
        [query] = self.embed([text])
        hits = [Hit(e, cosine(query, v)) for e, v in zip(self.entries, self.vectors, strict=True)]
        return sorted(hits, key=lambda h: (-h.score, h.entry.ref))[:n]

    def diverse(self, text: str, n: int = 10, balance: float = 0.7) -> list[Hit]:
        """Maximal marginal relevance: near the query, far from what is already chosen."""
        [query] = self.embed([text])
        left = list(range(len(self.entries)))
        near = [cosine(query, v) for v in self.vectors]
        chosen: list[int] = []
        while left and len(chosen) < n:
            best = max(left, key=lambda i: (balance * near[i] - (1 - balance) * max((cosine(self.vectors[i], self.vectors[j]) for j in chosen), default=0.0), -i))
            chosen.append(best)
            left.remove(best)
        return [Hit(self.entries[i], near[i]) for i in chosen]


def fuse(rankings: Iterable[list[Hit]], n: int = 10) -> list[Hit]:
    """Reciprocal rank fusion of several searches."""
    scores: dict[Entry, float] = {}
    for hits in rankings:
        for rank, h in enumerate(hits, 1):
            scores[h.entry] = scores.get(h.entry, 0.0) + 1 / (FUSION + rank)
    return [Hit(e, s) for e, s in sorted(scores.items(), key=lambda kv: (-kv[1], kv[0].ref))][:n]
