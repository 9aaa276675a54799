"""Secret scans with multipart credential linking.

Three kinds of strong findings come from patterns alone. Weak candidates (a user or client name, a
long random-looking token, an endpoint) are too common to report by themselves. An interval join
links them: within a scope (a paragraph, and there at most ``REACH`` characters away) an identifier,
a secret and an endpoint are complementary parts, and a weak candidate is reported only if a part of
a complementary role co-occurs. The parts of a scope are sorted by place and swept once for each
role, so the join is linear in the parts and never makes all pairs.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import lean

#: Fixed patterns of the strong kinds, with the least length that counts.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_ASSIGN_LENGTH = 12
_BARE_LENGTH = 20
#: Weak candidates, of any length; each part of a pattern is one run, so a scan is linear.
_LOGIN = re.compile(r"""(?<![A-Za-z0-9])(?:user(?:name)?|login|client_?id|account|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", re.I | re.A)
_BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"\b(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]{3,}", re.A)

KINDS = ("assign", "access", "hex", "login", "bare", "endpoint")
BASE_KINDS = KINDS[:3]
IDENTIFIER, SECRET, ENDPOINT = "identifier", "secret", "endpoint"
ROLE = {"assign": SECRET, "access": IDENTIFIER, "hex": SECRET, "login": IDENTIFIER, "bare": SECRET, "endpoint": ENDPOINT}
#: The roles that make a weak candidate of a role worth reporting.
COMPLEMENTS = {IDENTIFIER: (SECRET,), SECRET: (IDENTIFIER, ENDPOINT), ENDPOINT: (SECRET,)}
REACH = 300
MIN_ENTROPY = 3.5

Span = tuple[int, str, int]


def base_spans(text: str) -> list[Span]:
    """The strong findings: (start, kind, end), leftmost and non-overlapping within a kind."""
    found = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[1]), span[2]


def entropy(token: str) -> float:
    """Bits per character."""
    return -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values())


def weak_spans(text: str, strong: list[Span]) -> list[Span]:
    """Candidates that only count together; none overlaps a strong finding of its role.

    An access key is an identifier: its characters do not make a bare token, those beside it may.
    """
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), "login", m.end()) for m in _LOGIN.finditer(text)]
    if "://" in text:
        found += [(m.start(), "endpoint", m.end()) for m in _ENDPOINT.finditer(text)]
    found += [(m.start(), "bare", m.end()) for m in _BARE.finditer(text) if any(map(_random, _ACCESS.split(m[0])))]
    own: dict[str, tuple[list[int], list[int]]] = {}  # per role the starts, and the furthest end so far
    for start, kind, end in strong:
        starts, reach = own.setdefault(ROLE[kind], ([], []))
        starts.append(start)
        reach.append(max(end, reach[-1]) if reach else end)

    def free(span: Span) -> bool:
        starts, reach = own.get(ROLE[span[1]], ((), ()))
        k = bisect_left(starts, span[2])
        return not k or reach[k - 1] <= span[0]

    return [s for s in found if free(s)]


def _random(token: str) -> bool:
    return len(token) >= _BARE_LENGTH and any(c.isdigit() for c in token) and any(c.isalpha() for c in token) and entropy(token) >= MIN_ENTROPY


def linked(text: str, strong: list[Span], weak: list[Span]) -> list[Span]:
    """The weak candidates with a complementary part in their scope, at most REACH characters away."""
    if not weak:
        return []
    breaks = [m.start() for m in re.finditer(r"\n[^\S\n]*\n", text)]
    scoped: dict[tuple[int, str], tuple[list[int], list[int]]] = {}  # the starts, and the furthest end so far
    for start, kind, end in sorted([*strong, *weak], key=_order):
        starts, reach = scoped.setdefault((bisect_left(breaks, start), ROLE[kind]), ([], []))
        starts.append(start)
        reach.append(max(end, reach[-1]) if reach else end)
    out = []
    for span in weak:
        start, kind, end = span
        scope = bisect_left(breaks, start)
        for role in COMPLEMENTS[ROLE[kind]]:
            starts, reach = scoped.get((scope, role), ((), ()))
            k = bisect_left(starts, start)
            if (k < len(starts) and starts[k] - end <= REACH) or (k and start - reach[k - 1] <= REACH):
                out.append(span)
                break
    return out


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """The strong findings, and all findings of a text, each in order."""
    strong = base_spans(text)
    weak = weak_spans(text, strong)
    return strong, sorted([*strong, *linked(text, strong, weak)], key=_order)


def spell(spans: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


_SPANS = "doc_id long, spans array<struct<kind:string,start:int,end:int,value:string,strong:boolean>>"


def find_secrets(docs: DataFrame) -> DataFrame:
    """All findings per document: doc_id and an array of kind, start, end, value and strong.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. Offsets count code points, the
    end is exclusive, and each whole text is scanned. A null or empty text has no findings; repeated
    rows give repeated results; no documents give no rows.
    """
    arrow = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("strong", pa.bool_())])

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for cell in batch.column(1):
                text = cell.as_py() or ""
                strong, spans = scan(text)
                known = set(strong)
                found.append([{"kind": k, "start": s, "end": e, "value": text[s:e], "strong": (s, k, e) in known} for s, k, e in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(arrow))], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SPANS)


_DIGEST = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def secret_digests(found: DataFrame) -> DataFrame:
    """Counts per strong kind, the sha256 of the strong spans, and all spans as text."""
    strong = F.filter("spans", lambda s: s["strong"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter(strong, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(strong), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


MASK = "[SECRET]"


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by a mark and ``n_chars``, if there, brought up to date.

    Overlapping findings become one mark. Texts without findings, and null texts, stay as they are;
    rows and the other columns stay, whatever they are called.
    """
    schema = docs.schema
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [masked(t.as_py()) for t in batch.column(at)]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in texts], batch.schema.field(at).type)
            if count is not None:
                columns[count] = pa.array([len(t) if changed else n.as_py() for (t, changed), n in zip(texts, columns[count], strict=True)], batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)


def masked(text: str | None) -> tuple[str | None, bool]:
    """A text with its findings replaced, and whether there were any."""
    spans = scan(text)[1] if text else []
    if not spans:
        return text, False
    out, done = [], 0
    for start, _, end in spans:
        if start >= done:
            out += [text[done:start], MASK]
        done = max(done, end)
    return "".join([*out, text[done:]]), True
