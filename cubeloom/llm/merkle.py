"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

A text is cut into paragraphs at newlines and into sections at blank lines, and where a section has
no blank line at paragraphs whose hash says so, so sections are found again after an edit. Leaves
are sentences; a long one is cut every ``LEAF_CHARS`` characters. Each node's hash covers its
children's, the root covers every character. Equal roots mean equal texts; where roots differ, equal
branches are skipped and the differing leaves locate the edit.

Hashes are xxh3 of 128 bits: they find equal texts and edits, they are no defence against forgery.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import lean

LEAF_CHARS = 128
#: One paragraph in so many ends a section.
SECTION_PARAGRAPHS = 8
#: Ranges of doc_id that a task works on; each costs the driver one number.
ROWS_PER_RANGE = 4096
MAX_RANGES = 100_000

_SENTENCE = re.compile(r"[^.!?]*(?:[.!?]+\s*|$)")


@dataclass(frozen=True, slots=True)
class Leaf:
    start: int
    end: int
    hash: bytes


@dataclass(frozen=True, slots=True)
class Node:
    hash: bytes
    children: tuple
    size: int  # characters in its leaves


def _digest(data: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(data)


def _parent(level: bytes, children: list) -> Node:
    return Node(_digest(level + b"".join(c.hash for c in children)), tuple(children), sum(map(n_chars, children)))


def leaves(line: str, start: int) -> list[Leaf]:
    """The leaves of one paragraph with its newline; at least one."""
    out = []
    for m in _SENTENCE.finditer(line):
        for at in range(m.start(), m.end(), LEAF_CHARS):
            end = min(at + LEAF_CHARS, m.end())
            out.append(Leaf(start + at, start + end, _digest(line[at:end].encode("utf-8", "surrogatepass"))))
    return out or [Leaf(start, start, _digest(b""))]


def tree(text: str) -> Node:
    """The Merkle tree of a whole text: root, sections, paragraphs, leaves."""
    sections, section, at = [], [], 0
    for line in text.split("\n"):
        paragraph = _parent(b"p", leaves(line, at))
        section.append(paragraph)
        at += len(line) + 1
        if not line.strip() or paragraph.hash[0] % SECTION_PARAGRAPHS == 0:
            sections.append(_parent(b"s", section))
            section = []
    if section:
        sections.append(_parent(b"s", section))
    return _parent(b"r", sections)


def all_leaves(node) -> Iterator[Leaf]:
    if isinstance(node, Leaf):
        yield node
    else:
        for child in node.children:
            yield from all_leaves(child)


def n_chars(node) -> int:
    """Characters in a node's leaves; an empty leaf counts as one."""
    return max(1, node.end - node.start) if isinstance(node, Leaf) else node.size


def descend(a: list, b: list) -> tuple[int, list[Leaf]]:
    """Two levels of two trees from the top: the characters in branches that both have, and the leaves of ``a`` in none.

    Equal branches are paired off, each with one, and not looked into; the children of the others are
    the next level. So all equal leaves are paired in the end, whatever branch they moved to.
    """
    shared, left = 0, []
    while a:
        theirs = Counter(node.hash for node in b)
        rest = []
        for node in a:
            if theirs[node.hash]:
                theirs[node.hash] -= 1
                shared += n_chars(node)
            else:
                rest.append(node)
        if not rest or isinstance(rest[0], Leaf):
            left = rest
            break
        other = []
        for node in b:
            if theirs[node.hash]:
                theirs[node.hash] -= 1
                other.append(node)
        a, b = [c for node in rest for c in node.children], [c for node in other for c in node.children]
    return shared, left


def compare(a: Node, b: Node) -> tuple[float, list[Leaf]]:
    """Likeness, and the leaves of ``a`` that are not in ``b``.

    Likeness is twice the characters in branches that both have over the characters of both: 1 for
    equal fingerprints, 0 where no leaf is the same.
    """
    shared, left = descend([a], [b])
    return 2 * shared / (a.size + b.size), left


def differing(a: Node, b: Node) -> list[tuple[int, int]]:
    """Character ranges of ``a`` whose leaves are not in ``b``; leaves side by side make one range."""
    return ranges(compare(a, b)[1])


def ranges(left: list[Leaf]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for leaf in left:
        if out and out[-1][1] >= leaf.start - 1:  # a newline at most between
            out[-1] = (out[-1][0], leaf.end)
        else:
            out.append((leaf.start, leaf.end))
    return out


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many first characters of the next one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_ROWS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edits string"

#: Below every hash: the place of rows whose doc_id is in one range alone.
LEAST = -(1 << 63)


@lean
def _neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, in order, each range's look-ahead last. One document is held back."""
    names = [c.split()[0] for c in _ROWS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
    held = None  # range, doc_id, text, tree
    for batch in batches:
        rows = []
        for span, ahead, doc_id, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if held is not None and span != held[0]:
                held = None
            if ahead and held is None:
                continue  # more than one look-ahead row with the same doc_id
            text = cell.as_py()
            root = tree(text)
            if held is not None:
                _, before_id, before, before_root = held
                other = edited(before, text)
                other_root = tree(other)
                near, left = compare(other_root, before_root)
                beside, _ = compare(root, before_root)
                sha = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
                edits = ",".join(f"{a}:{b}" for a, b in ranges(left))
                rows.append((before_id, len(before), sha, before_root.hash.hex(), other_root.hash.hex(), near, beside, edits))
            held = None if ahead else (span, doc_id, text, root)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def range_starts(rows: DataFrame) -> list[tuple[int, int]]:
    """Ascending (id, hash) of rows of the table that begin ranges of about ROWS_PER_RANGE rows.

    A range begins with all rows of an id (the hash is then LEAST); an id with so many rows that
    it fills ranges alone is cut by the hash of the text.
    """
    n = rows.count()
    parts = min(MAX_RANGES, max(1, n // ROWS_PER_RANGE), n)
    if not parts:
        return []
    found = rows.agg(F.min("id").alias("least"), F.percentile_approx("id", [i / parts for i in range(1, parts)] or [0.5], 10 * parts).alias("q")).first()
    often = Counter([found.least, *(found.q if parts > 1 else [])])
    split = {i: k for i, k in often.items() if k > 2}
    if not split:
        return [(i, LEAST) for i in sorted(often)]
    # Where an id is cut, ranges begin with the first row that is there.
    starts = sorted([(i, LEAST) for i in often] + [(i, LEAST + (k << 64) // n) for i, n in split.items() for k in range(1, n)])
    hot = F.col("id").isin(list(split))
    firsts = rows.filter(hot).select(_span(starts, set(split))("id", "h").alias("span"), "id", "h").groupBy("span", "id").agg(F.min("h").alias("h")).collect()  # one row a range
    return sorted([(i, LEAST) for i in often if i not in split] + [(r.id, r.h) for r in firsts])


def _span(starts: list[tuple[int, int]], split: set[int]):
    @F.pandas_udf("int")
    def of(ids, hashes):
        import pandas as pd

        return pd.Series([bisect_right(starts, (i, h if i in split else LEAST)) - 1 for i, h in zip(ids.tolist(), hashes.tolist(), strict=True)], dtype="int32")

    return of


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and how alike they and the next one's are.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read, whatever their names. The
    edited text is the text with its last floor(n / 4) code points replaced by the first as many of the
    next document in ascending doc_id order; the last one's next is the first, a single document's is
    itself. ``edits`` has the character ranges of the edited text that the trees locate as new. A null
    text is empty, a long one makes a tree as deep as any. Rows with the same doc_id follow one another in
    text order (by the text's hash where one doc_id has thousands of rows), rows without one come first.
    Two empty texts are alike. No documents: no rows.

    The texts are exchanged once, by ranges of doc_id. Only the first row of each range is sent
    twice, as the look-ahead of the range before.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    starts = range_starts(rows)
    split = {i for i, h in starts if h != LEAST}
    last = max(0, len(starts) - 1)

    @F.pandas_udf("array<struct<span:int,ahead:boolean>>")
    def places(ids, hashes):
        import pandas as pd

        def of(i, h):
            key = (i, h if i in split else LEAST)
            k = bisect_right(starts, key) - 1
            own = {"span": k, "ahead": False}
            # The first row of a range looks ahead for the range before; the very first for the last one.
            return [own, {"span": k - 1 if k else last, "ahead": True}] if starts[k] == key else [own]

        return pd.Series([of(i, h) for i, h in zip(ids.tolist(), hashes.tolist(), strict=True)], dtype=object)

    both = rows.withColumn("at", F.explode(places("id", "h")))
    order = F.when(F.col("id").isin(list(split)), F.col("h")).otherwise(F.lit(0)) if split else F.lit(0)
    dealt = both.select("at.span", "at.ahead", "id", "text", order.alias("h")).repartition("span").sortWithinPartitions("span", "ahead", "id", "h", "text")
    out = dealt.select("span", "ahead", "id", "text").mapInArrow(_neighbours, _ROWS)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(LEAST)))
