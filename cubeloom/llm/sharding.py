"""Sharding by histogram sort.

Documents are put in the order of a 62-bit key (a hash of the text, then one of the doc_id, so equal
texts lie together) and cut into shards of nearly equal bytes. The cuts are found without sorting:
in each round all tasks count the exact rows and bytes below a set of candidate keys, and new
candidates are placed in the gaps that still hold a cut or too many rows. When every cut is within
tolerance, one exchange moves the documents. The counts below the candidates also give each gap's
first place within its shard, so places are gapless without a sort of a whole shard in one task.

Groups of equal texts stay whole. A large one would often lie across a cut, so large groups are dealt
to shards first, the largest to the emptiest; their keys move behind all others, and the cuts of the
rest make up the difference. Only a group that fits in no shard is cut like single documents.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cubeloom.llm.common import stage

SHARDS = 8
#: A cut may miss its goal by this share of a shard's bytes, or by what keeps equal texts together ...
TOLERANCE = 0.002
#: ... if they are not more than this share of a shard. Larger groups are dealt out whole, a few hundred at most.
GROUP_SLACK = 0.01
#: Candidate keys of the first round, and per open gap later.
FIRST_PROBES = 1024
PROBES_PER_GAP = 16
MAX_ROUNDS = 24
#: There are so many gaps at most, as each costs the driver and a broadcast table one row.
MAX_GAPS = 1_000_000
TEXT_BITS, DOC_BITS = 38, 24
KEY_END = 1 << (TEXT_BITS + DOC_BITS)


def shard_key():
    """Hash of the text in the high bits, hash of the doc_id in the low ones; never negative."""
    high = F.shiftrightunsigned(F.xxhash64(F.col("text").cast("string")), 64 - TEXT_BITS)
    low = F.shiftrightunsigned(F.xxhash64(F.lit(7), F.col("doc_id").cast("string")), 64 - DOC_BITS)
    return F.shiftleft(high, DOC_BITS).bitwiseOR(low)


def row_size():
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1


def count_gaps(keys: DataFrame, probes: list[int]) -> list[tuple[int, int]]:
    """Exact (rows, bytes) of each gap between candidate keys; len(probes) + 1 numbers come to the driver."""
    edges = np.array(probes, np.int64)

    def run(batches):
        rows, size = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for batch in batches:
            gap = np.searchsorted(edges, batch.column(0).to_numpy(), side="right")
            rows += np.bincount(gap, minlength=len(rows))
            np.add.at(size, gap, batch.column(1).to_numpy())
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_pydict({"gap": pa.array(some, pa.int32()), "n": pa.array(rows[some]), "size": pa.array(size[some])})

    counted = keys.select("key", "size").mapInArrow(run, "gap int, n long, size long").groupBy("gap").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    out = [(0, 0)] * (len(probes) + 1)
    for r in counted.collect():
        out[r.gap] = (r.n, r.size)
    return out


class Histogram:
    """Candidate keys with the exact rows and bytes below each; refined until every cut is near enough.

    ``goals`` are the bytes that should lie below each cut; keys from KEY_END on belong to moved groups.
    """

    def __init__(self, keys: DataFrame, goals: list[float], n_moved: int, allowed: float, large: float, rows_per_gap: int):
        self.keys, self.goals, self.allowed, self.large, self.rows_per_gap = keys, goals, allowed, large, rows_per_gap
        self.end = KEY_END + (n_moved << DOC_BITS)
        self.probes = [KEY_END * i // FIRST_PROBES for i in range(1, FIRST_PROBES)] + [KEY_END + (i << DOC_BITS) for i in range(n_moved)]
        self.rounds = 0
        self._count()
        while self.rounds < MAX_ROUNDS and (more := self._wanted()):
            self.probes = sorted({*self.probes, *more})
            self._count()

    def _count(self) -> None:
        self.gaps = count_gaps(self.keys, self.probes)
        sums = np.cumsum([(0, 0), *self.gaps], axis=0)
        self.bytes_below = sums[:-1, 1].tolist()  # below each gap
        self.edges = [0, *self.probes]  # first key of each gap
        self.n_regular = bisect_left(self.edges, KEY_END)
        within: dict[int, int] = {}
        for edge, (_, size), following in zip(self.edges, self.gaps, [*self.edges[1:], self.end], strict=True):
            if following - edge < 1 << DOC_BITS:  # part of one text's keys
                within[edge >> DOC_BITS] = within.get(edge >> DOC_BITS, 0) + size
        self.within = within
        self.rounds += 1

    def _near(self, goal: float) -> list[int]:
        """The gaps before and after a goal that a shard may begin with.

        That is a gap that begins with a text's first key, or one inside a group that is too large to stay whole.
        """

        def may(j: int) -> bool:
            edge = self.edges[j]
            return edge % (1 << DOC_BITS) == 0 or self.within.get(edge >> DOC_BITS, 0) > self.large

        k = bisect_left(self.bytes_below, goal, 0, self.n_regular)
        before = next((j for j in range(k - 1, -1, -1) if may(j)), None)
        after = next((j for j in range(k, self.n_regular) if may(j)), None)
        return [j for j in (before, after) if j is not None]

    def _best(self, goal: float) -> int:
        return min(self._near(goal), key=lambda j: abs(self.bytes_below[j] - goal))

    def _wanted(self) -> set[int]:
        """New candidates inside the gaps with a cut that is too far off, or with too many rows."""
        open_gaps = {g for g, (n, _) in enumerate(self.gaps) if n > self.rows_per_gap}
        for goal in self.goals:
            if abs(self.bytes_below[self._best(goal)] - goal) > self.allowed:
                open_gaps.add(max(0, bisect_left(self.bytes_below, goal, 0, self.n_regular) - 1))
        more = set()
        for gap in open_gaps:
            low, high = self.edges[gap], self.edges[gap + 1] if gap + 1 < len(self.edges) else self.end
            width = high - low
            inside = {low + width * i // (PROBES_PER_GAP + 1) for i in range(1, PROBES_PER_GAP + 1)}
            if width > 1 << DOC_BITS:  # between texts; inside one only once it is alone in its gap
                inside = {p >> DOC_BITS << DOC_BITS for p in inside} | {(p >> DOC_BITS) + 1 << DOC_BITS for p in inside}
            elif self.gaps[gap][1] <= self.large and self.gaps[gap][0] <= self.rows_per_gap:
                continue
            more |= {p for p in inside if low < p < high}
        return more - set(self.probes)

    def cuts(self) -> list[int]:
        """The first gap of each shard but the first."""
        out: list[int] = []
        for goal in self.goals:
            out.append(max(self._best(goal), out[-1] if out else 0))
        return out


def deal_groups(sizes: list[int], n_bytes: int, shards: int) -> tuple[list[int | None], list[int]]:
    """A shard for each large group, the largest first to the emptiest; None where it fits in none."""
    load, out = [0] * shards, [None] * len(sizes)
    room = n_bytes / shards * (1 + TOLERANCE)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        least = min(range(shards), key=lambda s: load[s])
        if load[least] + sizes[i] <= room:
            out[i] = least
            load[least] += sizes[i]
    return out, load


def shard_documents(docs: DataFrame, shards: int = SHARDS, rows_per_gap: int | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with ``shard`` and ``slot`` (gapless from 0 within a shard).

    ``docs`` needs ``doc_id`` and ``text``. A row's size is its text's UTF-8 bytes plus 1; a null text
    has none, and null texts count as equal. Shards get nearly equal bytes: a cut is off by at most
    ``TOLERANCE`` of a shard, or by one document or group of equal texts of up to ``GROUP_SLACK`` of a
    shard. Equal texts share a shard unless together they fit in none. Repeated rows (same text and
    doc_id) share a key and stay together. Texts are not looked into, so a long one counts by its bytes
    only; one larger than a shard has a shard to itself. Fewer rows than shards leave shards empty; no rows give no
    rows. Columns named ``shard`` or ``slot`` are replaced, as are those that begin with ``shard_``.
    """
    docs = docs.drop("shard", "slot", "shard_key", "shard_gap", "shard_base", "shard_part", "shard_before")
    columns = docs.columns
    keys = stage(docs.select(shard_key().alias("key"), row_size().alias("size")), "keys")
    n_rows, n_bytes = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    rows_per_gap = rows_per_gap or max(min(max(1000, n_rows // 512), 200_000), 4 * n_rows // MAX_GAPS)
    target = n_bytes / shards
    # At most shards / GROUP_SLACK groups are that large.
    large = keys.groupBy(F.shiftright("key", DOC_BITS).alias("text")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).filter(F.col("size") > GROUP_SLACK * target).filter("n > 1").orderBy("text").collect()
    dealt, load = deal_groups([r["size"] for r in large], n_bytes, shards)
    moved = [(r.text, shard) for r, shard in zip(large, dealt, strict=True) if shard is not None]
    texts = np.array([t for t, _ in moved], np.int64)
    goals = np.cumsum([max(0.0, target - x) for x in load])[:-1].tolist()
    found = Histogram(moved_keys(keys, texts), goals, len(moved), TOLERANCE * target, GROUP_SLACK * target, rows_per_gap)
    shard_of = np.searchsorted(np.array(found.cuts(), np.int64), np.arange(found.n_regular), side="right").tolist()
    shard_of += [moved[(edge - KEY_END) >> DOC_BITS][1] for edge in found.edges[found.n_regular :]]
    places, filled = [], [0] * shards
    for gap, (shard, (n, _)) in enumerate(zip(shard_of, found.gaps, strict=True)):
        places.append((gap, int(shard), filled[shard]))
        filled[shard] += n
    # One row per candidate key: a few thousand, or one for about 100,000 rows of input.
    gaps = docs.sparkSession.createDataFrame(places, "shard_gap int, shard int, shard_base long")
    keyed = docs.withColumn("shard_key", shard_key()).withColumn("shard_gap", gap_of(F.col("shard_key"), found.edges, texts))
    # What could not be cut further, rows of one text and doc_id, lies in the order of its input's partitions.
    whole = [gap for gap, (n, _) in enumerate(found.gaps) if n > 4 * rows_per_gap]
    keyed = keyed.withColumn("shard_part", F.when(F.col("shard_gap").isin(whole), F.spark_partition_id()).otherwise(0))
    placed = keyed.withColumn("slot", F.row_number().over(Window.partitionBy("shard_gap", "shard_part").orderBy("shard_key", "doc_id", "text")))
    out = placed.join(F.broadcast(gaps), "shard_gap")
    if whole:
        sizes = keyed.filter(F.col("shard_gap").isin(whole)).groupBy("shard_gap", "shard_part").agg(F.count("*").alias("n"))
        before = Window.partitionBy("shard_gap").orderBy("shard_part").rowsBetween(Window.unboundedPreceding, -1)
        parts = stage(sizes.select("shard_gap", "shard_part", F.sum("n").over(before).alias("shard_before")), "parts")  # one row a partition and such gap
        out = out.join(F.broadcast(parts) if parts.count() <= MAX_GAPS else parts, ["shard_gap", "shard_part"], "left")
    else:
        out = out.withColumn("shard_before", F.lit(0))
    return out.select(*columns, "shard", (F.col("slot") - 1 + F.col("shard_base") + F.coalesce("shard_before", F.lit(0))).alias("slot"))


def move(keys: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Keys of moved groups (``texts``, ascending) behind all others, in that order."""
    if not len(texts):
        return keys
    text = keys >> DOC_BITS
    rank = np.searchsorted(texts, text).clip(0, len(texts) - 1)
    return np.where(texts[rank] == text, KEY_END + (rank << DOC_BITS) + (keys & ((1 << DOC_BITS) - 1)), keys)


def moved_keys(keys: DataFrame, texts: np.ndarray) -> DataFrame:
    if not len(texts):
        return keys

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(move(batch.column(0).to_numpy(), texts)), batch.column(1)], ["key", "size"])

    return stage(keys.mapInArrow(run, "key long, size long"), "moved")


def gap_of(key, edges: list[int], texts: np.ndarray):
    """The last edge at or below the key, moved if its group is."""
    ends = np.array(edges, np.int64)

    @F.pandas_udf("int")
    def find(keys):
        import pandas as pd

        return pd.Series(np.searchsorted(ends, move(keys.to_numpy(), texts), side="right") - 1)

    return find(key)
