"""N-gram Jaccard join by PartEnum signatures.

Sets are put in size bands, and each band's feature domain is cut into partitions by a hash. A
signature is a set's projection on one partition. Two sets of Jaccard similarity 3/4 or more differ
in at most a third of the smaller one's size of elements (H), so they disagree in at most H
partitions. A set that is spread over more than H partitions therefore shares a non-empty projection
with every set that similar, and its first H + 1 non-empty ones suffice. (A set too concentrated for
that also emits its elements one by one; a pair of such sets meets there.) A set near the upper end
of its band also emits the signatures of the next band.

Signatures are then ranked by how many sets have them. Those that a large share of all sets have are
found on a sample of the sets and ranked by it; they are told by a small broadcast table, so no task
gathers the rows of one. (Any ranking that all sets agree on gives the same results.) Sets emit a few signatures more than
needed, and may for that drop as many of the most frequent ones and still share one with each
similar set. Sets that share no signature now have no similar set and leave, which is most of them.

For the others a second level cuts the domain into single features, where similar sets differ on one
side in a quarter of a set's features at most: of its features, rarest first, a quarter and one
suffice. So passages that many documents have in common bring hardly any candidates. Both levels
and the pairs below are exact; nothing is capped or left to chance but 64-bit hashes.

Only connected components are asked for, so a group of sets with a common feature is not expanded
into pairs. All are first compared with one leader, the one with the most in common with others, which
joins near copies at once. Where a group's members are then in several components, small histograms of
the sets bound each pair's similarity, block by block; only pairs that may be similar and are not yet
in one component go on to be compared by their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from cubeloom.llm.common import lean, stage
from cubeloom.llm.shingles import mix, set_id, shingle_set

#: Similar means 100 * intersection >= 75 * union; the bounds below rest on it.
PERCENT = 75
BAND_RATIO = 4
#: Mean elements per partition for the largest sets of a band.
LOAD = 2.2
#: Share of a set's size emitted beyond need, so that frequent signatures can be dropped.
EXTRA = 0.06
#: Histograms have so many counts; of sets too large for short counts nothing is concluded.
BUCKETS = 512
HUGE = 1 << 22
#: One set in so many (a power of two) tells which tokens are frequent: those that so large a share of the sampled sets has, and so many of them at least.
SAMPLE = 32
FREQUENT_SHARE = 1 / 2000
FREQUENT_LEAST = 8
MAX_FREQUENT = 500_000
#: Groups are compared in blocks of so many sets; a larger group is dealt out by pairs of blocks.
BLOCK = 1024
#: In the first round of block comparisons each set brings so many pairs per component and group.
FIRST_PAIRS = 2
#: More candidate documents than this are found by a shuffled join, not a broadcast of their ids.
MAX_BROADCAST_IDS = 2_000_000

_BAND_BITS = 6


def band_of(n: int) -> int:
    band = 0
    while n >= BAND_RATIO ** (band + 1):
        band += 1
    return band


def partitions_of(band: int) -> int:
    top = BAND_RATIO ** (band + 1)
    return 4 * top if top <= 64 else -(-int(top * 10) // int(LOAD * 10))


def extra(n: int) -> int:
    return int(EXTRA * n)


def parts_of_set(shingles: np.ndarray, band: int) -> np.ndarray:
    """The partition of each element; small numbers, so that they sort fast."""
    parts = partitions_of(band)
    return ((shingles >> np.uint64(8)) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)


def droppable_of(n: int, projections: int) -> int:
    """How many of the most frequent signatures a set of ``n`` elements with so many projections may drop."""
    needed = n // 3 + 1
    if projections < needed:
        return 0
    return max(0, min(projections, needed + extra(n)) - (needed + extra(n) - extra(-(-3 * n // 4))))


def band_signatures(shingles: np.ndarray, band: int) -> np.ndarray:
    """A set's signatures in a band."""
    n = len(shingles)
    part = parts_of_set(shingles, band)
    order = np.argsort(part, kind="stable")
    part, values = part[order].astype(np.uint64), mix(shingles[order] + np.uint64(band + 1))
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    sums = np.add.reduceat(values, first)
    tokens = mix(sums + mix(part[first] + np.uint64(1 + (band << 40))))
    if len(tokens) > n // 3:
        tokens = tokens[: n // 3 + 1 + extra(n)]
    else:
        tokens = np.concatenate([tokens, mix(shingles + mix(np.uint64([band + 1]) << np.uint64(48)))])
    low = np.uint64((1 << _BAND_BITS) - 1)
    return (tokens & ~low) | np.uint64(band)


def bands_of(n: int) -> list[int]:
    """The bands whose signatures a set emits: its own, and the next one if a similar set may be there.

    Sets of one or two elements are similar to equal sets only and emit none.
    """
    if n < 3:
        return []
    band = band_of(n)
    return [band] if 4 * n < 3 * BAND_RATIO ** (band + 1) else [band, band + 1]


def tokens_of(shingles: np.ndarray) -> np.ndarray:
    """All signatures of a set."""
    found = [band_signatures(shingles, band) for band in bands_of(len(shingles))]
    return np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)


def droppable(shingles: np.ndarray) -> tuple[int, int]:
    """The droppable signatures of a set's own band and of the next one, counted without making them."""
    n = len(shingles)
    counts = [droppable_of(n, np.count_nonzero(np.bincount(parts_of_set(shingles, band)))) for band in bands_of(n)]
    own, above, *_ = [*counts, 0, 0]
    return own, above


def signatures(shingles: np.ndarray) -> tuple[np.ndarray, int, int]:
    """All signatures of a set, the droppable ones of its own band and of the next one."""
    return tokens_of(shingles), *droppable(shingles)


_SETS = "doc_id long, n_shingles long, node long, drop_own int, drop_above int, sampled array<long>"


@lean
def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        rows = []
        for cell in batch.column(1):
            s = shingle_set(cell.as_py())
            node = set_id(s)
            sampled = node % SAMPLE == 0 and node not in seen and len(s) >= 3
            if sampled:
                seen.add(node)
            tokens, own, above = signatures(s) if sampled else (None, *droppable(s))
            rows.append((len(s), node, own, above, tokens))
        columns = zip(*rows, strict=True) if rows else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [c.split()[0] for c in _SETS.split(", ")])


@lean
def _tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        nodes, tokens = [], []
        for cell in batch.column(0):
            s = shingle_set(cell.as_py())
            node = set_id(s)
            if len(s) >= 3 and node not in seen:  # a copy within the task adds nothing
                if len(seen) < 1_000_000:
                    seen.add(node)
                nodes.append(node)
                tokens.append(tokens_of(s))
            if len(nodes) >= 2000:
                yield _token_batch(nodes, tokens)
                nodes, tokens = [], []
        if nodes:
            yield _token_batch(nodes, tokens)


def _token_batch(nodes: list[int], tokens: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(offsets, np.concatenate(tokens))], ["node", "tokens"])


_MEMBERS = "node long, n int, members array<long>, histogram array<short>"


def histogram(shingles: np.ndarray) -> np.ndarray:
    """Counts of a set by bucket: the sum of two sets' lesser counts bounds their intersection."""
    return np.bincount((shingles >> np.uint64(40)).astype(np.int64) % BUCKETS, minlength=BUCKETS).clip(0, 32767).astype(np.int16)


@lean
def _members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(c.as_py()) for c in batch.column(0)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([set_id(s) for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int32()),
                pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                pa.array([histogram(s) for s in sets], pa.list_(pa.int16())),
            ],
            ["node", "n", "members", "histogram"],
        )


def frequent(sampled: DataFrame) -> DataFrame:
    """(token, n): the frequent tokens among the rows (node, token) of sampled sets, with a rank above all others'.

    There are MAX_FREQUENT at most, so the table may be broadcast; a token that is left out is only
    counted like all others.
    """
    rows = stage(sampled.distinct(), "sampled")
    n = rows.select(F.count_distinct("node")).first()[0]
    least = max(FREQUENT_LEAST, int(n * FREQUENT_SHARE))
    found = rows.groupBy("token").count().filter(F.col("count") >= least).orderBy(F.desc("count"), "token").limit(MAX_FREQUENT)
    return stage(found.select("token", (F.col("count") + (1 << 40)).alias("n")), "frequent")


def shared(rows: DataFrame, often: DataFrame) -> DataFrame:
    """Of rows (node, token) those whose token some other node has too, with the token's frequency.

    Those with a frequent token stay as they are: two sets of the sample had it at least.
    """
    marked = rows.select("node", "token").join(F.broadcast(often.withColumnRenamed("n", "rank")), "token", "left")
    # Rows of frequent tokens are dealt by their node, each a window of its own.
    own = Window.partitionBy("token", F.when(F.col("rank").isNotNull(), F.col("node")))
    counted = marked.select("node", "token", "rank", F.count("*").over(own).alias("count"), F.min("node").over(own).alias("least"), F.max("node").over(own).alias("most"))
    return counted.filter("least < most or rank is not null").select("node", "token", F.coalesce("rank", "count").alias("n"))


def without_frequent(found: DataFrame, *by: str) -> DataFrame:
    """Leave out each node's ``droppable`` most frequent tokens; its list is as long as its set at most."""
    lists = found.groupBy(*by, "droppable").agg(F.sort_array(F.collect_set(F.struct("n", "token"))).alias("found"))
    kept = lists.filter("size(found) > droppable").withColumn("f", F.explode(F.expr("slice(found, 1, size(found) - droppable)")))
    return kept.select("node", F.col("f.token").alias("token"))


def candidates(docs: DataFrame, nodes: DataFrame, often: DataFrame) -> DataFrame:
    """The nodes that share a signature with another, without the droppable ones: first level."""
    rows = docs.select("text").mapInArrow(_tokens, "node long, tokens array<long>").select("node", F.explode("tokens").alias("token"))
    found = shared(rows, often).withColumn("band", F.col("token").bitwiseAND((1 << _BAND_BITS) - 1))
    info = nodes.select("node", "n_shingles", "drop_own", "drop_above")
    droppable = F.when(F.expr(f"pow({BAND_RATIO}, band) > n_shingles"), F.col("drop_above")).otherwise(F.col("drop_own"))
    kept = without_frequent(found.join(info, "node").withColumn("droppable", droppable), "node", "band")
    # What is left may have lost its counterpart, which dropped it.
    return shared(kept, often).select("node").distinct()


def refine(members: DataFrame) -> DataFrame:
    """(token, node, n, common): features that sets have in common, the rarest that are needed: second level.

    ``common`` is the share of the set's features that other sets have too.
    """
    sizes = members.select("node", F.col("n").alias("size"), (F.col("n") - F.floor(F.col("n") / 4) - 1).cast("int").alias("droppable"))
    rows = members.select("node", F.explode("members").alias("token"))
    often = frequent(members.filter(f"node % {SAMPLE} = 0").select("node", F.explode("members").alias("token")))
    found = shared(rows, often).join(sizes, "node")
    met = shared(without_frequent(found, "node"), often).select("node", "token")
    info = found.groupBy("node", "size").agg((F.count("*") / F.col("size")).alias("common"))
    return met.join(info, "node").select("token", "node", F.col("size").alias("n"), "common")


def verified(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar: those that histograms allow, by their whole sets."""
    light = members.select("node", "n", "histogram")

    def side(name: str) -> DataFrame:
        return light.select(F.col("node").alias(name), F.col("n").alias(f"n{name}"), F.col("histogram").alias(f"h{name}"))

    bound = F.expr("aggregate(zip_with(ha, hb, (x, y) -> least(x, y)), 0, (s, x) -> s + int(x))")
    likely = pairs.join(side("b"), "b").join(side("a"), "a").withColumn("most", bound).filter(f"100 * most >= {PERCENT} * (na + nb - most) or na >= {HUGE}").select("a", "b", "na", "nb")
    likely = stage(likely, "likely")
    a = members.select(F.col("node").alias("a"), F.col("members").alias("of_a"))
    b = members.select(F.col("node").alias("b"), F.col("members").alias("of_b"))
    both = likely.join(b, "b").join(a, "a").withColumn("shared", F.size(F.array_intersect("of_a", "of_b")))
    return both.filter(f"100 * shared >= {PERCENT} * (na + nb - shared)").select("a", "b")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the least node of each node's component, by least labels and pointer jumping."""
    edges = stage(links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct(), "edges")
    labels = stage(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.col("node"), F.min("y")).alias("label")), "labels")
    while True:
        heard = edges.join(labels, edges.y == labels.node).groupBy(F.col("x").alias("node")).agg(F.min("label").alias("heard"))
        near = labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("near"))
        up = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        new = stage(near.join(up, "near").select("node", F.least("near", "far").alias("label"), F.col("label").alias("old")), "labels")
        if not new.filter("label <> old").limit(1).count():
            return labels
        labels = new.select("node", "label")


@lean
def _block_pairs(batches: Iterable[pa.RecordBatch], per_component: int | None) -> Iterator[pa.RecordBatch]:
    """Rows come by (token, left, right), in order: the members of a block or of two blocks of a group.

    Yields the pairs of different components whose sizes and histograms allow them to be similar; with
    ``per_component`` only the likeliest for each set and component of the other side.
    """
    key, rows = None, []
    found: list[tuple[int, int]] = []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(7)]
        histograms = batch.column(7).flatten().to_numpy().reshape(-1, BUCKETS)
        for i, (token, left, right, block, node, n, label) in enumerate(zip(*columns, strict=True)):
            if (token, left, right) != key:
                found += _compare(key, rows, per_component)
                key, rows = (token, left, right), []
            rows.append((block, node, n, label, histograms[i]))
        if len(found) >= 10_000:
            yield _pair_batch(found)
            found = []
    found += _compare(key, rows, per_component)
    if found:
        yield _pair_batch(found)


def _pair_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*dict.fromkeys(found), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _compare(key: tuple[int, int, int] | None, rows: list[tuple], per_component: int | None) -> list[tuple[int, int]]:
    """At most two blocks of rows; those of one block among themselves, of two across."""
    if key is None or len({r[3] for r in rows}) < 2:
        return []
    _, left, right = key
    xs = [r for r in rows if r[0] == left]
    ys = xs if left == right else [r for r in rows if r[0] == right]
    nodes, size, label = (np.array([r[i] for r in ys], np.int64) for i in (1, 2, 3))
    bags = np.array([r[4] for r in ys], np.int16).reshape(-1, BUCKETS)
    out = []
    for k, (_, node, n, own, bag) in enumerate(xs):
        rest = slice(k + 1, None) if left == right else slice(None)
        other = (label[rest] != own) & (4 * np.minimum(size[rest], n) >= 3 * np.maximum(size[rest], n))
        at = np.flatnonzero(other)
        if not len(at):
            continue
        most = np.minimum(bags[rest][at], bag).sum(axis=1, dtype=np.int64)
        union = n + size[rest][at] - most
        likely = (100 * most >= PERCENT * union) | (n >= HUGE)
        at, ratio = at[likely], (most / np.maximum(union, 1))[likely]
        if per_component is not None and len(at) > per_component:
            order = np.lexsort((-ratio, label[rest][at]))
            run = label[rest][at][order]
            first = np.concatenate([[0], np.flatnonzero(run[1:] != run[:-1]) + 1])
            place = np.arange(len(run)) - np.repeat(first, np.diff(np.append(first, len(run))))
            at = at[order[place < per_component]]
        out += [(min(node, int(x)), max(node, int(x))) for x in nodes[rest][at]]
    return out


def block_pairs(rows: DataFrame, members: DataFrame, per_component: int | None) -> DataFrame:
    """Likely pairs (a, b) of different components within groups, from rows (token, node, n, label)."""

    def run(batches):
        return _block_pairs(batches, per_component)

    # A group's rows are dealt to blocks by a hash; each block meets each other once, and itself.
    sizes = stage(rows.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1"), "blocks")
    sizes = F.broadcast(sizes) if sizes.count() <= MAX_BROADCAST_IDS else sizes
    dealt = rows.join(sizes, "token", "left").fillna(1, ["blocks"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("left"), F.greatest("block", o).alias("right")))
    spread = dealt.withColumn("meets", F.explode(others)).select("token", "meets.left", "meets.right", "block", "node", "n", "label")
    full = spread.join(members.select("node", "histogram"), "node").select("token", "left", "right", "block", "node", "n", "label", "histogram")
    return full.repartition("token", "left", "right").sortWithinPartitions("token", "left", "right", "node").mapInArrow(run, "a long, b long").distinct()


def link_components(groups: DataFrame, members: DataFrame) -> DataFrame:
    """(node, label) for the nodes that are linked with another, from (token, node, n, common) groups."""
    leader = groups.groupBy("token").agg(F.max(F.struct("common", "node", "n")).alias("lead"))
    met = groups.join(leader, "token").select(F.col("lead.node").alias("x"), F.col("node").alias("y"), F.col("lead.n").alias("nx"), F.col("n").alias("ny"))
    near = met.filter("x <> y and 4 * least(nx, ny) >= 3 * greatest(nx, ny)")
    # The leader stays first: the pairs of one leader need its set once.
    pairs = near.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    links = stage(verified(pairs, members), "links")
    labels = components(links)
    for per_component in (FIRST_PAIRS, None):
        known = groups.join(labels, "node", "left").select("token", "node", "n", F.coalesce("label", "node").alias("label"))
        open_tokens = known.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most").select("token")
        rows = stage(known.join(open_tokens, "token"), "open")
        found = stage(verified(block_pairs(rows, members, per_component), members), "links")
        if not found.limit(1).count():
            if per_component is None:
                break
            continue
        links = stage(links.union(found), "links")
        labels = components(links)
    return labels


def join_documents(docs: DataFrame) -> DataFrame:
    """Per document its set's size and the smallest doc_id that links reach from it.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. Null, empty and wordless texts
    have the empty set, are linked with nothing and are their own component. Documents with equal
    sets are linked, so are those exactly at the threshold. Whole texts count, however long. Rows with
    the same doc_id are documents of their own; a row without doc_id never names a component, unless
    nothing else is in it (then null). No documents: no rows.

    Joins on a token, a label or a node with very many rows rest on Spark's own splitting of skewed
    joins (``spark.sql.adaptive.skewJoin``); nothing else gathers such rows in one task.
    """
    return _joined(docs)[0]


def _joined(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The join's result, and (node, label, component_id) of every set that is not empty."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = stage(docs.mapInArrow(_sets, _SETS), "sets")
    nodes = sets.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least_doc"), F.max("n_shingles").alias("n_shingles"), F.max("drop_own").alias("drop_own"), F.max("drop_above").alias("drop_above"))
    nodes = stage(nodes, "nodes")
    often = frequent(sets.filter("sampled is not null").select("node", F.explode("sampled").alias("token")))
    wanted = stage(candidates(docs, nodes, often).join(nodes.select("node", "least_doc"), "node"), "wanted")
    ids = wanted.select(F.col("least_doc").alias("doc_id"))
    ids = F.broadcast(ids) if wanted.count() <= MAX_BROADCAST_IDS else ids
    texts = docs.join(ids, "doc_id", "left_semi").select("text").union(docs.filter("doc_id is null").select("text"))
    members = texts.mapInArrow(_members, _MEMBERS).join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])
    members = stage(members, "members")
    labels = link_components(stage(refine(members), "groups"), members)
    named = nodes.join(labels, "node", "left").select("node", "least_doc", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("least_doc").alias("component_id"))
    of_node = stage(named.join(least, "label").select("node", "label", "component_id"), "named")
    full = sets.filter("n_shingles > 0").join(of_node, "node").select("doc_id", "n_shingles", "component_id")
    return full.unionByName(sets.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))), of_node


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component: the one with the smallest doc_id, with all its columns.

    Documents without words stay, all of them. Of rows that share that doc_id within the component, copies
    included, the one whose columns have the least hash stays. A row without doc_id stays only if
    its component has no doc_id at all. Other columns are kept, whatever their names.
    """
    found, of_node = _joined(docs)
    found = stage(found, "joined")
    named = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # A doc_id that is there once is its component's only row of that name.
    counted = stage(found.groupBy("doc_id").agg(F.count("*").alias("n")).join(named.select(F.col("doc_id").alias("name")).distinct(), F.col("doc_id").eqNullSafe(F.col("name")), "left_semi"), "kept")

    def having(condition: str) -> DataFrame:
        own = counted.filter(condition).select(F.col("doc_id").alias("kept_id"))
        return docs.join(own, F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")), "left_semi")

    single = having("n = 1")
    if not counted.filter("n > 1").limit(1).count():
        return single
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    several = having("n > 1").select(F.col("doc_id").cast("long").alias("doc_id"), "text", whole.alias("row"))
    rows = several.mapInArrow(_with_node, StructType([*several.schema, StructField("node", LongType()), StructField("words", BooleanType())]))
    met = rows.filter("words").join(of_node, "node").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = met.groupBy("label").agg(F.min_by("row", F.struct(F.xxhash64("row"), F.col("row").cast("string"))).alias("row"))
    return single.unionByName(first.select("row.*")).unionByName(rows.filter("not words").select("row.*"))


@lean
def _with_node(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(c.as_py()) for c in batch.column(1)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) > 0 for s in sets], pa.bool_())], names=[*batch.schema.names, "node", "words"])


#: The same join in DuckDB's SQL: all pairs with a common shingle, then everything reachable over links.
ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * shared >= 75 * (a.n + b.n - shared)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT reach.doc_id, edges.y FROM reach JOIN edges ON edges.x = reach.other
)
SELECT reach.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN sizes ON sizes.doc_id = reach.doc_id GROUP BY reach.doc_id
"""
