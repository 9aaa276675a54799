"""Mixing, sharding, the similarity join and the pipeline against plain code."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cubeloom.llm import mixing, partenum, secrets, sharding
from cubeloom.llm.shingles import shingle_set

# -- mixing


def plain_count(doc_id, rate):
    u = int(hashlib.md5(f"{mixing.SEED}|{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    n, total = 0, math.exp(-rate)
    p = total
    while total <= u and n < 1000:
        n += 1
        p *= rate / n
        total += p
    return n


@pytest.mark.parametrize("which", ["hard", "clashing", "real"])
@pytest.mark.parametrize("broadcast", [True, False])
def test_counts_follow_the_inverse_distribution(request, which, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    docs = request.getfixturevalue(which)
    rows = docs.select("doc_id", "text", "source").collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len((r.text or "").encode()) + 1
    goal = {s: n**mixing.TEMPERATURE for s, n in sizes.items()}
    rate = {s: goal[s] / sum(goal.values()) * sum(sizes.values()) / n for s, n in sizes.items()}
    want = Counter()
    for r in rows:
        want[r.doc_id, r.source] += plain_count(r.doc_id, rate[r.source])
    mixed = mixing.mix_sources(docs)
    got = Counter((r.doc_id, r.source) for r in mixed.collect())
    assert got == Counter({k: n for k, n in want.items() if n})
    assert set(docs.columns) <= set(mixed.columns)


def test_target_weights_are_met(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x" * 9).alias("text"), F.when(F.col("id") % 10 < 8, "big").otherwise("small").alias("source"))
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0), ("other", 2.0)], "source string, weight double")
    got = {r.source: r["count"] for r in mixing.mix_sources(docs, weights).groupBy("source").count().collect()}
    assert abs(got["big"] - 3000) < 200 and abs(got["small"] - 3000) < 200
    order = [r.doc_id for r in mixing.mix_sources(docs, weights).collect()]
    assert abs(np.corrcoef(np.arange(len(order)), order)[0, 1]) < 0.1


def test_mixing_nothing(empty, spark):
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mix_sources(spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string"), spark.createDataFrame([], "source string, weight double")).count() == 0


@pytest.mark.parametrize("rate", [0.01, 1.0, 7.5, 300.0, 5000.0])
def test_poisson_distribution(rate):
    least, cdf = mixing.poisson_cdf(rate)
    mean = least + sum(1 - p for p in cdf)  # E X = sum of P(X > k)
    assert abs(mean - rate) < 1e-6 * max(1, rate) and (np.diff(cdf) >= 0).all()


# -- sharding


@pytest.mark.parametrize("which", ["hard", "clashing", "real"])
@pytest.mark.parametrize("gap", [None, 2])
def test_shards_are_even_gapless_and_ordered(request, which, gap):
    docs = request.getfixturevalue(which)
    out = sharding.shard_documents(docs, rows_per_gap=gap)
    rows = out.withColumn("k", sharding.shard_key()).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert set(docs.columns) | {"shard", "slot"} == set(out.columns)
    size = lambda r: len((r.text or "").encode()) + 1
    group, copies = Counter(), Counter()
    for r in rows:
        group[r.text] += size(r)
        copies[r.text] += 1
    target = sum(group.values()) / 8
    moved = {t for t in group if copies[t] > 1 and group[t] > sharding.GROUP_SLACK * target}
    unit = max([sharding.TOLERANCE * target, *(n for t, n in group.items() if t not in moved)])
    last = -1
    for shard in range(8):
        own = sorted((r for r in rows if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        regular = [r.k for r in own if r.text not in moved]
        assert regular == sorted(regular) and (not regular or regular[0] > last)
        last = max([last, *regular])
        assert abs(sum(map(size, own)) - target) <= 2 * unit + sum(group[t] for t in moved if group[t] > target) + 1
    for t in group:  # equal texts share a shard if they fit in one
        if group[t] <= target / 2 or t not in moved:
            assert len({r.shard for r in rows if r.text == t}) == 1


def test_a_third_of_all_rows_in_one_group_is_split_evenly(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same " * 50)).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"), F.lit("x" * 240))).alias("text"))
    found = sharding.shard_documents(docs).groupBy("shard").agg(F.sum(sharding.row_size()).alias("b")).collect()
    sizes = [r.b for r in found]
    assert len(sizes) == 8 and max(sizes) / (sum(sizes) / 8) < 1.03


def test_equal_texts_stay_together(real):
    out = sharding.shard_documents(real)
    assert out.groupBy("text").agg(F.count_distinct("shard").alias("n")).filter("n > 1").count() == 0


def test_large_groups_are_dealt_whole(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, F.lit("a" * 200)).when(F.col("id") % 10 == 1, F.lit("b" * 150)).when(F.col("id") % 20 == 2, F.lit("c" * 100)).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"), F.lit("x" * 195))).alias("text"))
    out = sharding.shard_documents(docs, rows_per_gap=100)
    assert out.groupBy("text").agg(F.count_distinct("shard").alias("n")).filter("n > 1").count() == 0
    sizes = [r.b for r in out.groupBy("shard").agg(F.sum(sharding.row_size()).alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) / (sum(sizes) / 8) < 1.01
    slots = out.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert all(r.n == r.d == r.m + 1 for r in slots)


def test_one_row_repeated_is_cut_across_partitions(spark):
    """A third of all rows are one row: they share a key, and still no gap holds them all in one window."""
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"), F.lit(1).alias("shard_part")).repartition(6)
    out = sharding.shard_documents(docs, shards=4, rows_per_gap=50)
    rows = out.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect())
    for shard in range(4):
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))


def test_sharding_nothing(empty):
    assert sharding.shard_documents(empty).count() == 0


# -- similarity join


def plain_sets(texts):
    out = []
    for t in texts:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        out.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    return out


def plain_components(rows):
    """(doc_id, size, least reachable doc_id) by comparing all pairs."""
    sets = plain_sets([t for _, t in rows])
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                shared = len(sets[i] & sets[j])
                if 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared):
                    parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s), (least.get(root(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("which", ["hard", "clashing", "real"])
def test_join_equals_all_pairs(request, which):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in partenum.join_documents(docs).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_components(rows)))


def near_copies(n, words, edits, seed):
    rng = np.random.default_rng(seed)
    base = [f"w{rng.integers(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for at in rng.integers(0, words, rng.integers(0, edits + 1)):
            copy[at] = f"e{rng.integers(0, 10**9)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("block", [1024, 16])
def test_chains_hot_passages_and_small_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(partenum, "BLOCK", block)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = near_copies(60, 120, 6, 1) + near_copies(40, 30, 3, 2)
    texts += [passage + " " + " ".join(f"u{i}x{j}" for j in range(5 + i % 25)) for i in range(80)]  # similar or nearly so by the passage alone
    chain = [f"c{i}" for i in range(200)]
    texts += [" ".join(chain[k * 10 : k * 10 + 100]) for k in range(11)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in partenum.join_documents(docs).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got) == sorted(plain_components(rows))


@settings(max_examples=120, deadline=None)
@given(st.integers(3, 150), st.integers(0, 60), st.integers(0, 60), st.integers(0, 10**6))
def test_similar_sets_share_a_signature_whatever_is_dropped(common, own_a, own_b, seed):
    """With any ranking of signatures, the most frequent droppable ones can go and one is still shared."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 2**63, common + own_a + own_b, dtype=np.int64).astype(np.uint64)
    a, b = np.unique(x[: common + own_a]), np.unique(np.concatenate([x[:common], x[common + own_a :]]))
    shared = len(np.intersect1d(a, b))
    if 100 * shared < 75 * (len(a) + len(b) - shared):
        return
    order = rng.permutation(2**12)

    def kept(s):
        tokens, own, above = partenum.signatures(s)
        out = set()
        low = (1 << 6) - 1
        for band in set((tokens & low).tolist()):
            mine = [t for t in tokens.tolist() if t & low == band]
            drop = own if band == partenum.band_of(len(s)) else above
            mine.sort(key=lambda t: (order[t % 2**12], t))
            out |= set(mine[: len(mine) - drop])
        return out

    assert kept(a) & kept(b)


def test_shingles():
    assert len(shingle_set("a b c d e f")) == 2 and len(shingle_set("A  b\tc")) == 1 and len(shingle_set(" \n")) == len(shingle_set(None)) == 0
    assert (shingle_set("a b") == shingle_set("A\nB")).all() and (shingle_set("a b") != shingle_set("a b c")).all()


def test_joining_nothing(empty):
    assert partenum.join_documents(empty).count() == 0


def test_one_of_each_group_stays(clashing):
    kept = partenum.keep_one(clashing)
    assert kept.columns == clashing.columns
    found = partenum.join_documents(clashing)
    groups = found.filter("n_shingles > 0").select("component_id").distinct().count()
    texts = kept.filter("text is not null and trim(translate(text, '\\n\\t', '  ')) <> ''").count()
    assert texts == groups


def test_rows_of_one_doc_id_are_told_apart(spark):
    same = " ".join(f"w{i}" for i in range(40))
    rows = [(5, same, "a"), (5, same, "a"), (5, same + " more", "b"), (5, "quite another text with words of its own", "a"), (5, None, "a"), (5, "", "a"), (7, same, "c"), (None, "only here and without an id", "d"), (None, "only here and without an id", "d"), (None, same, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(4)
    kept = sorted(map(tuple, partenum.keep_one(docs).collect()), key=str)
    assert [r[1:] for r in kept if r[0] is None] == [("only here and without an id", "d")]
    assert sorted(str(r[1]) for r in kept if r[0] == 5)[:2] == ["", "None"] and len(kept) == 5
    assert (5, "quite another text with words of its own", "a") in kept and sum(bool(r[1]) and r[1].startswith("w0 ") for r in kept) == 1
    assert kept == sorted(map(tuple, partenum.keep_one(docs.repartition(2)).collect()), key=str)


@pytest.mark.parametrize("least", [8, 1])
def test_frequent_tokens_change_nothing(spark, least, monkeypatch):
    """A third of all sets share a passage and are nearly similar by it; the sample takes every set."""
    monkeypatch.setattr(partenum, "SAMPLE", 1)
    monkeypatch.setattr(partenum, "FREQUENT_LEAST", least)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [passage + " " + " ".join(f"u{i}x{j}" for j in range(6 + i % 20)) for i in range(60)] + near_copies(40, 60, 4, 9) + near_copies(20, 300, 20, 10)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in partenum.join_documents(docs).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got) == sorted(plain_components(list(enumerate(texts))))


# -- pipeline


def test_pipeline(spark, real, labels):
    pipeline = pytest.importorskip("corpus_pipeline")
    from .conftest import DATA

    sf_dir, docs = str(DATA), real
    assert len(pipeline.STAGES) == 5
    outputs = []
    for name, step in pipeline.STAGES[:-1]:
        from cubeloom.llm.common import stage

        docs = stage(step(spark, docs, sf_dir), "t")
        assert docs.columns == real.columns, name
        outputs.append(docs)
    calm, single, hidden, mixed = outputs
    toxic = {r.doc_id for r in labels.filter("toxic = 1").collect()}
    gone = {r.doc_id for r in real.collect()} - {r.doc_id for r in calm.collect()}
    assert len(gone & toxic) >= 0.95 * len(toxic) and len(gone - toxic) <= 0.02 * real.count() + len(toxic) * 0.5
    rows = [(r.doc_id, r.text) for r in calm.collect()]
    assert {r.doc_id for r in single.collect()} == {c for _, _, c in plain_components(rows)}
    assert hidden.count() == single.count()
    assert not any(secrets.scan(r.text)[0] for r in hidden.collect())
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in hidden.collect()}
    run = pipeline.run(spark, sf_dir)
    assert Counter((r.doc_id, r.ids_crc32) for r in run.collect()) == Counter((r.doc_id, r.ids_crc32) for r in pipeline.STAGES[-1][1](spark, mixed, sf_dir).collect())
    assert zlib.crc32(b"") == 0
