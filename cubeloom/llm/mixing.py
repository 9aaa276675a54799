"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share of the mixture over its present share of the bytes. Each
document is repeated as often as a Poisson distribution with that mean says, where the distribution
is inverted at a number in (0, 1) that depends on the seed and the document alone; so the counts are
the same however the rows are dealt, and a task that is run again makes the same rows. The copies
are then shuffled globally by a hash of document and copy number.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import stage

SEED = "mixture-1"
#: Target weights: the present share to this power, so large sources are sampled down a little.
TEMPERATURE = 0.7
#: Rates of more sources, or distributions of more numbers, are not broadcast but joined by a salted exchange.
MAX_BROADCAST_SOURCES = 50_000
MAX_BROADCAST_NUMBERS = 5_000_000
SALTS = 64

_RATES = "mix_source string, mix_rate double, mix_least long, mix_cdf array<double>"


def poisson_cdf(rate: float) -> tuple[int, list[float]]:
    """The distribution function of a Poisson distribution where it is neither 0 nor 1 in double
    precision: the least count, and P(X <= count) for it and those above."""
    if rate <= 0:
        return 0, [1.0]
    spread = 9 * math.sqrt(rate) + 12
    least, most = max(0, math.floor(rate - spread)), math.ceil(rate + spread + 12)
    k = np.arange(least, most + 1)
    logs = -rate + k * math.log(rate) - np.array([math.lgamma(x + 1) for x in k])
    cdf = np.minimum(np.cumsum(np.exp(logs)), 1.0)
    return least, [float(x) for x in cdf[cdf < 1 - 2**-52]]


def source_rates(docs: DataFrame, weights: DataFrame | None, temperature: float) -> DataFrame:
    """Per source its mean repetition and the inverse distribution; one partial aggregation over all rows.

    ``weights`` (source, weight) gives the target shares; a source that it lacks gets none. Without
    it the target is the present share of bytes to the power ``temperature``.
    """
    # A null source is a source of its own, named by a string that no other source has.
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    stats = docs.groupBy(_key(F.col("source")).alias("mix_source")).agg(F.sum(size).alias("size"))
    stats = stage(stats, "sources")
    if weights is None:
        goals = stats.withColumn("goal", F.pow(F.col("size").cast("double"), temperature))
    else:
        goals = stats.join(weights.select(_key(F.col("source")).alias("mix_source"), F.col("weight").cast("double").alias("goal")), "mix_source", "left").fillna(0.0, ["goal"])
    total = goals.agg(F.sum("size").alias("all_size"), F.sum("goal").alias("all_goal"))
    share = F.col("goal") / F.nullif(F.col("all_goal"), F.lit(0.0))
    rates = goals.join(F.broadcast(total)).select(  # one row
        "mix_source", F.coalesce(share * F.col("all_size") / F.col("size"), F.lit(0.0)).alias("mix_rate")
    )

    def invert(batches):
        for batch in batches:
            found = [poisson_cdf(float(r)) for r in batch.mix_rate]
            yield pd.DataFrame({"mix_source": batch.mix_source, "mix_rate": batch.mix_rate, "mix_least": [a for a, _ in found], "mix_cdf": [b for _, b in found]})

    return stage(rates.mapInPandas(invert, _RATES), "rates")


def _key(source):
    return F.coalesce(F.concat(F.lit("s:"), source), F.lit("null"))


def _uniform(*parts):
    """A number in [0, 1) of 52 bits from the md5 of the parts."""
    joined = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, temperature: float = TEMPERATURE, seed: str = SEED) -> DataFrame:
    """The mixture: every document as often as its Poisson count, in a global random order.

    ``docs`` needs ``doc_id``, ``text`` and ``source``. All columns are returned as they are, then
    ``mix_copy`` (from 0), ``mix_rate`` (the mean) and ``mix_order`` (hash that orders the mixture;
    partitions are hash ranges of it in random order). A null text counts one byte, a null source is
    a source of its own, a null doc_id is hashed as such; repeated rows with one doc_id get the same
    count each, and lie in several partitions if their texts differ. Texts are not looked into, so
    long ones cost what they weigh. Copies of equal order are ordered by doc_id. No documents: no
    rows. Columns whose names begin with ``mix_`` are replaced.
    """
    docs = docs.drop("mix_copy", "mix_rate", "mix_order", "mix_source", "mix_least", "mix_cdf", "mix_salt")
    columns = docs.columns
    rates = source_rates(docs, weights, temperature)
    keyed = docs.withColumn("mix_source", _key(F.col("source")))
    n_sources, n_numbers = rates.agg(F.count("*"), F.coalesce(F.sum(F.size("mix_cdf")), F.lit(0))).first()
    if n_sources <= MAX_BROADCAST_SOURCES and n_numbers <= MAX_BROADCAST_NUMBERS:
        joined = keyed.join(F.broadcast(rates), "mix_source")
    else:  # a source may hold a third of all rows: its rows are dealt over the salts
        salted = keyed.withColumn("mix_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        spread = rates.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(spread, ["mix_source", "mix_salt"])
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    u = _uniform(F.lit(seed), doc)
    count = F.col("mix_least") + F.size(F.filter("mix_cdf", lambda p: p <= u))
    copies = (
        joined.withColumn("mix_count", count)
        .filter("mix_count > 0")
        .withColumn("mix_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mix_count") - 1)))
        .withColumn("mix_order", F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), doc, F.col("mix_copy").cast("string"))), 1, 15), 16, 10).cast("long"))
    )
    return copies.select(*columns, "mix_copy", "mix_rate", "mix_order").repartition("mix_order", F.xxhash64("text")).sortWithinPartitions("mix_order", "doc_id")


#: The same mixture in DuckDB's SQL, for the default target weights.
ORACLE = f"""
WITH d AS (
  SELECT *, coalesce('s:' || source, 'null') AS s, coalesce(cast(doc_id AS VARCHAR), 'null') AS doc FROM documents
), stats AS (
  SELECT s, sum(coalesce(strlen(text), 0) + 1) AS size FROM d GROUP BY s
), rates AS (
  SELECT s, pow(size::DOUBLE, {TEMPERATURE}) / sum(pow(size::DOUBLE, {TEMPERATURE})) OVER () * sum(size) OVER () / size AS rate FROM stats
), steps AS (
  SELECT s, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1.0))) OVER (PARTITION BY s ORDER BY k) AS cdf
  FROM rates, LATERAL (SELECT unnest(range(0, cast(ceil(rate + 9 * sqrt(rate)) AS BIGINT) + 25)) AS k) AS r
), counted AS (
  SELECT d.*, rate, (SELECT count(*) FROM steps WHERE steps.s = d.s AND cdf < 1 - pow(2, -52)
    AND cdf <= (('0x' || substr(md5('{SEED}|' || doc), 1, 13))::BIGINT)::DOUBLE / pow(2, 52)) AS n
  FROM d JOIN rates USING (s)
)
SELECT doc_id, text, lang, source, n_chars, c.copy AS mix_copy, round(rate, 9) AS mix_rate,
  ('0x' || substr(md5('{SEED}|order|' || doc || '|' || c.copy), 1, 15))::BIGINT AS mix_order
FROM counted, LATERAL (SELECT unnest(range(0, n)) AS copy) AS c
"""
