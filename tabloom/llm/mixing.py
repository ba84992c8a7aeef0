"""Mixing sources to target weights by Poisson replication; DataFrame functions only.

A source with target weight w and share p of the documents gets the repetition rate
lambda = w / p * budget. Each document draws its number of copies from Poisson(lambda) by inverting
the distribution at a uniform number hashed from its id, is exploded by that number, and the copies
are dealt to partitions by a hash and sorted by it, which is a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, small, unused

#: Hash tasks over which a source's documents are spread where the rates can't be broadcast.
SALTS = 64
#: Copies that are made of a document at once; a document of more copies is dealt to several tasks first.
COPIES = 1_000


def uniform(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 hash: the same on any engine."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_quantiles(rates: DataFrame, source: str) -> DataFrame:
    """(source, first, cdf) of a table (source, rate): cdf holds P(N <= first), P(N <= first + 1), ... as far as a double tells them from 1.

    Twelve deviations on either side of the rate are all that a double can tell, so a source takes 24 sqrt(rate) + 60 numbers,
    summed up in one window; what lies below them has a probability under 1e-30.
    """
    far = 12 * F.sqrt("rate") + 30
    k = rates.where("rate > 0").select(source, "rate", F.explode(F.sequence(F.greatest(F.lit(0), F.floor(F.col("rate") - far)), F.ceil(F.col("rate") + far))).alias("k"))
    cdf = F.sum(F.exp(F.col("k") * F.log("rate") - F.col("rate") - _log_factorial(F.col("k")))).over(Window.partitionBy(source).orderBy("k"))
    some = k.withColumn("cdf", cdf).groupBy(source).agg(F.min("k").alias("first"), F.array_sort(F.collect_list(F.struct("k", "cdf"))).alias("all"))
    some = some.select(source, "first", F.transform("all", lambda x: x["cdf"]).alias("cdf"))
    return some.unionByName(rates.where("rate <= 0").select(source, F.lit(0).cast("long").alias("first"), F.array(F.lit(1.0)).alias("cdf")))


def _log_factorial(k: Column) -> Column:
    """ln k!, by sum up to 20 and by Stirling's series beyond."""
    x = k.cast("double")
    small_k = F.log(F.factorial(F.least(k, F.lit(20))).cast("double"))
    big = x * F.log(x) - x + 0.5 * F.log(2 * F.lit(3.141592653589793) * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(k <= 20, small_k).otherwise(big)


def mixing_rates(docs: DataFrame, scratch: Scratch, weights: dict[str, float] | None = None, budget: float = 1.0) -> DataFrame:
    """(source, rate): the mean number of copies of a document. Without weights all sources weigh the same."""
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("weight", F.lit(1.0))
    else:
        w = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
        n = n.withColumn("weight", F.coalesce(F.element_at(w, F.coalesce("source", F.lit(""))), F.lit(0.0)))
    n = scratch.put(n, "sources")
    total = n.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).first()
    rate = F.col("weight") / F.lit(total["weight"] or 1.0) * F.lit(total["n"] or 0) / F.col("n") * F.lit(float(budget))
    return n.select("source", F.coalesce(F.when(F.lit(bool(total["weight"])), rate), F.lit(0.0)).alias("rate"))


def mix_sources(spark: SparkSession, docs: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0, seed: str = "mix") -> DataFrame:
    """Every column of `docs` for each copy, plus copy_no (from 1), n_copies and shuffle_key, in shuffled order.

    The expected number of rows is `budget` times the input's, split over the sources in proportion to
    `weights` (source name to weight; absent sources and a null source weigh 0 there). With no weights every
    source, the null one included, gets the same share. A document's count depends on its doc_id and the
    seed alone, so equal doc_ids get equal counts; a null doc_id hashes as an empty string. Null or empty
    texts are documents like others. An empty table gives an empty result. Columns named copy_no, n_copies
    or shuffle_key are replaced.
    """
    scratch = Scratch(spark, "mix")
    plain = docs.drop("copy_no", "n_copies", "shuffle_key")
    source, first, cdf, salt, at = (unused(f"tb_{x}", plain) for x in ("source", "first", "cdf", "salt", "at"))
    rates = mixing_rates(docs, scratch, weights, budget)
    quantiles = poisson_quantiles(rates, "source").select(F.col("source").alias(source), F.col("first").alias(first), F.col("cdf").alias(cdf))
    quantiles = scratch.put(quantiles, "quantiles")
    size = quantiles.agg(F.count("*").alias("n"), F.sum(F.size(cdf)).alias("k"), F.max(F.col(first) + F.size(cdf)).alias("most")).first()
    wide = size["n"] * 64 + (size["k"] or 0) * 8
    if small(quantiles, 1, wide) is not quantiles:
        joined = plain.join(F.broadcast(quantiles), plain["source"].eqNullSafe(F.col(source)))
    else:  # so many sources that their quantiles don't fit: a hot source is spread over SALTS tasks
        spread = quantiles.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = plain.withColumn(at, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        joined = left.join(spread, left["source"].eqNullSafe(F.col(source)) & (F.col(at) == F.col(salt))).drop(at, salt)
    u = uniform(seed, F.col("doc_id"))
    below = F.size(F.filter(cdf, lambda c: c <= u))
    counted = joined.withColumn("n_copies", (F.col(first) + below).cast("long")).drop(cdf, first, source).where("n_copies > 0")
    if (size["most"] or 0) <= COPIES:
        copies = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    else:  # a document of many copies goes to several tasks, COPIES of them in each
        dealt = counted.withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_copies") - 1) / COPIES)))).repartition(F.xxhash64("doc_id", at))
        copies = dealt.withColumn("copy_no", F.explode(F.sequence(F.col(at) * COPIES + 1, F.least(F.col("n_copies"), F.col(at) * COPIES + COPIES)))).drop(at)
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy_no").cast("string"))))
    return keyed.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")


def oracle_mix(source: str, seed: str = "mix") -> str:
    """DuckDB SQL for mix_sources() with default weights and budget over the relation `source`."""
    return f"""
WITH docs AS (SELECT * FROM {source}),
n AS (SELECT source, count(*) AS n FROM docs GROUP BY source),
rate AS (SELECT source, (1.0::DOUBLE / (SELECT count(*) FROM n)) * (SELECT sum(n) FROM n)::DOUBLE / n::DOUBLE AS rate FROM n),
ks AS (SELECT unnest(range(0, (SELECT max(ceil(rate + 12 * sqrt(rate) + 31))::BIGINT FROM rate))) AS k),
lf AS (SELECT k, sum(ln(greatest(k, 1)::DOUBLE)) OVER (ORDER BY k) AS s FROM ks),
pmf AS (SELECT source, k, exp(k * ln(rate) - rate - s) AS p FROM rate, lf WHERE k <= ceil(rate + 12 * sqrt(rate) + 30)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf),
drawn AS (SELECT d.*, ('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM docs d),
band AS (SELECT source, k, c, coalesce(lag(c) OVER (PARTITION BY source ORDER BY k), -1.0) AS b FROM cdf),
counted AS (SELECT d.* EXCLUDE (u), coalesce(c.k, 0) AS n_copies FROM drawn d LEFT JOIN band c ON d.source IS NOT DISTINCT FROM c.source AND d.u >= c.b AND d.u < c.c),
copies AS (SELECT *, unnest(range(1, n_copies + 1)) AS copy_no FROM counted WHERE n_copies > 0)
SELECT *, md5('{seed}-order|' || coalesce(doc_id::VARCHAR, '') || '|' || copy_no::VARCHAR) AS shuffle_key FROM copies
"""

