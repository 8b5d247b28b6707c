"""Mixing sources to target weights by temperature, with DataFrame functions only.

Source token shares p are raised to an exponent a and normalised: w = p^a / sum(p^a). a = 1 keeps the shares, a = 0 makes all sources equal.
The exponent is bisected to the largest a whose entropy reaches the target, and raised where the most repeated source would exceed the
repetition limit. The budget, if none is given, is the least at which every document appears once.

The weights are realised as block permutations: each source is gone through in epochs, each in another hash order; the last,
partial epoch ends when the source's budget of tokens is met. A row's place in its source's budget, as a fraction, gives its block, so
that every block holds all sources at the target weights; within a block a hash orders the rows. Running sums are taken per cell of
the hash first and then over cells, so a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, table, written

#: Bisection steps; the exponent is rounded to 6 places afterwards.
STEPS = 40
#: Hexadecimal digits of a hash that name its cell.
CELL_DIGITS = 3

TOKENS = r"[^\x20\x09-\x0D]+"


def n_tokens(text: Column) -> Column:
    """Words between white space, plus one for the end of the text."""
    return (F.coalesce(F.regexp_count(text, F.lit(TOKENS)), F.lit(0)) + 1).cast("long")


def _power_sum(shares: Column, a: Column) -> Column:
    return F.aggregate(shares, F.lit(0.0), lambda s, p: s + F.pow(p, a))


def _entropy(shares: Column, a: Column) -> Column:
    """H(w) = ln S - a * sum(p^a ln p) / S with S = sum(p^a)."""
    s = _power_sum(shares, a)
    return F.log(s) - a * F.aggregate(shares, F.lit(0.0), lambda t, p: t + F.pow(p, a) * F.log(p)) / s


def mixing_weights(tokens: DataFrame, entropy_share: float | None, max_repeats: float | None) -> DataFrame:
    """One row for each source: source, tokens, share, exponent, weight. tokens: source, tokens (one row for each source, over 0).

    Sources are a label of the corpus, so their shares fit one row; documents never do.
    """
    one = tokens.agg(F.array_sort(F.collect_list(F.col("tokens").cast("double"))).alias("all"))
    one = one.select(F.transform("all", lambda t: t / F.aggregate("all", F.lit(0.0), lambda s, x: s + x)).alias("p"))

    def bisected(low_is_fine) -> Column:
        """The border between exponents from 0 for which low_is_fine holds and those up to 1 for which it doesn't."""
        start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))

        def step(acc, _):
            mid = (acc["low"] + acc["high"]) / 2
            return F.struct(F.when(low_is_fine(mid), mid).otherwise(acc["low"]).alias("low"), F.when(low_is_fine(mid), acc["high"]).otherwise(mid).alias("high"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)["high"]

    p, fits = F.col("p"), [F.lit(0.0)]
    if entropy_share is None and max_repeats is None:
        fits.append(F.lit(1.0))
    if entropy_share is not None:
        goal = F.lit(entropy_share) * F.log(F.size("p").cast("double"))
        fits.append(F.when(_entropy(p, F.lit(1.0)) >= goal, F.lit(1.0)).otherwise(bisected(lambda a: _entropy(p, a) >= goal)))
    if max_repeats is not None:
        spread = F.log(F.array_max("p") / F.array_min("p"))
        fits.append(F.when(spread <= F.log(F.lit(float(max_repeats))), F.lit(0.0)).otherwise(bisected(lambda a: (1 - a) * spread > F.log(F.lit(float(max_repeats))))))
    exponent = F.round(F.array_max(F.array(*fits)), 6)
    one = one.select("p", exponent.alias("exponent")).select("p", "exponent", _power_sum(F.col("p"), F.col("exponent")).alias("power_sum"))
    shared = tokens.crossJoin(F.broadcast(one))  # one row
    share = F.col("tokens").cast("double") / F.aggregate("p", F.lit(0.0), lambda s, x: s + x) / F.col("total")
    total = tokens.agg(F.sum("tokens").cast("double").alias("total"))
    shared = shared.crossJoin(F.broadcast(total)).withColumn("share", share)
    return shared.select("source", "tokens", "share", "exponent", (F.pow("share", "exponent") / F.col("power_sum")).alias("weight"))


def mix_sources(docs: DataFrame, entropy_share: float | None = 0.95, max_repeats: float | None = 4.0, budget_tokens: int | None = None, block_tokens: int = 262_144, seed: str = "mix-1", weigh=n_tokens) -> DataFrame:
    """The mixed stream: doc_id, source, n_tokens, epoch (0 first), block, rank (within the block, from 0), exponent, weight.

    docs: doc_id, text, source; other columns are ignored. A null source is the source ''; a null text is empty and has its end token. Rows
    of equal doc_id and source move as one unit. Without budget_tokens every unit appears in epoch 0; with it, each source gets its weight's share,
    to within one unit. weigh gives the tokens of a text column. An empty table gives an empty result.
    """
    units = written(
        only(docs, "doc_id", "text", "source").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), weigh(F.col("text")).alias("n_tokens"))
        .groupBy("doc_id", "source").agg(F.sum("n_tokens").alias("n_tokens")), "mix-units",
    )
    sums = units.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    weights = mixing_weights(sums, entropy_share, max_repeats)
    if budget_tokens is None:
        budget = weights.agg(F.max(F.col("tokens") / F.col("weight")).alias("budget"))
    else:
        budget = weights.agg(F.lit(float(budget_tokens)).alias("budget"))
    plan = weights.crossJoin(F.broadcast(budget)).select("source", "exponent", "weight", "budget", "tokens", F.round(F.col("weight") * F.col("budget")).cast("long").alias("quota"))
    plan = written(plan, "mix-plan")
    epochs = F.floor((F.col("quota") - 1) / F.col("tokens")).cast("int")
    dealt = units.join(F.broadcast(plan), "source").where("quota > 0").select("*", F.explode(F.sequence(F.lit(0), epochs)).alias("epoch"))
    dealt = dealt.withColumn("hash", F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), F.col("source"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    dealt = dealt.withColumn("cell", F.substring("hash", 1, CELL_DIGITS))
    keys = ["source", "epoch", "cell"]
    cells = dealt.groupBy(*keys).agg(F.sum("n_tokens").alias("t"))
    earlier = Window.partitionBy("source", "epoch").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*keys, F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("cell_first"))
    within = Window.partitionBy(*keys).orderBy("hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("in_cell", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(cells, keys)
    placed = placed.withColumn("first", F.col("epoch") * F.col("tokens") + F.col("cell_first") + F.col("in_cell")).where("first < quota")
    blocks = F.greatest(F.ceil(F.col("budget") / block_tokens), F.lit(1))
    # tokens times blocks don't fit a long in a large corpus
    wide = placed.withColumns({"first": F.col("first").cast("decimal(19,0)"), "blocks": blocks.cast("decimal(19,0)"), "quota": F.col("quota").cast("decimal(19,0)")})
    placed = wide.withColumn("block", F.expr("cast(first * blocks div quota as bigint)"))
    in_block = Window.partitionBy("block").orderBy("hash", "doc_id", "source", "epoch")
    return placed.select("doc_id", "source", "n_tokens", "epoch", "block", (F.row_number().over(in_block) - 1).cast("long").alias("rank"), "exponent", F.round("weight", 9).alias("weight"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; its columns and no others, whatever their names. Options as for mix_sources().

    Rows of one doc_id and source, null ones too, are taken together and equally often. An empty table gives an empty result.
    """
    taken = mix_sources(docs, **options).groupBy("doc_id", "source").agg(F.count("*").cast("int").alias("n"))
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.toDF(*names)
    doc_id, source = (rows[names[docs.columns.index(c)]] for c in ("doc_id", "source"))
    joined = rows.join(taken, doc_id.eqNullSafe(taken["doc_id"]) & (F.coalesce(source, F.lit("")) == taken["source"]))
    return joined.select(*names, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select(*names).toDF(*docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents at 0.95 of the largest entropy of sources, scarce ones up to 4 times as often. Nulls, ties, repeats and empty tables as in mix_sources()."""
    return mix_sources(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE units AS (
  SELECT doc_id, coalesce(source, '') AS source, sum(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) + 1)::BIGINT AS n_tokens FROM documents GROUP BY ALL
), sums AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM units GROUP BY source
), p AS (SELECT source, tokens, tokens / (SELECT sum(tokens) FROM sums)::DOUBLE AS p FROM sums
), ent(i, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN h >= goal THEN mid ELSE low END, CASE WHEN h >= goal THEN high ELSE mid END
  FROM (SELECT i, low, high, (low + high) / 2 AS mid,
          (SELECT ln(sum(pow(p, (low + high) / 2))) - (low + high) / 2 * sum(pow(p, (low + high) / 2) * ln(p)) / sum(pow(p, (low + high) / 2)) FROM p) AS h,
          (SELECT 0.95 * ln(count(*)::DOUBLE) FROM p) AS goal FROM ent WHERE i < 40)
), rep(i, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN over THEN mid ELSE low END, CASE WHEN over THEN high ELSE mid END
  FROM (SELECT i, low, high, (low + high) / 2 AS mid, (1 - (low + high) / 2) * (SELECT ln(max(p) / min(p)) FROM p) > ln(4.0::DOUBLE) AS over FROM rep WHERE i < 40)
), a AS (
  SELECT round(greatest(0.0,
    CASE WHEN (SELECT -sum(p * ln(p)) >= 0.95 * ln(count(*)::DOUBLE) FROM p) THEN 1.0 ELSE (SELECT high FROM ent WHERE i = 40) END,
    CASE WHEN (SELECT ln(max(p) / min(p)) <= ln(4.0::DOUBLE) FROM p) THEN 0.0 ELSE (SELECT high FROM rep WHERE i = 40) END), 6) AS exponent
), w AS (SELECT source, tokens, exponent, pow(p, exponent) / (SELECT sum(pow(p, exponent)) FROM p, a) AS weight FROM p, a
), plan AS (SELECT *, (SELECT max(tokens / weight) FROM w) AS budget, round(weight * (SELECT max(tokens / weight) FROM w))::BIGINT AS quota FROM w
), dealt AS (
  SELECT u.doc_id, u.n_tokens, pl.*, e.epoch, md5(concat_ws(':', 'mix-1', e.epoch::VARCHAR, u.source, coalesce(u.doc_id::VARCHAR, ''))) AS hash
  FROM units u JOIN plan pl USING (source), LATERAL (SELECT unnest(range(0, ((pl.quota - 1) // pl.tokens) + 1)) AS epoch) e
), placed AS (
  SELECT *, epoch * tokens + coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY hash, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM dealt
), blocked AS (SELECT *, floor(first * greatest(ceil(budget / 262144), 1) / quota)::BIGINT AS block FROM placed WHERE first < quota)
SELECT doc_id, source, n_tokens, epoch::INTEGER AS epoch, block, row_number() OVER (PARTITION BY block ORDER BY hash, doc_id, source, epoch) - 1 AS rank, exponent, round(weight, 9) AS weight FROM blocked
"""
