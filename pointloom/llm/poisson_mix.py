"""Mixing sources to target weights by Poisson replication.

The target gives each source a share of the mixture. A document of a source is
repeated a Poisson number of times whose mean is the source's target count over
its actual count; the uniform number behind it is a hash of the document's id and
a seed, so a run can be repeated and lost tasks give the same rows again. Copies
are then dealt out and sorted by a hash of (id, copy): a global shuffle.

Only DataFrame functions are used. The statistics that are broadcast have one row
for each source named in the target and one for all the others, whatever the data.

Defined results: sources not named in the target (null included) form one group
with the weight ``other``; documents of a group with weight 0 go; a row with a null ``doc_id``
is drawn and dealt out by the MD5 of its text (a null text as an empty one), so many of them don't share one fate or one task; a null text stays null; rows with the same id get the
same count, and all their copies stay. A mean count over ``MAX_MEAN`` is an error, not a limit. Added columns are ``copy`` (from 1) and
``shuffle_key``; columns of those names in the input are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Poisson means beyond this are refused: the weights would repeat a source that often.
MAX_MEAN = 10_000.0


def _hash52(*parts: Column) -> Column:
    """52 bits of the MD5 of the parts joined by colons, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("long")


def poisson_table(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until the rest is below 2**-60, by logarithms so that no mean underflows."""
    last = (mean + 12.0 * F.sqrt(mean) + 40.0).cast("int")
    start = F.struct((-mean).alias("log_p"), F.exp(-mean).alias("total"), F.array(F.exp(-mean)).alias("sums"))

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.log(mean) - F.log(k.cast("double"))
        total = acc["total"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("total"), F.concat(acc["sums"], F.array(total)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["sums"])


def replicate_to_weights(
    docs: DataFrame, weights: dict[str, float], other: float = 0.0, total: float | None = None, seed: int = 0
) -> DataFrame:
    """``docs`` (doc_id, source, any others) replicated to ``weights``; see the module.

    ``total``: the mean number of rows to come out; None is as many as come in.
    """
    if any(w < 0 or not math.isfinite(w) for w in (*weights.values(), other)):
        raise ValueError("weights are finite and not negative")
    group = F.when(F.col("source").isin(list(weights)), F.col("source")) if weights else F.lit(None).cast("string")
    rows = docs.drop("copy", "shuffle_key").withColumn("__group", group)
    stated = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))]) if weights else None
    weight = F.when(F.col("__group").isNull(), F.lit(float(other)))
    weight = weight.otherwise(stated[F.col("__group")]) if stated is not None else weight
    counts = rows.groupBy("__group").agg(F.count(F.lit(1)).alias("n")).withColumn("w", weight)  # len(weights) + 1 rows
    every = Window.partitionBy(F.lit(0))
    wanted = F.lit(float(total)) if total is not None else F.sum("n").over(every)
    mean = F.when(F.col("w") > 0, F.col("w") / F.sum("w").over(every) * wanted / F.col("n")).otherwise(F.lit(0.0))
    stats = (
        counts.withColumn("mean", mean)
        .withColumn("mean", F.when(F.col("mean") > MAX_MEAN, F.raise_error(F.lit("a source's mean count is too large"))).otherwise(F.col("mean")))
        .where("mean > 0")
        .select(F.col("__group").alias("__g"), poisson_table(F.col("mean")).alias("__sums"))
    )
    text = F.coalesce(F.col("text"), F.lit("")) if "text" in docs.columns else F.lit("")
    who = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(text.cast("binary"))))
    uniform = (_hash52(F.lit(str(seed)), who) + F.lit(0.5)) / F.lit(float(1 << 52))
    copies = F.size(F.filter("__sums", lambda p: p <= F.col("__u")))
    out = (
        rows.withColumn("__u", uniform)
        .join(F.broadcast(stats), F.col("__group").eqNullSafe(F.col("__g")))
        .withColumn("__n", copies)
        .where("__n > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
        .drop("__u", "__n", "__sums", "__group", "__g")
        .withColumn("shuffle_key", _hash52(F.lit(f"{seed}:shuffle"), who, F.col("copy").cast("string")))
    )
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "copy")
