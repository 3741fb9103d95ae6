"""Statistics of label sequences: transitions, motifs, Markov tests, mixture entropy."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import join_nullsafe, row_numbers, runs
from .effects import chi2_tail


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], slot: Column) -> DataFrame:
    """Adds the 0-based `position` of each row in its sequence, hot sequences split by `slot`."""
    return row_numbers(df, keys, list(order), slot, "_rn").withColumn("position", F.col("_rn") - 1).drop("_rn")


def transitions(seq: DataFrame, keys: Sequence[str], label: str, position: str = "position") -> DataFrame:
    """(prev, next, n, p): counts of neighbouring labels and row-normalised probabilities."""
    g = runs(seq, keys, position, label, 2).select(F.col("gram")[0].alias("prev"), F.col("gram")[1].alias("next"))
    n = g.groupBy("prev", "next").agg(F.count(F.lit(1)).alias("n"))
    out = n.groupBy("prev").agg(F.sum("n").alias("_all"))
    return join_nullsafe(n, out, ["prev"]).select("prev", "next", "n", (F.col("n") / F.col("_all")).alias("p"))


def start_distribution(seq: DataFrame, label: str) -> DataFrame:
    """(state, n, p): share of each label over all positions, the chain's stationary estimate."""
    g = seq.groupBy(F.col(label).alias("state")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("state", "n", (F.col("n") / g.agg(F.sum("n")).scalar()).alias("p"))


def motifs(seq: DataFrame, keys: Sequence[str], label: str, length: int, position: str = "position") -> DataFrame:
    """(motif, n, windows, frequency) of every label run of the given length."""
    g = runs(seq, keys, position, label, length).groupBy(F.col("gram").alias("motif")).agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n")).scalar()
    return g.select("motif", "n", total.alias("windows"), (F.col("n") / total).alias("frequency"))


def expected_frequency(motif_table: DataFrame, trans: DataFrame, start: DataFrame) -> DataFrame:
    """Adds `expected`: start probability times the transition probabilities along the motif, 0 when a step never occurs.

    The motifs' prefixes form a trie, which is walked level by level: a prefix gets its probability once, from the prefix before it and one row of the transition
    table, whatever the number of motifs that share it and of states. Each level is a join of distinct prefixes; motifs may differ in length."""
    longest = motif_table.agg(F.max(F.size("motif"))).first()[0] or 0
    m = F.col("motif")
    level = every = None
    for n in range(1, longest + 1):
        prefix = motif_table.where(F.size(m) >= n).select(F.slice(m, 1, n).alias("motif")).distinct()
        last = F.element_at(m, n)
        if n == 1:
            first = join_nullsafe(prefix.select("motif", last.alias("state")), start.select("state", F.col("p").alias("_p")), ["state"], "left")
            level = first.select("motif", F.coalesce("_p", F.lit(0.0)).alias("expected"))
        else:
            steps = prefix.select("motif", F.slice(m, 1, n - 1).alias("_parent"), F.element_at(m, n - 1).alias("prev"), last.alias("next"))
            walked = steps.join(level.select(F.col("motif").alias("_parent"), "expected"), "_parent")
            walked = join_nullsafe(walked, trans.select("prev", "next", F.col("p").alias("_p")), ["prev", "next"], "left")
            level = walked.select("motif", (F.col("expected") * F.coalesce("_p", F.lit(0.0))).alias("expected"))
        every = level if every is None else every.unionByName(level)
    if every is None:
        return motif_table.withColumn("expected", F.lit(0.0))
    return motif_table.join(every, "motif", "left").withColumn("expected", F.coalesce("expected", F.lit(0.0)))


def _likelihood_ratio(f: Column, e: Column, n: Column) -> Column:
    gain = F.when(f > 0, f * F.ln(f / e)).otherwise(0.0)
    rest = F.when(f < 1, (1.0 - f) * F.ln((1.0 - f) / (1.0 - e))).otherwise(0.0)
    return 2.0 * n * (gain + rest)


def markov_score(table: DataFrame, tail: bool = True) -> DataFrame:
    """Likelihood-ratio score of the observed against the expected frequency, with the small-sample
    correction, and -log10 of its chi-square tail: adds `score` (and `neg_log10_p`)."""
    f, e, n = F.col("frequency"), F.col("expected"), F.col("windows").cast("double")
    q = 1.0 + (1.0 / e + 1.0 / (1.0 - e) - 1.0) / (6.0 * n)
    ok = (e > 0) & (e < 1)
    out = table.withColumn("score", F.when(ok, _likelihood_ratio(f, e, n) / q))
    if tail:
        # far out the tail underflows, so its logarithm comes from the series of erfc(sqrt(x / 2)); no score, no tail
        x = F.col("score")
        far = x / 2.0 / math.log(10.0) + F.log10(F.sqrt(math.pi * x / 2.0)) - F.log10(1.0 - 1.0 / x + 3.0 / (x * x))
        out = out.withColumn("neg_log10_p", F.when(x > 200.0, far).when(x.isNotNull(), -F.log10(chi2_tail(F.least(x, F.lit(200.0)), F.lit(1.0)))))
    return out


def compare_usage(first: DataFrame, second: DataFrame) -> DataFrame:
    """Motif usage of the second data set scored against the first (uncorrected ratio): (motif,
    frequency_a, frequency_b, score); a motif that one side lacks has frequency 0 and no score."""
    a = first.select("motif", F.col("frequency").alias("frequency_a"))
    b = second.select("motif", F.col("frequency").alias("frequency_b"), "windows")
    total = second.agg(F.max("windows")).scalar()
    j = a.join(b, "motif", "full_outer").select(
        "motif", F.coalesce("frequency_a", F.lit(0.0)).alias("frequency_a"), F.coalesce("frequency_b", F.lit(0.0)).alias("frequency_b"),
        total.cast("double").alias("_n"),
    )
    e = F.col("frequency_a")
    ok = (e > 0) & (e < 1)
    return j.withColumn("score", F.when(ok, _likelihood_ratio(F.col("frequency_b"), e, F.col("_n")))).drop("_n")


def mixture_entropy(df: DataFrame, probs: str, classes: int) -> DataFrame:
    """Average of -q ln q, where q is a row's probability mass under the mean mixture (one row)."""
    mass = F.aggregate(probs, F.lit(0.0), lambda s, x: s + x)
    share = df.agg(*[F.avg(F.col(probs)[i] / mass).alias(f"p{i}") for i in range(classes)])
    row = df.withColumn("_p", share.select(F.array(*[f"p{i}" for i in range(classes)])).scalar())
    q = F.aggregate(F.zip_with(probs, "_p", lambda x, p: x * p), F.lit(0.0), lambda s, x: s + x)
    return row.select(q.alias("_q")).agg(F.avg(-F.col("_q") * F.ln(F.col("_q") + 1e-15)).alias("entropy"))
