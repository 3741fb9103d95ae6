"""Claims from thresholds, and the comparison of two data sets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Bound = tuple[str, str, float]  # metric, one of >= > <= <, limit


@dataclass(frozen=True)
class Claim:
    """Supported when all of `supported` hold, else weakened when all of `weakened` hold, else
    `otherwise`; a claim without rules is not testable."""

    name: str
    supported: tuple[Bound, ...] = ()
    weakened: tuple[Bound, ...] | None = None
    otherwise: str = "CONTRADICTED"


# The thresholds frozen before the held-out evaluation of set 1.
CLAIMS_SET1 = [
    Claim("general_ssl_k8_structure", (("cross_seed_ari", ">=", 0.30),), (("cross_seed_ari", ">=", 0.15),)),
    Claim("baseline_and_ssl_organizations_differ", (("baseline_ari", "<", 0.30),), None, "WEAKENED"),
    Claim("ssl_is_nonlinearly_recoverable_from_handcrafted_features", (("nonlinear_ba", ">=", 0.80),), (("nonlinear_ba", ">=", 0.65),)),
    Claim("low_fish_identity_leakage", (("identity_v", "<=", 0.20),), (("identity_v", "<=", 0.35),)),
    Claim("low_context_leakage", (("context_v", "<=", 0.20),), (("context_v", "<=", 0.35),)),
    Claim("speed_related_but_not_speed_only", (("speed_eta", ">=", 0.10), ("speed_ba", "<", 0.50)), None, "WEAKENED"),
    Claim("long_cs_primary_interpretation", (("primary_eta", ">=", 0.25), ("primary_rho", ">=", 0.50)), (("primary_eta", ">=", 0.10), ("primary_rho", ">=", 0.25))),
    Claim("llc_secondary_interpretation", (("turn_eta", ">=", 0.10), ("turn_rho", ">=", 0.50), ("turn_directions", ">=", 4)), (("turn_eta", ">=", 0.03), ("turn_rho", ">=", 0.25))),
    Claim("eight_clusters_are_distinct_novel_behaviors"),
]


def claims_from(rules: DataFrame) -> list[Claim]:
    """Claims from a table (claim, status, metric, op, limit) of SUPPORTED and WEAKENED bounds, one row a bound. A claim with a row without
    a metric has no rule. The table is a study's own list of rules, not data."""
    found: dict[str, dict[str, list[Bound]]] = {}
    for r in rules.select("claim", "status", "metric", "op", "limit").orderBy("claim", "status", "metric", "op", "limit").collect():
        bounds = found.setdefault(r["claim"], {})
        if r["metric"] is not None:
            bounds.setdefault(r["status"], []).append((r["metric"], r["op"], float(r["limit"])))
    return [
        Claim(name, tuple(b.get("SUPPORTED", ())), tuple(b["WEAKENED"]) if "WEAKENED" in b else None)
        for name, b in found.items()
    ]


def _holds(bound: Bound) -> Column:
    metric, op, limit = bound
    c = F.col(metric)
    return {">=": c >= limit, ">": c > limit, "<=": c <= limit, "<": c < limit}[op]


def _all(bounds: Sequence[Bound]) -> Column:
    out = F.lit(True)
    for b in bounds:
        out = out & _holds(b)
    return out


def metric_row(tidy: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Means over seeds of the named metrics as one wide row (per `by`)."""
    return tidy.groupBy(*by).agg(*[F.avg(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])


def assess(metrics: DataFrame, claims: Sequence[Claim], by: Sequence[str] = ()) -> DataFrame:
    """(by, claim, status) for each claim; a metric that is missing makes its claim not testable."""
    cells = []
    for c in claims:
        used = sorted({b[0] for b in (*c.supported, *(c.weakened or ()))})
        if not used:
            status = F.lit("NOT_TESTABLE")
        else:
            absent = F.lit(False)
            for m in used:
                absent = absent | F.col(m).isNull()
            status = F.when(absent, "NOT_TESTABLE").when(_all(c.supported), "SUPPORTED")
            if c.weakened is not None:
                status = status.when(_all(c.weakened), "WEAKENED")
            status = status.otherwise(c.otherwise)
        cells.append(F.struct(F.lit(c.name).alias("claim"), status.alias("status")))
    return metrics.select(*by, F.inline(F.array(*cells)))


def compare_sets(first: DataFrame, second: DataFrame, claim: str = "claim") -> DataFrame:
    """Claims of two data sets side by side with a replication status: replicated, partial (one weaker),
    not replicated, or not testable."""
    a = first.select(claim, F.col("status").alias("status_a"))
    b = second.select(claim, F.col("status").alias("status_b"))
    x, y = F.coalesce("status_a", F.lit("NOT_TESTABLE")), F.coalesce("status_b", F.lit("NOT_TESTABLE"))
    out = (
        F.when((x == "NOT_TESTABLE") | (y == "NOT_TESTABLE"), "NOT_DIRECTLY_TESTABLE")
        .when((x == "SUPPORTED") & (y == "SUPPORTED"), "REPLICATED")
        .when((x == "CONTRADICTED") | (y == "CONTRADICTED"), "NOT_STRONGLY_REPLICATED")
        .otherwise("PARTIAL")
    )
    return a.join(b, claim, "full_outer").withColumn("replication", out)


def status_counts(df: DataFrame, status: str = "replication") -> DataFrame:
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def flatten_document(docs: DataFrame, document: str, paths: dict[str, str]) -> DataFrame:
    """Named numbers out of nested JSON documents: tidy (other columns, metric, value)."""
    keep = [c for c in docs.columns if c != document]
    cells = [F.struct(F.lit(n).alias("metric"), F.get_json_object(document, p).cast("double").alias("value")) for n, p in paths.items()]
    return docs.select(*keep, F.inline(F.array(*cells)))
