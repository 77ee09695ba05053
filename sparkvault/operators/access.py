"""Access keys, roles and capabilities; rules; usage counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkvault.functions.exprs import token_hash

# The built-in roles and their capabilities.
BUILTIN = {"admin": ["admin", "read", "write"], "editor": ["read", "write"], "reader": ["read"]}


def builtin_roles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, c) for r, c in BUILTIN.items()], "role string, builtin array<string>")


def resolve_capabilities(keys: DataFrame, roles: DataFrame, today: Column) -> DataFrame:
    """``keys`` with caps (sorted) and state: ok, expired or unknown_role. Built-in roles win over custom ones (vault_id, role, caps)."""
    joined = keys.join(F.broadcast(builtin_roles(keys.sparkSession)), "role", "left").join(roles.select("vault_id", "role", "caps"), ["vault_id", "role"], "left")
    found = F.coalesce("builtin", "caps")
    expired = F.coalesce(F.col("expires_at") < today, F.lit(False))
    state = F.when(expired, "expired").when(found.isNull(), "unknown_role").otherwise("ok")
    none = F.array().cast("array<string>")
    return joined.withColumn("state", state).withColumn("caps", F.when(state == "ok", F.array_sort(found)).otherwise(none)).select(*keys.columns, "caps", "state")


def authenticate(tokens: DataFrame, keys: DataFrame, today: Column) -> DataFrame:
    """``tokens`` (token) with name and outcome: ok, invalid or expired."""
    known = keys.select("hash", F.col("name"), "expires_at")
    joined = tokens.withColumn("hash", token_hash(F.col("token"))).join(known, "hash", "left")
    outcome = F.when(F.col("name").isNull(), "invalid").when(F.col("expires_at") < today, "expired").otherwise("ok")
    return joined.withColumn("outcome", outcome).select(*tokens.columns, "name", "outcome")


def last_admin_check(resolved: DataFrame) -> DataFrame:
    """Keys with admin whose vault has no other: removing or demoting them leaves none."""
    admin = F.array_contains("caps", "admin")
    n = F.count_if(admin).over(Window.partitionBy("vault_id"))
    return resolved.withColumn("__n", n).filter(admin & (F.col("__n") == 1)).drop("__n")


def capability_changes(sessions: DataFrame, resolved: DataFrame) -> DataFrame:
    """``sessions`` (vault_id, name, caps) with change: revoked, changed or same."""
    now = resolved.select("vault_id", "name", F.col("caps").alias("now"))
    joined = sessions.join(now, ["vault_id", "name"], "left")
    change = F.when(F.coalesce(F.size("now"), F.lit(0)) <= 0, "revoked").when(~F.array_sort("caps").eqNullSafe(F.array_sort("now")), "changed").otherwise("same")
    return joined.withColumn("change", change).drop("now")


def effective_rules(config: DataFrame, system: DataFrame, runtime: DataFrame) -> DataFrame:
    """(section, pattern, source, place): config rules, the system's that are not there already, then the runtime's."""
    tag = lambda df, source, order: df.select("section", "pattern", "ordinal", F.lit(source).alias("source"), F.lit(order).alias("o"))
    own = tag(config, "config", 0)
    added = tag(system, "system", 1).join(config.select("section", "pattern"), ["section", "pattern"], "left_anti").select(*own.columns)
    rows = own.unionByName(added).unionByName(tag(runtime, "runtime", 2))
    place = F.row_number().over(Window.partitionBy("section").orderBy("o", "ordinal", "pattern"))
    return rows.select("section", "pattern", "source", place.alias("place"))


def overlay_maps(base: Column, over: Column) -> Column:
    """Per key, the second map's value wins."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over)


def access_log_summary(log: DataFrame, by: str = "route") -> DataFrame:
    """(route, requests, bytes, errors, p50, p95, p99) by nearest rank."""
    rank = lambda p: F.expr(f"percentile_disc({p}) within group (order by dur_ms)")
    return log.groupBy(by).agg(
        F.count("*").alias("requests"), F.sum("bytes").alias("bytes"), F.count_if(F.col("status") >= 400).alias("errors"),
        rank(0.5).alias("p50"), rank(0.95).alias("p95"), rank(0.99).alias("p99"),
    )


def latency_sketches(log: DataFrame, by: list[str], k: int = 400) -> DataFrame:
    """(by, requests, bytes, errors, sketch): a quantile sketch of ``dur_ms`` for each group, for storing.

    A sketch of size ``k`` takes some kilobytes for any number of requests, and
    a quantile read from it is off by about 1 % of the ranks at most (k = 400).
    """
    return log.groupBy(*by).agg(
        F.count("*").alias("requests"), F.sum("bytes").alias("bytes"), F.count_if(F.col("status") >= 400).alias("errors"), F.kll_sketch_agg_double("dur_ms", F.lit(k)).alias("sketch"),
    )


def merged_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Stored sketches of days, routes or jobs as those of larger groups; the log itself is not read again."""
    return sketches.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("requests", "bytes", "errors")), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_summary(sketches: DataFrame) -> DataFrame:
    """As :func:`access_log_summary`, from sketches."""
    q = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(p))
    return sketches.select("*", q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99")).drop("sketch")


def metric_counters(events: DataFrame, labels: list[str]) -> DataFrame:
    """Counts by label tuple and, with null labels, their subtotals."""
    return events.rollup(*labels).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def gauges(samples: DataFrame, labels: list[str], at: str = "ts") -> DataFrame:
    """(labels, value): the latest value of every gauge of ``samples`` (labels, value, ts)."""
    return samples.groupBy(*labels).agg(F.max_by("value", F.struct(at, "value")).alias("value"))


def metrics_text(families: list[tuple[str, str, str, DataFrame, list[str]]]) -> DataFrame:
    """(metric, place, labels, line): the exposition text of (name, help, kind, rows with ``n``, labels), a counter or a gauge each.

    A family has a HELP and a TYPE line and then its samples; sorted by metric,
    place and labels, the lines are the text, in the order that comparisons of
    two scrapes want. Without labels a family is one sample; a family without
    samples still has its two lines.
    """
    def escaped(c: Column) -> Column:
        return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))

    out = None
    for name, text, kind, rows, labels in families:
        pairs = F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit('"')) for c in labels))
        shown = F.concat(F.lit("{"), pairs, F.lit("}")) if labels else F.lit("")
        plain = text.replace("\\", "\\\\").replace("\n", "\\n")
        spark = rows.sparkSession
        heads = spark.range(2).select(F.when(F.col("id") == 0, f"# HELP {name} {plain}").otherwise(f"# TYPE {name} {kind}").alias("line"), F.col("id").cast("int").alias("place"))
        own = heads.select(F.lit(name).alias("metric"), "place", F.lit("").alias("labels"), "line").unionByName(
            rows.select(F.lit(name).alias("metric"), F.lit(2).alias("place"), shown.alias("labels"), F.concat(F.lit(name), shown, F.lit(" "), F.col("n").cast("string")).alias("line"))
        )
        out = own if out is None else out.unionByName(own)
    return out


def write_metrics(lines: DataFrame, path: str) -> None:
    """The text as one file in order: the samples are as many as label tuples, not as events."""
    lines.orderBy("metric", "place", "labels").select("line").coalesce(1).write.mode("overwrite").text(path)
