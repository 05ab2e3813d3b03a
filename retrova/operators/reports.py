"""Operational reports over logs: latency summaries, request metrics, service levels, audit, keys, snapshots, replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fnv1a64, redact

AUDIT_SCHEMA = "unix_ms long, actor_id string, tenant_id string, operation string, allowed boolean, detail string"
#: Defaults of a control plane: the lag that raises an alert, and how far snapshots are apart.
MAX_LAG_MS, SNAPSHOT_SECONDS = 2000, 300


def latency_summary(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by.., n, avg, min, max, p50, p95, p99) a group. A percentile is the value at place round((n - 1) * p) of the order.

    Ranks come from a distributed sort within groups of equal values: counts a value, then running sums.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by)
    placed = counts.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * p + 0.5), F.col(value)))
    return placed.groupBy(*by).agg(F.max("n").alias("n"), F.round(F.sum(F.col(value) * F.col("c")) / F.max("n"), 6).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def latency_interpolated(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    q = lambda p: F.round(F.percentile(value, F.lit(p)), 6)
    return rows.groupBy(*by).agg(q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"))


def quickstart(rows: DataFrame, value: str, ok: Column, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.round(F.median(value), 6).alias("median"), F.round(F.avg(ok.cast("double")), 6).alias("success_rate"))


#: Paths, without what follows a question mark, of the requests that run SQL or a search.
SQL_PATHS = r"^/v1/(sql|query|query-compact)$|^/grpc/[^/]*QueryService/(Query|Sql)$"


def request_metrics(requests: DataFrame) -> DataFrame:
    """One row of (path, status, duration_ms) requests: totals, error classes, and of those that run SQL the failed ones and the latencies."""
    is_sql = F.substring_index("path", "?", 1).rlike(SQL_PATHS)
    sql = F.when(is_sql, F.col("duration_ms"))
    return requests.agg(F.count(F.lit(1)).alias("requests"), F.count_if((F.col("status") >= 400) & (F.col("status") < 500)).alias("client_errors"), F.count_if(F.col("status") >= 500).alias("server_errors"), F.count_if(is_sql).alias("sql_requests"), F.count_if(is_sql & (F.col("status") >= 400)).alias("sql_failed"), F.round(F.coalesce(F.avg(sql), F.lit(0.0)), 6).alias("sql_avg_ms"), F.coalesce(F.max(sql), F.lit(0.0)).alias("sql_max_ms"))


def recent_requests(requests: DataFrame, limit: int = 512) -> DataFrame:
    return requests.orderBy(F.desc("seq")).limit(min(limit, 512))


def service_levels(metrics: DataFrame, lag_ms: float = 0, restore_ms: float = 0, max_lag_ms: float = MAX_LAG_MS, snapshot_seconds: float = SNAPSHOT_SECONDS) -> DataFrame:
    """Availability, recovery point and alerts of a `request_metrics` row.

    lag_ms: the replication's lag; restore_ms: for how long a restore has been running.
    """
    up = F.when(F.col("requests") > 0, 100 * (F.col("requests") - F.col("server_errors")) / F.col("requests")).otherwise(100.0)
    failed = F.when(F.col("sql_requests") > 0, F.col("sql_failed") / F.col("sql_requests")).otherwise(0.0)
    return metrics.select(
        F.round(up, 6).alias("availability"), (up >= 99.95).alias("availability_met"), F.lit(lag_ms / 1000).alias("rpo_seconds"), F.lit(lag_ms / 1000 <= 60).alias("rpo_met"), F.round(failed, 6).alias("sql_error_rate"),
        (failed > 0.05).alias("alert_sql_errors"), (F.col("sql_avg_ms") > 50).alias("alert_sql_latency"), F.lit(lag_ms > max_lag_ms).alias("alert_lag"), F.lit(restore_ms > 1000 * snapshot_seconds).alias("alert_restore"),
    )


def audit(events: DataFrame, actor: str | None = None, tenant: str | None = None, operation: str | None = None, allowed: bool | None = None, since: int | None = None, until: int | None = None, limit: int | None = None) -> DataFrame:
    """Audit events that match all that is given; both time bounds are inclusive."""
    for column, value in (("actor_id", actor), ("tenant_id", tenant), ("operation", operation), ("allowed", allowed)):
        if value is not None:
            events = events.where(F.col(column) == value)
    if since is not None:
        events = events.where(F.col("unix_ms") >= since)
    if until is not None:
        events = events.where(F.col("unix_ms") <= until)
    if limit is None:
        return events
    # the order of the log: its own numbers where it has them
    order = ["seq"] if "seq" in events.columns else ["unix_ms", "actor_id", "tenant_id", "operation", "allowed"]
    return events.orderBy(*order).limit(limit)


def audit_write(events: DataFrame, path: str, redacted: list[str]) -> None:
    """Appends events to the log under `path`, as JSON lines; the named fields of `detail` are masked before."""
    events.withColumn("detail", redact(F.col("detail"), redacted)).write.mode("append").json(path)


def audit_read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).json(path)


def audit_export(events: DataFrame, path: str) -> int:
    """Writes the events that `audit` left as JSON lines, and says how many they are."""
    events.write.mode("overwrite").json(path)
    return events.sparkSession.read.schema(AUDIT_SCHEMA).json(path).count()


#: Operations of each default role, and the roles that may act for other tenants.
ROLES = {"reader": {"query"}, "writer": {"query", "ingest"}, "tenant_admin": {"query", "ingest", "delete_tenant"}, "admin": {"query", "ingest", "sql_admin", "delete_tenant"}}
CROSS_TENANT = {"admin"}


def allowed(requests: DataFrame, roles: dict[str, set[str]] | None = None, cross: set[str] | None = None) -> DataFrame:
    """requests (actor_roles, actor_tenant, tenant, operation) with `allowed`: some role grants the operation, and for another tenant some role may cross.

    A tenant that is null or blank is an error.
    """
    roles, cross = ROLES if roles is None else roles, CROSS_TENANT if cross is None else cross
    holds = lambda name: F.coalesce(F.array_contains("actor_roles", name), F.lit(False))
    grant, crosses = F.lit(False), F.lit(False)
    for name, ops in sorted(roles.items()):
        grant = grant | (holds(name) & F.coalesce(F.col("operation").isin(sorted(ops)), F.lit(False)))
    for name in sorted(cross):
        crosses = crosses | holds(name)
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    error = F.raise_error(F.lit("a tenant id is empty")).cast("boolean")
    return requests.withColumn("allowed", F.when(blank("actor_tenant") | blank("tenant"), error).otherwise(grant & ((F.col("actor_tenant") == F.col("tenant")) | crosses)))


def tenant_filters(filters: dict[str, str], tenant: str) -> dict[str, str]:
    """The filters with the caller's tenant; another tenant in them is denied."""
    if filters.get("tenant", tenant) != tenant:
        raise PermissionError("the filter names another tenant")
    return {**filters, "tenant": tenant}


def key_report(metadata: DataFrame, current: str) -> DataFrame:
    """One row: values scanned, encrypted ones (enc:v1:key:..), those of the current key, the stale keys, and whether every encrypted one is of the current key."""
    parts = F.split("value", ":")
    enc = F.coalesce(F.col("value").startswith("enc:v1:"), F.lit(False))
    key = F.when(enc, parts[2])
    return metadata.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(enc).alias("encrypted"), F.count_if(key == current).alias("current"), F.array_join(F.sort_array(F.collect_set(F.when(key != current, key))), ",").alias("stale_keys"), (F.count_if(enc) == F.count_if(key == current)).alias("verified"))


def restore_point(snapshots: DataFrame, at_ms: int) -> DataFrame:
    """The newest snapshot at or before a time whose file is there, of equally new ones the last."""
    return snapshots.where((F.col("created_ms") <= at_ms) & F.col("present")).orderBy(F.desc("created_ms"), F.desc("snapshot_id")).limit(1)


def prunable(snapshots: DataFrame, now_ms: int, retention_ms: int) -> DataFrame:
    """Snapshots to remove: those beyond the retention whose file is there, but never the newest, the first of equally new ones, whether its file is there or not."""
    newest = snapshots.agg(F.min_by("snapshot_id", F.struct(-F.col("created_ms"), "snapshot_id")).alias("newest"))
    old = snapshots.where(F.col("present") & (F.col("created_ms") < max(0, now_ms - retention_ms)))
    return old.crossJoin(F.broadcast(newest)).where(F.col("snapshot_id") != F.col("newest")).drop("newest")  # one row


def commit_index(log: DataFrame, acks: DataFrame, quorum: int) -> DataFrame:
    """One row: the end of the log's prefix, from index 1 without a gap, whose entries `quorum` nodes hold."""
    n = acks.groupBy("index").agg(F.countDistinct("node_id").alias("n"))
    entries = log.select("index").distinct().join(n, "index", "left").select("index", (F.coalesce("n", F.lit(0)) >= quorum).alias("ok"))
    # contiguous from 1 iff no missing index and no entry short of the quorum lies before
    bad = entries.agg(F.min(F.when(~F.col("ok"), F.col("index"))).alias("short"))
    after = entries.select((F.col("index") + 1).alias("index")).union(entries.sparkSession.createDataFrame([(1,)], "index long")).join(entries, "index", "left_anti").agg(F.min("index").alias("gap"))
    return bad.crossJoin(after).select((F.least("short", "gap") - 1).alias("commit_index"))


def entry_checksum() -> Column:
    return fnv1a64(F.concat_ws("|", F.col("index").cast("string"), F.col("term").cast("string"), "leader_id", "operation", "payload"))
