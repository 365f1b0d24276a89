"""Status: states, advice, workspaces and settings as CASE expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Marks and labels of the states.
MARKS = {"loading": "◌", "working": "◍", "paused": "⏸", "ready": "●", "stale": "◐", "empty": "○", "unavailable": "✕", "error": "!"}
LABELS = {"loading": "…", "working": "indexing…", "paused": "paused", "ready": "indexed", "stale": "index stale", "empty": "not indexed", "unavailable": "no index", "error": "index error"}


def index_state() -> Column:
    """From enabled, own_points, own_complete, has_baseline, baseline_searched, own_store_reachable."""
    false = lambda c: F.coalesce(F.col(c) == F.lit(False), F.lit(False))
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    return (
        F.when(false("own_store_reachable"), "error")
        .when(~true("enabled"), "paused")
        .when(F.col("own_points").isNotNull() & true("own_complete"), "ready")
        .when(F.col("own_points").isNotNull(), "stale")
        .when(false("baseline_searched"), "empty")
        .when(true("has_baseline"), "empty")
        .otherwise("unavailable")
    )


def looked_up(state: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[state]


def status_line() -> Column:
    """One line: state, points of the corpus that answers, root."""
    state = index_state()
    points = F.when(F.col("own_points").isNotNull(), F.concat(F.lit("own "), T.format_points(F.col("own_points")), F.lit(" pts"))).when(
        F.coalesce(F.col("baseline_searched"), F.lit(True)) & F.col("baseline_points").isNotNull(), F.concat(F.lit("baseline "), T.format_points(F.col("baseline_points")), F.lit(" pts"))
    )
    head = F.concat(F.lit("Index: "), looked_up(state, MARKS), F.lit(" "), looked_up(state, LABELS))
    return F.concat_ws(" · ", head, points, F.col("root"))


#: What advice the columns call for, first match first.
ADVICE = (
    ("rebuild_profile_changed", "profile_changed"),
    ("start_store", "NOT reachable"),
    ("build_own", "NOT baseline_searched AND NOT own_exists"),
    ("finish_run", "NOT baseline_searched AND NOT own_complete"),
    ("refresh", "NOT baseline_searched AND n_changed > 0"),
    ("healthy_own", "NOT baseline_searched"),
    ("build_first", "NOT has_baseline AND NOT own_exists AND n_sources = 0"),
    ("import_source", "n_sources > 0 AND NOT own_exists AND n_compatible > 0"),
    ("build_incompatible", "n_sources > n_compatible AND NOT own_exists"),
    ("baseline_incomplete", "has_baseline AND NOT baseline_complete AND NOT own_exists"),
    ("refresh", "n_changed > 0"),
    ("baseline_only", "NOT own_exists AND has_baseline"),
    ("finish_run", "own_exists AND NOT own_complete"),
)


def advice() -> Column:
    """The recommendation's kind, by the priority of ADVICE."""
    out = None
    for name, rule in ADVICE:
        out = F.when(F.expr(rule), name) if out is None else out.when(F.expr(rule), name)
    return out.otherwise("healthy")


def workspaces(collections: DataFrame, registry: DataFrame) -> DataFrame:
    """Collections (store, points) with their registered roots; those named come first, by name."""
    return collections.join(registry, "store", "left").select("store", "root", "points", F.when(F.col("points").isNull(), "unknown size").otherwise(F.concat(T.format_points(F.col("points")), F.lit(" pts"))).alias("size_label"))


def settings(options: DataFrame, file: DataFrame, environment: DataFrame, other: DataFrame, defaults: DataFrame) -> DataFrame:
    """(key, value, origin) by precedence: options, file, environment, other config, default."""
    ranked = None
    for origin, df in (("options", options), ("file", file), ("environment", environment), ("other", other), ("default", defaults)):
        part = df.select("key", F.col("value").alias(origin))
        ranked = part if ranked is None else ranked.join(part, "key", "full_outer")
    names = ("options", "file", "environment", "other", "default")
    origin = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in names])
    return ranked.select("key", F.coalesce(*names).alias("value"), origin.alias("origin"))


def setting_groups(rows: DataFrame, order: list[str]) -> DataFrame:
    """(group, rank, keys): settings by group, known groups in order, then unknown ones."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("group"))
    return rows.groupBy("group").agg(F.sort_array(F.collect_list("key")).alias("keys")).withColumn("rank", F.when(rank > 0, rank.cast("int")).otherwise(F.lit(len(order) + 1)))


def footer_action(state: Column) -> Column:
    return F.when(state == "paused", "resume").when(state == "ready", "pause").when(state.isin("loading", "working", "error"), "restatus").otherwise("start")


def workspace_of(tabs: DataFrame, sessions: DataFrame, instance: str) -> DataFrame:
    """(tab, directory): the directory of a tab's session, else the instance's."""
    return tabs.join(sessions, "session", "left").select("tab", F.coalesce("directory", F.lit(instance)).alias("directory"))
