"""Access-log detectors for Unix and Windows web servers.

Input columns: src, method, path, query, status, user_agent, ts (path without the query string).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from emberlog import functions as fn
from emberlog.fixed import web as fx
from emberlog.operators.common import explode_rows


@dataclass(frozen=True)
class WebRules:
    """The lists one server family is judged by."""
    prefix: str
    names: tuple
    tokens: tuple
    admin_paths: tuple
    script_extensions: tuple
    recon_burst: bool


UNIX = WebRules("WEB", tuple(fx.WEBSHELL_NAMES), tuple(fx.WEBSHELL_QUERY_TOKENS),
                tuple(fx.ADMIN_PATHS), tuple(fx.SCRIPT_EXTENSIONS), True)
WINDOWS = WebRules("W3C", tuple(fx.W3C_WEBSHELL_NAMES), tuple(fx.W3C_QUERY_TOKENS),
                   tuple(fx.W3C_ADMIN_PATHS), tuple(fx.W3C_SCRIPT_EXTENSIONS), False)

TAGS = {  # pattern -> (hypotheses, techniques)
    "WEBSHELL_URI_SHAPE": (["H_APT_ESPIONAGE", "H_INITIAL_ACCESS_WEB_SHELL"],
                           ["T1505.003", "T1190"]),
    "SCRIPTED_CLIENT_OFFENSIVE": (["H_SCAN_RECON"], ["T1595", "T1190"]),
    "SCRIPTED_CLIENT_GENERIC": (["H_SCAN_RECON"], ["T1595"]),
    "ADMIN_URI_HIT": (["H_APT_ESPIONAGE"], ["T1190", "T1078"]),
    "UPLOAD_POST_BURST": (["H_APT_ESPIONAGE", "H_INITIAL_ACCESS_WEB_SHELL"], ["T1505.003"]),
    "VERB_TUNNEL": (["H_APT_ESPIONAGE"], ["T1190"]),
    "4XX_RECON_BURST": (["H_SCAN_RECON"], ["T1595"]),
}


def _starts(col, prefixes):
    return reduce(lambda a, b: a | b, [col.startswith(p) for p in prefixes])


def _ends(col, suffixes):
    return reduce(lambda a, b: a | b, [col.endswith(p) for p in suffixes])


def _prepared(rows: DataFrame) -> DataFrame:
    def text(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(""))
    return rows.select(
        text("src").alias("src"), F.upper(text("method")).alias("method"),
        text("path").alias("path"), text("query").alias("query"), text("status").alias("status"),
        F.lower(text("user_agent")).alias("ua"), "ts")


def request_flags(rows: DataFrame, rules: WebRules = UNIX) -> DataFrame:
    """Requests with the list of patterns each one matches (empty for most)."""
    r = _prepared(rows)
    low = F.lower("path")
    ok = F.col("status").startswith("2")
    offensive = fn.any_contains(F.col("ua"), fx.OFFENSIVE_AGENTS)
    tests = {
        "WEBSHELL_URI_SHAPE": F.substring_index(low, "/", -1).isin(list(rules.names))
        | fn.any_contains(F.lower("query"), rules.tokens),
        "SCRIPTED_CLIENT_OFFENSIVE": offensive,
        "SCRIPTED_CLIENT_GENERIC": ~offensive & ok & fn.any_contains(
            F.col("ua"), fx.GENERIC_AGENTS),
        "ADMIN_URI_HIT": _starts(low, rules.admin_paths) & (ok | F.col("status").startswith("3"))
        & (F.col("src") != "") & ~fn.is_private(F.col("src")),
    }
    flags = F.filter(F.array(*[F.when(t, f"{rules.prefix}_{k}") for k, t in tests.items()]),
                     lambda x: x.isNotNull())
    return r.withColumn("flags", flags)


def request_hits(rows: DataFrame, rules: WebRules = UNIX) -> DataFrame:
    """Matching requests per pattern and client."""
    flagged = explode_rows(request_flags(rows, rules), F.col("flags"), "rule_id", "src", "ts")
    return flagged.groupBy("rule_id", "src").agg(
        F.count("*").alias("event_count"), F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"))


def upload_bursts(rows: DataFrame, rules: WebRules = UNIX, min_posts: int = 3) -> DataFrame:
    """Repeated posts of one client to one script, at least one of them accepted."""
    r = _prepared(rows).filter((F.col("method") == "POST") & (F.col("src") != "")
                               & _ends(F.lower("path"), rules.script_extensions))
    return r.groupBy("src", "path").agg(
        F.count("*").alias("event_count"), F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.count_if(F.col("status").startswith("2")).alias("accepted"),
    ).filter((F.col("event_count") >= min_posts) & (F.col("accepted") > 0))


def recon_bursts(rows: DataFrame, min_errors: int = 30, min_paths: int = 10) -> DataFrame:
    """Public clients with many 4xx answers over many paths."""
    r = _prepared(rows).filter(F.col("status").startswith("4") & (F.col("src") != "")
                               & ~fn.is_private(F.col("src")))
    per_path = r.groupBy("src", "path").agg(
        F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return per_path.groupBy("src").agg(
        F.sum("n").alias("event_count"), F.count("*").alias("distinct_paths"),
        F.min("a").alias("first_seen"), F.max("b").alias("last_seen"),
    ).filter((F.col("event_count") >= min_errors) & (F.col("distinct_paths") >= min_paths))


def tunnel_verbs(rows: DataFrame, min_requests: int = 50) -> DataFrame:
    """Heavy use of verbs that carry tunnels, as one row."""
    r = _prepared(rows).filter(F.col("method").isin(fx.TUNNEL_VERBS))
    return r.agg(F.count("*").alias("event_count"), F.min("ts").alias("first_seen"),
                 F.max("ts").alias("last_seen")).filter(F.col("event_count") >= min_requests)


def web_hits(rows: DataFrame, rules: WebRules = UNIX) -> DataFrame:
    """All detectors of a server family: rule, entity, count, first and last time."""
    def named(df, rule, entity):
        return df.select(F.lit(f"{rules.prefix}_{rule}").alias("rule_id"), entity.alias("entity"),
                         "event_count", "first_seen", "last_seen")
    parts = [
        request_hits(rows, rules).withColumnRenamed("src", "entity"),
        named(upload_bursts(rows, rules), "UPLOAD_POST_BURST",
              F.concat_ws(" ", "src", "path")),
        named(tunnel_verbs(rows), "VERB_TUNNEL", F.lit("all")),
    ]
    if rules.recon_burst:
        parts.append(named(recon_bursts(rows), "4XX_RECON_BURST", F.col("src")))
    return reduce(lambda a, b: a.unionByName(b), parts)
