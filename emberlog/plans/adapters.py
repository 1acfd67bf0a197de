"""Canonical tables derived from the driver's tables.

Most adapters are plain projections whose expressions read the same in Spark SQL and ANSI SQL, so
one text serves both the query and its SQL equivalent.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlog.plans.finding_seeds import FINDING_EXPRESSIONS, K
from emberlog.session import configure

# `k` is computed below the projections, so that CASE branches read a column instead of repeating it
EVENT_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k"

HEAVY = {"events", "documents", "pages"}

# name -> (base table, [expressions])
PROJECTIONS: dict[str, tuple[str, list[str]]] = {
    "authn": ("events", [
        "event_id", "ts", "concat('user', CAST(user_id AS STRING)) AS principal",
        f"concat('10.0.0.', CAST({K} % 8 AS STRING)) AS source",
        "event_type = 'error' AS failed",
        f"CASE {K} % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'JP' ELSE 'BR' END AS country",
        f"CASE WHEN {K} % 10 = 0 THEN 'IMAP4' WHEN {K} % 10 = 1 THEN 'Other clients' "
        "ELSE 'Browser' END AS client_app",
        f"CASE WHEN {K} % 25 = 0 THEN 'high' ELSE 'none' END AS risk_aggregated",
        f"CASE WHEN {K} % 25 = 1 THEN 'High' ELSE 'low' END AS risk_signin",
        f"CASE WHEN {K} % 25 = 2 THEN 'atRisk' ELSE 'none' END AS risk_state",
    ]),
    "flows": ("lineitem", [
        "l_orderkey * 8 + l_linenumber AS flow_id",
        "concat('10.0.', CAST(CAST(floor(l_suppkey / 250) AS BIGINT) AS STRING), '.', "
        "CAST(l_suppkey % 250 AS STRING)) AS src",
        "CASE l_partkey % 5 WHEN 0 THEN '203.0.113.7' WHEN 1 THEN '20.40.1.9' "
        "WHEN 2 THEN '10.9.9.9' WHEN 3 THEN '8.8.8.8' ELSE '198.51.100.3' END AS dst",
        "CASE l_linenumber % 2 WHEN 0 THEN 443 ELSE 22 END AS dport",
        "CAST(l_partkey % 1000 + 1 AS INT) AS wide_port",
        "CASE l_linestatus WHEN 'O' THEN 'tcp' ELSE 'udp' END AS proto",
        "CASE l_returnflag WHEN 'R' THEN 'REJECT' ELSE 'ACCEPT' END AS action",
        "CAST(floor(l_extendedprice) AS BIGINT) AS bytes", "l_shipdate AS ts",
    ]),
    "netscan": ("lineitem", [
        "concat(CASE l_partkey % 4 WHEN 0 THEN '203.0.113.' WHEN 1 THEN '10.1.2.' "
        "WHEN 2 THEN '20.40.1.' ELSE '127.0.0.' END, CAST(l_partkey % 200 AS STRING)) "
        "AS foreign_addr",
        "CASE l_linenumber WHEN 1 THEN 443 WHEN 2 THEN 3389 WHEN 3 THEN 445 WHEN 4 THEN 8080 "
        "WHEN 5 THEN 389 WHEN 6 THEN 22233 ELSE 60123 END AS foreign_port",
        "CASE l_returnflag WHEN 'A' THEN 'ESTABLISHED' WHEN 'N' THEN 'CLOSED' "
        "ELSE 'TIME_WAIT' END AS state",
        "CASE WHEN l_suppkey % 10 = 0 THEN 3389 ELSE CAST(49152 + l_partkey % 50 AS INT) END "
        "AS local_port",
        "CAST(l_suppkey % 40 AS INT) AS pid", "'TCPv4' AS proto", "l_shipdate AS created",
    ]),
    "smb": ("orders", [
        "concat('10.2.0.', CAST(o_custkey % 60 AS STRING)) AS src",
        "concat('10.3.0.', CAST(o_custkey % 7 AS STRING)) AS dst",
        "CASE o_orderstatus WHEN 'F' THEN 'SMB::FILE_WRITE' WHEN 'O' THEN 'SMB::FILE_READ' "
        "ELSE 'SMB::FILE_MODIFY' END AS action",
        "CASE WHEN o_orderkey % 9 = 0 THEN '\\\\fs01\\C$' ELSE '\\\\fs01\\public' END AS path",
        "concat('dir\\f', CAST(o_orderkey AS STRING), '.bin') AS name", "o_orderdate AS ts",
    ]),
    "files": ("documents", [
        "doc_id", "source AS provider", "source", "text",
        "concat('C:/Users/', source, '/doc', CAST(doc_id AS STRING), '.txt') AS path",
        "n_chars AS size", "doc_id % 2 AS side",
    ]),
    "messages": ("conversations", [
        "conv_id * 1000 + turn AS message_id", "conv_id", "turn", "role", "text",
        "CASE role WHEN 'assistant' THEN 'Sent Items' ELSE 'Inbox' END AS folder",
        "concat(CASE WHEN turn = 0 THEN '' WHEN turn = 1 THEN 'RE: ' ELSE 'Fwd: re: ' END, "
        "'Topic ', CAST(conv_id AS STRING)) AS subject",
        "concat('user', CAST(conv_id % 37 AS STRING), CASE WHEN conv_id % 4 = 0 "
        "THEN '@corp.example' ELSE '@partner.example' END) AS sender_email",
        "concat('peer', CAST((conv_id + turn) % 11 AS STRING), CASE WHEN (conv_id + turn) % 3 = 0 "
        "THEN '@gmail.com' ELSE '@corp.example' END) AS recipient_email",
        "CASE WHEN (conv_id + turn) % 5 = 0 THEN concat('chief', CAST(conv_id % 3 AS STRING), "
        "'@corp.example') ELSE concat('Peer ', CAST(conv_id AS STRING)) END AS recipient_display",
        "CASE WHEN turn % 3 = 1 THEN concat('plan', CAST(conv_id AS STRING), '.xlsx') "
        "WHEN turn % 3 = 2 THEN 'photo.jpg' END AS attachment",
        "length(text) * 150 AS attachment_size",
    ]),
    "intervals": ("lineitem", [
        "l_orderkey AS device", "l_suppkey AS app", "l_linenumber AS seq", "l_shipdate AS t_start",
        "CAST(l_quantity AS INT) AS days",
    ]),
    "findings": ("events", FINDING_EXPRESSIONS),
    "points": ("orders", ["o_orderkey AS device", "o_custkey AS owner", "o_orderdate AS t"]),
}

HOST = "regexp_extract(url, '^https?://([^/]+)', 1)"
PATH = "regexp_extract(url, '^https?://[^/]+([^?#]*)', 1)"

# events joined with the page of the same rank; `url` and `props` are in scope
JOINED: dict[str, list[str]] = {
    "http": [
        "event_id", "ts",
        f"CASE WHEN {K} % 5 = 0 THEN concat('10.1.0.', CAST(user_id % 50 AS STRING)) "
        "ELSE concat('198.51.100.', CAST(user_id % 50 AS STRING)) END AS src",
        f"CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' WHEN {K} % 10 = 9 "
        "THEN 'PROPFIND' ELSE 'GET' END AS method",
        "CASE event_type WHEN 'error' THEN '404' WHEN 'signup' THEN '201' "
        "WHEN 'purchase' THEN '302' ELSE '200' END AS status",
        f"CASE WHEN {K} % 20 = 0 THEN '/cmd.php' WHEN {K} % 20 = 1 THEN '/wp-admin/x' "
        f"ELSE {PATH} END AS path",
        f"CASE WHEN {K} % 33 = 0 THEN 'cmd=whoami' ELSE regexp_extract(url, '[?](.*)$', 1) END "
        "AS query",
        f"CASE {K} % 7 WHEN 0 THEN 'curl/7.8' WHEN 1 THEN 'sqlmap/1.5' "
        "WHEN 2 THEN 'python-requests/2' WHEN 3 THEN '-' ELSE 'Mozilla/5.0 (X11)' END "
        "AS user_agent",
        f"{HOST} AS host", "url",
    ],
    "dns": [
        "event_id", "ts", "concat('10.1.0.', CAST(user_id % 50 AS STRING)) AS client",
        f"CASE WHEN {K} % 3 = 0 THEN concat(md5(concat(url, CAST({K} AS STRING))), '.', {HOST}) "
        f"ELSE {HOST} END AS query",
        f"CASE WHEN {K} % 10 = 0 THEN 'TXT' ELSE 'A' END AS qtype_name",
        "CASE event_type WHEN 'error' THEN 'NXDOMAIN' ELSE 'NOERROR' END AS rcode_name",
        f"concat(CAST({K} AS STRING), '.0,300.0') AS ttls",
        f"concat('203.0.113.', CAST({K} % 50 AS STRING), ',alias', CAST({K} % 3 AS STRING), "
        "'.example.net') AS answers",
    ],
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table with its own columns.

    A file with fewer row groups than there are cores is spread over the cores, because the work
    per row (patterns, rules) outweighs moving it. Larger inputs already split by row group and are
    left alone; column pruning and filters pass through the exchange to the scan.
    """
    configure(spark)
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in HEAVY and rows.rdd.getNumPartitions() < cores:
        return rows.repartition(cores)
    return rows


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr("*", EVENT_K)


def adapter(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A canonical table."""
    if name in PROJECTIONS:
        base, exprs = PROJECTIONS[name]
        rows = events(spark, sf) if base == "events" else table(spark, sf, base)
        return rows.selectExpr(*[_spark_text(e) for e in exprs])
    pages = table(spark, sf, "pages").select("page_id", "url")
    rows = events(spark, sf).withColumn(
        "page_id", F.col("event_id") % pages.agg(F.count("*").alias("n")).scalar())
    return rows.join(pages, "page_id").selectExpr(*[_spark_text(e) for e in JOINED[name]])


def stream_adapter(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A canonical table whose base table is read as a stream; `ts` is an instant, as watermarks need."""
    base, exprs = PROJECTIONS.get(name) or ("events", JOINED[name])
    path = f"{sf}/{base}.parquet"
    # a pattern, as a stream's source may be a folder or a pattern but no single file
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    if base == "events":
        rows = rows.selectExpr("*", EVENT_K)
    if name in JOINED:
        pages = table(spark, sf, "pages").select("page_id", "url")
        rows = rows.withColumn("page_id", F.col("event_id") % pages.count()).join(pages, "page_id")
    return rows.selectExpr(*[_spark_text(e) for e in exprs]).withColumn("ts", F.col("ts").cast("timestamp"))


def _spark_text(expr: str) -> str:
    return expr.replace("\\", "\\\\")  # Spark literals read backslash escapes, ANSI SQL does not


def cte(name: str) -> str:
    """The same canonical table as a common table expression."""
    if name in PROJECTIONS:
        base, exprs = PROJECTIONS[name]
        if base == "events":
            base = f"(SELECT *, {EVENT_K} FROM events)"
        return f"{name} AS (SELECT {', '.join(exprs)} FROM {base})"
    exprs = ", ".join(JOINED[name])
    return (f"{name} AS (SELECT {exprs} FROM (SELECT *, {EVENT_K} FROM events) e JOIN pages "
            "ON pages.page_id = e.event_id % (SELECT count(*) FROM pages))")


def sql(uses: str, body: str) -> str:
    """Put the named adapters in front of a query text (which may start with its own WITH)."""
    parts = ", ".join(cte(n) for n in uses.split())
    body = body.strip()
    own = re.match(r"(?i)with\s+", body)
    if not parts:
        return body
    return f"WITH {parts}, {body[own.end():]}" if own else f"WITH {parts} {body}"
