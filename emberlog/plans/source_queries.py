"""Queries that parse log lines derived from the driver's tables, sinks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberlog.operators import endpoint
from emberlog.plans.adapters import EVENT_K, adapter, events, sql, stream_adapter, table
from emberlog.plans.detector_queries import EV
from emberlog.plans.indicator_queries import PAGE_IOCS, document_iocs, page_iocs
from emberlog.plans.registry import query
from emberlog.session import scratch_path
from emberlog.sinks import tables as sinks
from emberlog.sources import files as sf_, json_logs as js, lines as ln
from emberlog.streaming import detectors as st

E = f"e AS (SELECT *, {EVENT_K} FROM events)"


def lines(spark, sf, expr: str, *keep) -> DataFrame:
    """Lines written from `events` by an expression over its columns."""
    return events(spark, sf).selectExpr(*keep, f"{expr} AS value")


ISO = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
SECOND = "date_trunc('second', ts)"


@query("src_syslog", f"""WITH {E} SELECT event_id, CAST(k // 8 AS INT) AS facility,
CAST(k % 8 AS INT) AS severity, 'h' || user_id AS host, 'app' AS app, 'm ' || k AS message,
{SECOND} AS ts FROM e""")
def src_syslog(spark, sf):
    text = (f"CASE WHEN event_id % 2 = 0 THEN concat('<', k, '>1 ', {ISO}, ' h', user_id, "
            "' app 77 ID1 - m ', k) ELSE concat('<', k, '>', date_format(ts, 'MMM dd HH:mm:ss'), "
            "' h', user_id, ' app[77]: m ', k) END")
    return ln.parse_syslog(lines(spark, sf, text, "event_id"), 2024).select(
        "event_id", "facility", "severity", "host", "app", "message", "ts")


@query("src_asa", f"""WITH {E} SELECT event_id, CAST(k % 7 AS INT) AS severity, '106023' AS msg_id,
CASE WHEN k % 2 = 0 THEN 'Deny' ELSE 'Built' END AS action, 'outside' AS src_iface,
'198.51.100.' || k AS src_ip, CAST(1000 + k AS INT) AS src_port, '10.0.0.' || user_id % 250
AS dst_ip, CAST(443 AS INT) AS dst_port, k * 10 AS bytes FROM e""")
def src_asa(spark, sf):
    text = ("concat('x %ASA-', k % 7, '-106023: ', CASE WHEN k % 2 = 0 THEN 'Deny tcp src ' ELSE "
            "'Built inbound ' END, 'outside:198.51.100.', k, '/', 1000 + k, ' dst inside:10.0.0.', "
            "user_id % 250, '/443 bytes ', k * 10)")
    return ln.parse_asa(lines(spark, sf, text, "event_id")).select(
        "event_id", "severity", "msg_id", "action", "src_iface", "src_ip", "src_port", "dst_ip",
        "dst_port", "bytes")


@query("src_snort", f"""WITH {E} SELECT event_id, CAST(k AS INT) AS sid, 'scan ' || k AS msg,
'Attempted Recon' AS classification, CAST(k % 3 + 1 AS INT) AS priority, 'TCP' AS proto,
'1.2.3.' || k AS src_ip, CAST(5 AS INT) AS src_port, '10.0.0.1' AS dst_ip, CAST(80 AS INT)
AS dst_port FROM e""")
def src_snort(spark, sf):
    text = ("concat('01/02-03:04:05.6  [**] [1:', k, ':2] scan ', k, ' [**] [Classification: "
            "Attempted Recon] [Priority: ', k % 3 + 1, '] {TCP} 1.2.3.', k, ':5 -> 10.0.0.1:80')")
    return ln.parse_snort(lines(spark, sf, text, "event_id")).select(
        "event_id", "sid", "msg", "classification", "priority", "proto", "src_ip", "src_port",
        "dst_ip", "dst_port")


@query("src_web_access", f"""WITH {E} SELECT event_id, '10.0.0.' || k AS src, 'GET' AS method,
'/a/' || user_id AS path_only, 'q=' || k AS query, '200' AS status, k * 3 AS bytes,
'curl/8' AS user_agent, {SECOND} AS ts FROM e""")
def src_web_access(spark, sf):
    text = ("concat('10.0.0.', k, ' - - [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] \"GET "
            "/a/', user_id, '?q=', k, ' HTTP/1.1\" 200 ', k * 3, ' \"-\" \"curl/8\"')")
    return ln.parse_access(lines(spark, sf, text, "event_id")).select(
        "event_id", "src", "method", "path_only", "query", "status", "bytes", "user_agent", "ts")


@query("src_auditd", f"""WITH {E} SELECT CAST(event_id // 2 AS VARCHAR) AS serial, count(*)
AS records, max(CASE WHEN event_id % 2 = 0 THEN 'wget' END) AS program FROM e GROUP BY 1""")
def src_auditd(spark, sf):
    text = ("concat('type=', CASE WHEN event_id % 2 = 0 THEN 'EXECVE' ELSE 'SYSCALL' END, "
            "' msg=audit(1700000000.123:', floor(event_id / 2), '): argc=2 a0=\"/usr/bin/wget\" "
            "auid=', user_id)")
    rows = lines(spark, sf, text, "floor(event_id / 2) % 3 AS host")
    e = ln.parse_auditd(rows, ["host"])
    watched = endpoint.watched_executions(ln.parse_audit_records(rows)).select(
        "serial", "program")
    return e.select("serial", F.size("records").cast("bigint").alias("records")).join(
        watched, "serial", "left")


@query("auditd_rollups", f"""WITH {E} SELECT 'auid' AS kind, CAST(user_id AS VARCHAR) AS value,
count(*) AS n FROM e GROUP BY user_id UNION ALL SELECT 'type', CASE WHEN event_id % 2 = 0
THEN 'EXECVE' ELSE 'SYSCALL' END, count(*) FROM e GROUP BY 2""")
def auditd_rollups(spark, sf):
    text = ("concat('type=', CASE WHEN event_id % 2 = 0 THEN 'EXECVE' ELSE 'SYSCALL' END, "
            "' msg=audit(1700000000.123:', floor(event_id / 2), '): auid=', user_id)")
    return endpoint.audit_rollups(ln.parse_audit_records(lines(spark, sf, text)))


@query("src_zeek_tsv", f"""WITH {E} SELECT '1.1.1.' || k AS src, CAST(event_id AS VARCHAR) AS ts,
CASE WHEN k % 2 = 0 THEN 'tcp' ELSE '' END AS proto FROM e""")
def src_zeek_tsv(spark, sf):
    """Four files in splits of 250 lines; the order of columns changes every 100, one uses commas."""
    order = F.floor(F.col("event_id") / 100)
    comma = F.col("f") == 3
    rows = events(spark, sf).withColumn("f", F.col("user_id") % 4)
    heads = rows.select(order.alias("o")).distinct().withColumn(
        "f", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    fields = F.when(F.col("o") % 2 == 0, "#fields\tts\tid.orig_h\tproto").otherwise(
        "#fields\tid.orig_h\tproto\tts")
    heads = heads.select("f", F.col("o").alias("o"), (200 * F.col("o")).alias("line"), fields.alias(
        "value")).unionByName(heads.filter(comma).groupBy("f").agg(F.min("o").alias("o")).select(
            "f", "o", (200 * F.col("o") - 1).alias("line"), F.lit("#separator \\x2c").alias("value")))
    proto = F.when(F.col("k") % 2 == 0, "tcp").otherwise("")
    src = F.concat(F.lit("1.1.1."), "k")
    body = rows.select("f", order.alias("o"), (2 * F.col("event_id") + 1).alias("line"), F.when(
        order % 2 == 0, F.concat_ws("\t", "event_id", src, F.nullif(proto, F.lit("")))).otherwise(
        F.concat_ws("\t", src, proto, "event_id")).alias("value"))
    table = heads.unionByName(body)
    return ln.parse_zeek(table.select(
        F.concat(F.lit("file"), "f").alias("path"), F.floor(F.greatest("line", F.lit(0)) / 500).alias(
            "block"), "line", F.when(comma & ~F.col("value").startswith("#sep"), F.translate(
                "value", "\t", ",")).otherwise(F.col("value")).alias("value"))).select(
        F.element_at("row", "id.orig_h").alias("src"), F.element_at("row", "ts").alias("ts"),
        F.element_at("row", "proto").alias("proto"))


@query("src_w3c", f"""WITH {E} SELECT '10.1.1.' || k AS src, '/p' || event_id AS path,
CASE WHEN event_id % 2 = 0 THEN '200' ELSE '' END AS status FROM e""")
def src_w3c(spark, sf):
    text = ("concat('#Software: x\n#Fields: c-ip cs-uri-stem sc-status\n10.1.1.', k, ' /p', event_id,"
            " ' 200\n')")
    other = "concat('#Fields: cs-uri-stem c-ip\n/p', event_id, ' 10.1.1.', k, '\n')"
    value = f"CASE WHEN event_id % 2 = 0 THEN {text} ELSE {other} END"
    files = lines(spark, sf, value, "event_id", "CAST(user_id AS STRING) AS path")
    rows = ln.parse_w3c(files.select(
        "path", F.floor(F.col("event_id") / 700).alias("block"), "event_id",
        F.posexplode(F.split("value", "\n")).alias("line", "value")).withColumn(
        "line", F.col("event_id") * 10 + F.col("line")).drop("event_id"))
    return ln.web_rows(rows).select("src", "path", "status")


@query("src_vpc_flow", f"""WITH {E} SELECT '10.0.0.' || k AS src, '8.8.8.8' AS dst,
CAST(443 AS INT) AS dport, k * 7 AS bytes, 'ACCEPT' AS action, {SECOND} AS ts FROM e""")
def src_vpc_flow(spark, sf):
    text = ("concat('2 1 eni 10.0.0.', k, ' 8.8.8.8 5000 443 6 1 ', k * 7, ' 1700000000 ', "
            "unix_timestamp(CAST(ts AS TIMESTAMP)), ' ACCEPT OK')")
    return ln.parse_vpc_flow(lines(spark, sf, text)).select(
        "src", "dst", "dport", "bytes", "action", "ts")


@query("src_netflow", f"""WITH {E} SELECT '10.0.0.' || k AS src, CAST(53 AS INT) AS dport,
'udp' AS proto, k * 2 AS bytes, {SECOND} AS ts FROM e""")
def src_netflow(spark, sf):
    raw = events(spark, sf).select(
        F.concat(F.lit("10.0.0."), "k").alias("sa"), F.lit("8.8.8.8").alias("da"),
        F.lit("1").alias("sp"), F.lit("53").alias("dp"), F.lit("UDP").alias("pr"),
        F.lit("1").alias("ipkt"), (F.col("k") * 2).cast("string").alias("ibyt"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("te"))
    return ln.netflow_rows(raw).select("src", "dport", "proto", "bytes", "ts")


@query("src_bodyfile", f"""WITH {E} SELECT '/f' || event_id AS path, k AS size,
1700000000 + event_id AS mtime FROM e""")
def src_bodyfile(spark, sf):
    text = ("concat('0|/f', event_id, '|1|r/rrw|0|0|', k, '|1700000000|', 1700000000 + event_id, "
            "'|1700000000|1700000000')")
    return ln.parse_bodyfile(lines(spark, sf, text)).select("path", "size", "mtime")


@query("src_histogram", f"""WITH {E} SELECT 'u' || user_id || '@x' AS token, k AS n FROM e""")
def src_histogram(spark, sf):
    return ln.parse_histogram(lines(spark, sf, "concat('n=', k, '\\tu', user_id, '@x')")).select(
        "token", "n")


@query("src_rank_list", """SELECT 'd' || user_id || '.com' AS domain, min(event_id) AS rank
FROM events GROUP BY user_id""")
def src_rank_list(spark, sf):
    raw = events(spark, sf).select(F.col("event_id").cast("string").alias("rank"),
                                   F.concat(F.lit("D"), "user_id", F.lit(".com.")).alias("domain"))
    return ln.rank_list(raw)


@query("src_passive_dns", sql("dns", """SELECT DISTINCT '203.0.113.' || user_id % 50 AS ip,
'n' || user_id AS name FROM events WHERE user_id % 50 < 50 AND EXISTS (SELECT 1 FROM dns
WHERE starts_with(answers, '203.0.113.' || user_id % 50 || ','))"""))
def src_passive_dns(spark, sf):
    raw = events(spark, sf).select(F.concat(F.lit("203.0.113."), F.col("user_id") % 50).alias("ip"),
                                   F.concat(F.lit("N"), "user_id").alias("name"))
    want = adapter(spark, sf, "dns").select(F.split_part("answers", F.lit(","), F.lit(1)).alias(
        "ip"))
    return ln.passive_dns(raw, want)


@query("src_evtx_csv", f"""WITH {E} SELECT event_id AS record, CAST(4600 + k AS INT) AS event_id,
'v' || k AS p1, {SECOND} AS ts FROM e WHERE k % 10 <> 0""")
def src_evtx_csv(spark, sf):
    raw = events(spark, sf).select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("TimeCreated"),
        F.when(F.col("k") % 10 == 0, "x").otherwise((F.col("k") + 4600).cast("string")).alias(
            "EventId"), F.lit("Security").alias("Channel"), F.lit("pc").alias("Computer"),
        F.concat(F.lit("v"), "k").alias("PayloadData1"),
        F.col("event_id").cast("string").alias("PayloadData2"))
    return ln.evtx_rows(raw).select(
        F.element_at("payload", "PayloadData2").cast("bigint").alias("record"), "event_id",
        F.element_at("payload", "PayloadData1").alias("p1"), "ts")


@query("src_event_xml", f"""WITH {E} SELECT CAST(4600 + k AS INT) AS event_id, 'pc' || user_id
AS computer, 'u' || event_id AS target, {SECOND} AS ts FROM e""")
def src_event_xml(spark, sf):
    text = ("concat('<Event><System><EventID>', 4600 + k, '</EventID><Computer>pc', user_id, "
            f"'</Computer><TimeCreated SystemTime=\"', {ISO}, '\"/></System><EventData>"
            "<Data Name=\"Target\">u', event_id, '</Data></EventData></Event>')")
    return ln.parse_event_xml(lines(spark, sf, text)).select(
        "event_id", "computer", F.element_at("data", "Target").alias("target"), "ts")


@query("src_install_log", f"""WITH {E} SELECT event_id, 'App ' || k AS installed,
{SECOND} + INTERVAL 7 HOUR AS ts FROM e""")
def src_install_log(spark, sf):
    text = ("concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), '-07 mac installd[9]: Installed \"App ', "
            "k, '\" (1.0)')")
    return ln.parse_install_log(lines(spark, sf, text, "event_id")).select(
        "event_id", "installed", "ts")


@query("src_remote_access", f"""WITH {E} SELECT app, direction, count(*) AS n, min(started)
AS first_seen FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'anydesk' ELSE 'teamviewer' END AS app,
'incoming' AS direction, CASE WHEN event_id % 2 = 0 THEN date_trunc('minute', ts)
ELSE {SECOND} END AS started FROM e) GROUP BY ALL""")
def src_remote_access(spark, sf):
    a = "concat('Incoming    ', date_format(ts, 'yyyy-MM-dd'), ', ', date_format(ts, 'HH:mm'), '    User    ', 100000 + user_id)"
    b = ("concat(100000 + user_id, '\\tN\\t', date_format(ts, 'dd-MM-yyyy HH:mm:ss'), '\\t', "
         "date_format(ts, 'dd-MM-yyyy HH:mm:ss'), '\\tu\\tRemoteControl\\t{id}')")
    rows = ln.parse_remote_access(lines(spark, sf, f"CASE WHEN event_id % 2 = 0 THEN {a} ELSE {b} END"))
    return rows.groupBy("app", "direction").agg(F.count("*").alias("n"), F.min("started").alias(
        "first_seen"))


# --- JSON --------------------------------------------------------------------------------------------

@query("src_zeek_json", f"""WITH {E} SELECT event_id AS uid, {SECOND} AS ts, '1.1.1.' || k AS src
FROM e""")
def src_zeek_json(spark, sf):
    text = ("concat('{\"ts\": ', unix_timestamp(CAST(ts AS TIMESTAMP)), '.0, \"uid\": ', event_id, "
            "', \"id.orig_h\": \"1.1.1.', k, '\"}')")
    return js.zeek_rows(lines(spark, sf, text), "ts STRING, uid BIGINT, `id.orig_h` STRING").select(
        "uid", "ts", F.col("`id.orig_h`").alias("src"))


@query("src_ecar", f"""WITH {E} SELECT event_id, 'PROCESS' AS object, 'CREATE' AS action, k AS pid,
'cmd ' || k AS command_line, {SECOND} AS ts FROM e""")
def src_ecar(spark, sf):
    text = ("concat('{\"object\": \"PROCESS\", \"action\": \"CREATE\", \"pid\": ', k, "
            "', \"timestamp_ms\": ', unix_timestamp(CAST(ts AS TIMESTAMP)), '000, \"properties\": "
            "{\"command_line\": \"cmd ', k, '\"}}')")
    return js.ecar_rows(lines(spark, sf, text, "event_id")).select(
        "event_id", "object", "action", "pid", "command_line", "ts")


@query("src_falcon", f"""WITH {E} SELECT event_id, 'ProcessRollup2' AS event, CAST(k AS VARCHAR)
AS pid, 'pc' || user_id AS host FROM e""")
def src_falcon(spark, sf):
    key = "CASE WHEN k % 2 = 0 THEN 'TargetProcessId' ELSE 'RawProcessId' END"
    text = (f"concat('{{\"event_simpleName\": \"ProcessRollup2\", \"', {key}, '\": \"', k, "
            "'\", \"ComputerName\": \"pc', user_id, '\"}')")
    return js.falcon_rows(lines(spark, sf, text, "event_id")).select(
        "event_id", "event", "pid", "host")


@query("src_falco", f"""WITH {E} SELECT event_id, 'r' || k AS rule, 'c' || user_id AS container_id
FROM e WHERE k % 5 <> 0""")
def src_falco(spark, sf):
    good = ("concat('{\"rule\": \"r', k, '\", \"priority\": \"Notice\", \"output_fields\": "
            "{\"container.id\": \"c', user_id, '\"}}')")
    return js.falco_rows(lines(spark, sf, f"CASE WHEN k % 5 = 0 THEN 'broken {{' ELSE {good} END",
                               "event_id")).select("event_id", "rule", "container_id")


@query("src_k8s_audit", f"""WITH {E} SELECT event_id, 'u' || user_id AS "user", 'get' AS verb,
'secrets' AS resource, CAST(200 + k AS INT) AS code FROM e""")
def src_k8s_audit(spark, sf):
    text = ("concat('{\"verb\": \"get\", \"user\": {\"username\": \"u', user_id, '\"}, \"objectRef\": "
            "{\"resource\": \"secrets\"}, \"responseStatus\": {\"code\": ', 200 + k, '}}')")
    return js.k8s_rows(lines(spark, sf, text, "event_id")).select(
        "event_id", "user", "verb", "resource", "code")


@query("src_journal", f"""WITH {E} SELECT event_id, CAST(k % 8 AS INT) AS priority, 'm' || k
AS message, ts FROM e""")
def src_journal(spark, sf):
    text = ("concat('{\"__REALTIME_TIMESTAMP\": \"', unix_micros(CAST(ts AS TIMESTAMP)), "
            "'\", \"PRIORITY\": \"', k % 8, '\", \"MESSAGE\": \"m', k, '\"}')")
    return js.journal_rows(lines(spark, sf, text, "event_id")).select(
        "event_id", "priority", "message", "ts")


@query("src_cloudtrail", f"""WITH {E} SELECT event_id AS file, 'E' || k AS event, 'a' || user_id
AS principal FROM e UNION ALL SELECT event_id, 'X', 'b' FROM e""")
def src_cloudtrail(spark, sf):
    text = ("concat('{\"Records\": [{\"eventName\": \"E', k, '\", \"userIdentity\": {\"arn\": \"a', "
            "user_id, '\"}}, {\"eventName\": \"X\", \"userIdentity\": {\"userName\": \"b\"}}]}')")
    return js.cloudtrail_rows(lines(spark, sf, text, "event_id AS file")).select(
        "file", "event", "principal")


@query("src_cloud_shapes", f"""WITH {E} SELECT 'u' || user_id AS principal, event_type = 'error'
AS failed, count(*) AS n FROM e GROUP BY ALL""")
def src_cloud_shapes(spark, sf):
    one = ("concat('{\"userPrincipalName\": \"U', user_id, '\", \"status\": {\"errorCode\": ', "
           "CASE WHEN event_type = 'error' THEN 50126 ELSE 0 END, '}}')")
    text = (f"CASE k % 4 WHEN 0 THEN {one} WHEN 1 THEN concat('[', {one}, ']') WHEN 2 THEN "
            f"concat('{{\"value\": [', {one}, ']}}') ELSE concat('{{\"records\": [', {one}, ']}}') END")
    return js.signin_rows(js.cloud_records(lines(spark, sf, text))).groupBy(
        "principal", "failed").agg(F.count("*").alias("n"))


@query("src_ual", f"""WITH {E} SELECT 'u' || user_id AS "user", 'New-InboxRule' AS operation,
'x' || k AS forward, count(*) AS n FROM e GROUP BY ALL""")
def src_ual(spark, sf):
    audit = "'{\\\\\"Parameters\\\\\": [{\\\\\"Name\\\\\": \\\\\"ForwardTo\\\\\", \\\\\"Value\\\\\": \\\\\"x', k, '\\\\\"}]}'"
    text = (f"concat('{{\"Operation\": \"New-InboxRule\", \"UserId\": \"U', user_id, '\", "
            f"\"AuditData\": \"', {audit}, '\"}}')")
    r = js.ual_rows(js.cloud_records(lines(spark, sf, text)))
    return r.groupBy("user", "operation", F.element_at("params", "forwardto").alias(
        "forward")).agg(F.count("*").alias("n"))


@query("src_stix", """SELECT DISTINCT 'domain' AS ioc_type, regexp_extract(url,
'^https?://([^/]+)', 1) AS value FROM pages""")
def src_stix(spark, sf):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    doc = F.concat(F.lit('{"objects": [{"type": "indicator", "pattern": "[domain-name:value = \''),
                   host, F.lit('\']"}, {"type": "malware", "pattern": "x"}]}'))
    return js.stix_indicators(table(spark, sf, "pages").select(doc.alias("value")))


@query("src_collection_profile", f"""WITH {E} SELECT event_type AS artifact, count(*) AS rows,
min({SECOND}) AS first_seen, max({SECOND}) AS last_seen, CAST(2 AS BIGINT) AS columns FROM e
GROUP BY event_type""")
def src_collection_profile(spark, sf):
    text = f"concat('{{\"Timestamp\": \"', {ISO}, '\", \"k\": ', k, '}}')"
    return sf_.collection_profile(lines(spark, sf, text, "event_type AS artifact"))


@query("src_router", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'asa' WHEN 1 THEN 'w3c' WHEN 2
THEN 'cloudtrail' END AS kind FROM pages""")
def src_router(spark, sf):
    m = F.col("page_id") % 4
    path = F.when(m == 0, "/x/fw.log").when(m == 1, "/x/access_1.log").otherwise("/x/a.json")
    head = (F.when(m == 0, "a %ASA-4-1: b").when(m == 1, "#Fields: c-ip").when(
        m == 2, '{"Records": [{"eventName": "x"}]}').otherwise("nothing"))
    return table(spark, sf, "pages").select("page_id", sf_.log_kind(path, F.concat(
        head, F.lit("\n"))).alias("kind"))


@query("magic_mismatch", """SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'png' ELSE 'exe' END
AS detected FROM pages WHERE page_id % 4 IN (1, 3)""")
def magic_mismatch(spark, sf):
    from emberlog.operators.files import magic_mismatches
    m = F.col("page_id") % 4
    head = F.unhex(F.when(m <= 1, "89504E470D0A").otherwise("4D5A9000"))
    path = F.concat(F.lit("/f"), "page_id", F.when(m == 0, ".png").when(m == 1, ".jpg").when(
        m == 2, ".dll").otherwise(".pdf"))
    return magic_mismatches(table(spark, sf, "pages").select(
        "page_id", head.alias("head"), path.alias("path"))).select("page_id", "detected")


# --- sinks --------------------------------------------------------------------------------------------

@query("ledger_latest", sql("findings", """SELECT case_id, claim, max(created) AS created FROM findings
GROUP BY ALL"""))
def ledger_latest(spark, sf):
    f = adapter(spark, sf, "findings").select("case_id", "claim", "created")
    return sinks.latest(f, ["case_id", "claim"], "created")


@query("stix_objects", f"""WITH {PAGE_IOCS}, p AS (SELECT ioc_type, value, count(DISTINCT case_id)
AS cases FROM pgs WHERE ioc_type IN ('ipv4', 'ipv6', 'domain', 'url', 'email', 'md5', 'sha1',
'sha256') GROUP BY ALL), h AS (SELECT *, sha1('ns' || ioc_type || ':' || value) AS d FROM p)
SELECT ioc_type, value, 'indicator--' || d[1:8] || '-' || d[9:12] || '-5' || d[14:16] || '-' ||
substr('89ab', instr('0123456789abcdef', d[17:17]) % 4 + CASE WHEN instr('0123456789abcdef',
d[17:17]) % 4 = 0 THEN 4 ELSE 0 END, 1) || d[18:20] || '-' || d[21:32] AS id,
CASE WHEN cases > 1 THEN 'recurring' ELSE 'single-case' END AS label FROM h""")
def stix_objects(spark, sf):
    return sinks.stix_objects(page_iocs(spark, sf), namespace_hex="6E73").select(
        "ioc_type", "value", "id", "label")


@query("execution_events", sql("findings", """
SELECT created AS ts, case_id, 'finding' AS kind, agent AS actor, finding_id AS detail FROM findings
UNION ALL SELECT ts, 'case' || user_id % 24, 'audit', event_type, 'e' || event_id FROM events"""))
def execution_events(spark, sf):
    audit = events(spark, sf).select(
        "ts", F.concat(F.lit("case"), F.col("user_id") % 24).alias("case_id"),
        F.col("event_type").alias("action"), F.concat(F.lit("e"), "event_id").alias("detail"))
    return sinks.execution_events(adapter(spark, sf, "findings"), audit)


@query("traceability", sql("findings", """SELECT case_id, finding_id, agent, tool FROM findings
WHERE tool <> ''"""))
def traceability(spark, sf):
    return sinks.traceability(adapter(spark, sf, "findings"))


# --- windows of the streaming detectors, run as batch ---------------------------------------------------

def streamed(spark, stream):
    """Run a stream over all that its source holds and read what it wrote."""
    path = scratch_path(spark, "stream")
    st.run_to_latest(stream, f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").withColumn(
        "window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_failures", sql("authn", """SELECT date_trunc('day', ts) AS window_start, principal,
count(*) AS failures FROM authn WHERE failed GROUP BY ALL HAVING count(*) >= 2"""))
def stream_failures(spark, sf):
    return streamed(spark, st.windowed_failures(stream_adapter(spark, sf, "authn"), "1 day", minimum=2))


@query("stream_repeats", sql("flows", """SELECT src, dst, dport, date_trunc('day', ts)
AS window_start, count(*) AS flows, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM flows
GROUP BY ALL HAVING count(*) >= 2"""))
def stream_repeats(spark, sf):
    return streamed(spark, st.windowed_repeats(stream_adapter(spark, sf, "flows"), "1 day", minimum=2))


@query("stream_errors", sql("http", """SELECT src, date_trunc('day', ts) AS window_start, count(*)
AS errors FROM http WHERE status LIKE '4%' AND src NOT LIKE '10.%' GROUP BY ALL
HAVING count(*) >= 2"""))
def stream_errors(spark, sf):
    return streamed(spark, st.windowed_errors(stream_adapter(spark, sf, "http"), "1 day", minimum=2))


@query("host_signals", sql("authn http", """
SELECT host, 'scan_recon' AS stage, count(*) AS event_count, count(DISTINCT src) FILTER
(src NOT LIKE '10.%') AS external_ips FROM http WHERE status LIKE '4%' GROUP BY host
HAVING count(*) >= 5 UNION ALL SELECT principal, 'brute_force', count(*), CAST(0 AS BIGINT)
FROM authn WHERE failed GROUP BY principal HAVING count(*) >= 10"""))
def host_signals(spark, sf):
    from emberlog.operators.logs import host_signals as op
    web = adapter(spark, sf, "http").filter(F.col("status").startswith("4"))
    bad = adapter(spark, sf, "authn").filter("failed").withColumn("host", F.col("principal"))
    return op(web, "scan_recon", 5, "src").unionByName(op(bad, "brute_force", 10))
