"""Line-oriented logs.

Every `parse_*` takes a DataFrame of lines (column `value`) and keeps the other columns, so the
same parser serves files, streams and lines that Spark derives. Lines that do not match are left
out. Gzip files are read transparently, one task per file; split very large ones before reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

def read_lines(spark: SparkSession, path, whole_tree: bool = True) -> DataFrame:
    """Lines of text files with the file they come from."""
    return spark.read.option("recursiveFileLookup", str(whole_tree).lower()).text(path).select(
        "value", F.col("_metadata.file_path").alias("path"))


def _cut(pattern: str, names: dict[str, int], value: str = "value"):
    return {n: F.nullif(F.regexp_extract(value, pattern, i), F.lit("")) for n, i in names.items()}


def _parsed(lines: DataFrame, pattern: str, names) -> DataFrame:
    """Rows of the lines that match, one column per named group, null where a group is empty."""
    kept = lines.filter(F.col("value").rlike(pattern))
    return kept.withColumns(_cut(pattern, {n: i for i, n in enumerate(names, 1)}))


SYSLOG_5424 = (r"^<(\d{1,3})>\d+ (\S+) (\S+) (\S+) (\S+) (\S+) "
               r"(?:-|(?:\[[^\]]*\])+)\s*(.*)$")
SYSLOG_3164 = (r"^(?:<(\d{1,3})>)?([A-Z][a-z]{2}\s+\d{1,2} \d{2}:\d{2}:\d{2}) (\S+) "
               r"([^\s:\[]+)(?:\[(\d+)\])?:\s*(.*)$")


def parse_syslog(lines: DataFrame, year: int | None = None) -> DataFrame:
    """RFC 5424 lines, RFC 3164 ones otherwise: facility, severity, host, app, message.

    RFC 3164 times have no year; without `year` their `ts` is null.
    """
    new = F.col("value").rlike(SYSLOG_5424)
    old = F.col("value").rlike(SYSLOG_3164)

    def pick(i, j):
        return F.nullif(F.when(new, F.regexp_extract("value", SYSLOG_5424, i)).otherwise(
            F.regexp_extract("value", SYSLOG_3164, j)), F.lit(""))
    pri = pick(1, 1).try_cast("int")
    short = F.concat_ws(" ", F.lit(year), F.regexp_replace(F.regexp_extract(
        "value", SYSLOG_3164, 2), r"\s+", " "))
    old_ts = F.try_to_timestamp(short, F.lit("yyyy MMM d HH:mm:ss")) if year else None
    return lines.filter(new | old).withColumns({
        "facility": F.floor(pri / 8).cast("int"), "severity": (pri % 8).cast("int"),
        "time_text": pick(2, 2), "ts": F.when(new, F.try_to_timestamp(pick(2, 2))).otherwise(old_ts),
        "host": pick(3, 3), "app": pick(4, 4), "procid": pick(5, 5), "message": pick(7, 6)})


ASA = r"%ASA-(\d)-(\d+):\s*(.*)$"
ASA_PAIR = r"([A-Za-z0-9_.-]+):(\d{1,3}(?:\.\d{1,3}){3})/(\d+)"


def parse_asa(lines: DataFrame) -> DataFrame:
    """Firewall lines: severity, message id, action and the two interface:address/port ends."""
    rows = _parsed(lines, ASA, ["severity", "msg_id", "message"])

    def end(i: int, g: int) -> Column:
        return F.get(F.regexp_extract_all("message", F.lit(ASA_PAIR), F.lit(g)), F.lit(i))
    low = F.lower("message")
    action = (F.when(low.startswith("built"), "Built").when(low.startswith("teardown"), "Teardown")
              .when(low.contains("deny") | low.contains("denied"), "Deny"))
    return rows.withColumns({
        "severity": F.col("severity").cast("int"), "action": action,
        "src_iface": end(0, 1), "src_ip": end(0, 2), "src_port": end(0, 3).try_cast("int"),
        "dst_iface": end(1, 1), "dst_ip": end(1, 2), "dst_port": end(1, 3).try_cast("int"),
        "bytes": F.regexp_extract("message", r"bytes (\d+)", 1).try_cast("bigint")})


SNORT = (r"^(\S+)\s+\[\*\*\]\s+\[(\d+):(\d+):(\d+)\]\s+(.*?)\s+\[\*\*\]\s+"
         r"(?:\[Classification:\s*([^\]]*)\]\s+)?(?:\[Priority:\s*(\d+)\]\s+)?"
         r"\{(\S+)\}\s+(\S+?)(?::(\d+))?\s+->\s+(\S+?)(?::(\d+))?\s*$")


def parse_snort(lines: DataFrame) -> DataFrame:
    """Fast alerts: rule, message, class, priority and five-tuple."""
    rows = _parsed(lines, SNORT, ["time_text", "gid", "sid", "rev", "msg", "classification",
                                  "priority", "proto", "src_ip", "src_port", "dst_ip",
                                  "dst_port"])
    return rows.withColumns({c: F.col(c).cast("int") for c in (
        "gid", "sid", "rev", "priority", "src_port", "dst_port")})


ACCESS = (r"^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+\"([^\"]*)\"\s+(\S+)\s+(\S+)"
          r"(?:\s+\"([^\"]*)\"\s+\"([^\"]*)\")?")


def parse_access(lines: DataFrame) -> DataFrame:
    """Combined or common access log, with the request split into method, path and query."""
    rows = _parsed(lines, ACCESS, ["src", "ident", "user", "time_text", "request", "status",
                                   "bytes", "referer", "user_agent"])
    parts = F.split(F.coalesce("request", F.lit("")), " ")
    whole = F.size(parts) >= 2
    uri = F.when(whole, F.get(parts, F.lit(1))).otherwise("")
    return rows.withColumns({
        "method": F.when(whole, F.get(parts, F.lit(0))).otherwise(""),
        "path_only": F.split_part(uri, F.lit("?"), F.lit(1)),
        "query": F.when(uri.contains("?"), F.regexp_extract(uri, r"\?(.*)$", 1)).otherwise(""),
        "version": F.get(parts, F.lit(2)), "bytes": F.col("bytes").try_cast("bigint"),
        "ts": F.try_to_timestamp("time_text", F.lit("dd/MMM/yyyy:HH:mm:ss Z"))})


AUDIT = r"type=(\S+)\s+msg=audit\((\d+\.\d+):(\d+)\):\s*(.*)$"
AUDIT_FIELD = r"([A-Za-z0-9_-]+)=(\"[^\"]*\"|'[^']*'|\S+)"


def parse_audit_records(lines: DataFrame) -> DataFrame:
    """Audit records one per row: type, serial, time and fields; counts need no grouping."""
    rows = _parsed(lines, AUDIT, ["type", "epoch", "serial", "body"])
    keys = F.regexp_extract_all("body", F.lit(AUDIT_FIELD), F.lit(1))
    values = F.transform(F.regexp_extract_all("body", F.lit(AUDIT_FIELD), F.lit(2)),
                         lambda v: F.regexp_replace(v, "^[\"']|[\"']$", ""))
    pairs = F.array_distinct(keys)
    fields = F.map_from_arrays(pairs, F.transform(pairs, lambda k: F.get(
        values, F.array_position(keys, k).cast("int") - 1)))
    return rows.withColumn("fields", fields).withColumn("ts", F.timestamp_micros((F.col(
        "epoch").cast("decimal(20,6)") * 1_000_000).cast("bigint"))).drop("body", "value")


def parse_auditd(lines: DataFrame, by) -> DataFrame:
    """Records gathered into events by (time, serial); each record has its type and fields.

    `by` names the columns of the host, as serials of several hosts collide; give an empty list for
    the log of one host. Roll-ups work on `parse_audit_records` and gather nothing.
    """
    return parse_audit_records(lines).groupBy(*by, "epoch", "serial").agg(
        F.min("ts").alias("ts"), F.sort_array(F.collect_list(F.struct(
            "type", F.map_entries("fields").alias("fields")))).alias("records"))


HISTOGRAM = r"^n=(\d+)\t(.+?)(?:\t.*)?$"


def parse_histogram(lines: DataFrame) -> DataFrame:
    """Carver histogram lines: value and count; banner lines fall out."""
    return _parsed(lines, HISTOGRAM, ["n", "token"]).withColumn("n", F.col("n").cast("bigint"))


INSTALL = (r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})([+-]\d{2})(?::?\d{2})? (\S+) "
           r"([^\[:]+)(?:\[(\d+)\])?: (.*)$")


def parse_install_log(lines: DataFrame) -> DataFrame:
    """Installer lines with local time plus offset turned to UTC, and the installed product."""
    rows = _parsed(lines, INSTALL, ["local_text", "tz_offset", "host", "process", "pid",
                                    "message"])
    return rows.withColumns({
        "ts": F.try_to_timestamp(F.concat("local_text", "tz_offset", F.lit(":00"))),
        "installed": F.nullif(F.regexp_extract("message", r'Installed "([^"]+)"', 1), F.lit(""))})


ANYDESK = (r"^(Incoming|Outgoing)\s+(\d{4}-\d{2}-\d{2}), (\d{2}:\d{2})\s+(\S+)\s+(\d+)")
TEAMVIEWER = (r"^(\d{6,12})\t([^\t]*)\t(\d{2}-\d{2}-\d{4} \d{2}:\d{2}:\d{2})\t"
              r"(\d{2}-\d{2}-\d{4} \d{2}:\d{2}:\d{2})\t([^\t]*)\t([^\t]*)")


def parse_remote_access(lines: DataFrame) -> DataFrame:
    """Remote-access session lines of two programs as one table."""
    a = _parsed(lines, ANYDESK, ["direction", "day", "minute", "status", "peer"])
    b = _parsed(lines, TEAMVIEWER, ["peer", "peer_name", "begin", "end", "user", "kind"])
    day = F.lit("dd-MM-yyyy HH:mm:ss")
    return a.select(
        F.lit("anydesk").alias("app"), F.lower("direction").alias("direction"), "peer",
        F.try_to_timestamp(F.concat_ws(" ", "day", "minute")).alias("started"),
        F.lit(None).cast("timestamp").alias("ended"), "status").unionByName(b.select(
            F.lit("teamviewer").alias("app"), F.lit("incoming").alias("direction"), "peer",
            F.try_to_timestamp("begin", day).alias("started"),
            F.try_to_timestamp("end", day).alias("ended"), F.col("kind").alias("status")))


# --- self-describing tables --------------------------------------------------------------------

def read_ordered_lines(spark: SparkSession, path) -> DataFrame:
    """Lines with their file, the start of the split they were read from, and their order in it."""
    return spark.read.option("recursiveFileLookup", "true").text(path).select(
        "value", F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"))


def in_force(lines: DataFrame, **headers: Column) -> DataFrame:
    """Adds, per header column, its last value at or before each line of the file.

    Columns path, block and line give the order. Inside a split a window carries values on; what earlier
    splits leave comes from a table of one row per split, so a large file is read by many tasks.
    """
    rows = lines.withColumns({f"_{n}": c for n, c in headers.items()})
    inside = W.partitionBy("path", "block").orderBy("line")
    earlier = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    ends = rows.groupBy("path", "block").agg(*[
        F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.col("line"))).alias(f"_{n}")
        for n in headers])
    carried = ends.select("path", "block", *[
        F.last(f"_{n}", ignorenulls=True).over(earlier).alias(f"_before_{n}") for n in headers])
    return rows.withColumns({f"_{n}": F.last(f"_{n}", ignorenulls=True).over(inside)
                             for n in headers}).join(carried, ["path", "block"]).select(
        *lines.columns, *[F.coalesce(f"_{n}", f"_before_{n}").alias(n) for n in headers])


def _named(rows: DataFrame, names: Column, cells: Column) -> DataFrame:
    """path and a map from names to cells; short rows are padded with empty texts."""
    n = F.size("_names")
    padded = F.slice(F.concat("_cells", F.array_repeat(F.lit(""), n)), F.lit(1), n)
    return rows.withColumns({"_names": names, "_cells": cells}).select(
        "path", F.map_from_arrays("_names", padded).alias("row"))


def read_zeek(spark: SparkSession, path) -> DataFrame:
    """Separated log whose `#fields` lines name the columns; rows come as a map per line."""
    return parse_zeek(read_ordered_lines(spark, path))


def parse_zeek(lines: DataFrame) -> DataFrame:
    """Rows under the `#fields` line and the `#separator` in force; rows before any are left out.

    A separator is written as its code (\\x09) or as itself; without one it is the tab.
    """
    value = F.col("value")
    code = F.regexp_extract(value, r"^#separator \\x([0-9a-fA-F]{2})", 1)
    separator = F.when(value.startswith("#separator "), F.when(code != "", F.chr(F.conv(
        code, 16, 10).cast("bigint"))).otherwise(F.substr(value, F.lit(12))))
    fields = F.when(value.startswith("#fields"), F.substr(value, F.lit(8)))
    rows = in_force(lines, separator=separator, fields=fields).filter(
        ~value.startswith("#") & (F.trim(value) != "") & F.col("fields").isNotNull())
    cut = F.concat(F.lit("\\Q"), F.coalesce("separator", F.lit("\t")), F.lit("\\E"))
    return _named(rows, F.slice(F.split("fields", cut), F.lit(2), F.size(F.split("fields", cut))),
                  F.split(value, cut))


def read_w3c(spark: SparkSession, path) -> DataFrame:
    """Web server log whose `#Fields:` header may change inside one file; a map per line."""
    return parse_w3c(read_ordered_lines(spark, path))


def parse_w3c(lines: DataFrame) -> DataFrame:
    """Rows under the header in force; rows before any are left out."""
    value = F.regexp_replace("value", r"\r$", "")
    rows = in_force(lines.withColumn("value", value), fields=F.when(
        F.col("value").startswith("#Fields:"), F.substr("value", F.lit(9)))).filter(
        ~F.col("value").startswith("#") & (F.col("value") != "") & F.col("fields").isNotNull())
    names = F.transform(F.filter(F.split("fields", " "), lambda n: n != ""),
                        lambda n: F.replace(F.replace(F.lower(n), F.lit("("), F.lit("-")),
                                            F.lit(")"), F.lit("")))
    return _named(rows, names, F.split("value", " "))


def web_rows(table: DataFrame) -> DataFrame:
    """Header-named web rows as the columns the web detectors take."""
    def cell(name):
        return F.coalesce(F.try_element_at("row", F.lit(name)), F.lit(""))
    stamp = F.concat_ws(" ", cell("date"), cell("time"))
    return table.select(
        cell("c-ip").alias("src"), cell("cs-method").alias("method"),
        cell("cs-uri-stem").alias("path"), cell("cs-uri-query").alias("query"),
        cell("sc-status").alias("status"), cell("cs-user-agent").alias("user_agent"),
        F.try_to_timestamp(F.nullif(F.trim(stamp), F.lit(""))).alias("ts"))


# --- separated columns -----------------------------------------------------------------------------

VPC_COLUMNS = ("version account_id interface_id srcaddr dstaddr srcport dstport protocol packets "
               "bytes start end action log_status").split()


def parse_vpc_flow(lines: DataFrame) -> DataFrame:
    """Cloud flow log v2 rows; rows with fewer than 14 columns are dropped."""
    cells = F.split(F.trim("value"), r"\s+")
    rows = lines.withColumn("_c", cells).filter(
        ~F.col("value").startswith("#") & (F.size("_c") >= len(VPC_COLUMNS)))
    c = {n: F.get("_c", F.lit(i)) for i, n in enumerate(VPC_COLUMNS)}
    return rows.select(
        "*", c["srcaddr"].alias("src"), c["dstaddr"].alias("dst"),
        c["srcport"].try_cast("int").alias("sport"), c["dstport"].try_cast("int").alias("dport"),
        c["protocol"].try_cast("int").alias("protocol"),
        c["packets"].try_cast("bigint").alias("packets"),
        c["bytes"].try_cast("bigint").alias("bytes"), c["action"].alias("action"),
        F.timestamp_seconds(c["start"].try_cast("bigint")).alias("started"),
        F.timestamp_seconds(F.coalesce(c["end"], c["start"]).try_cast("bigint")).alias("ts")
    ).drop("_c")


BODY_COLUMNS = "md5 path inode mode uid gid size atime mtime ctime crtime".split()


def parse_bodyfile(lines: DataFrame) -> DataFrame:
    """File listing with 11 pipe-separated columns and four epoch times."""
    rows = lines.withColumn("_c", F.split("value", r"\|")).filter(
        F.size("_c") >= len(BODY_COLUMNS)).drop("path")
    numeric = {"size", "atime", "mtime", "ctime", "crtime"}
    return rows.select("*", *[
        (F.get("_c", F.lit(i)).try_cast("bigint") if n in numeric else F.get("_c", F.lit(i))
         ).alias(n) for i, n in enumerate(BODY_COLUMNS)]).drop("_c", "value")


def read_netflow_csv(spark: SparkSession, path) -> DataFrame:
    """Flow rows of an exported CSV (ts, te, sa, da, sp, dp, pr, ipkt, ibyt)."""
    raw = spark.read.option("header", True).csv(path)
    return netflow_rows(raw)


def netflow_rows(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("sa").alias("src"), F.col("da").alias("dst"),
        F.col("sp").try_cast("int").alias("sport"), F.col("dp").try_cast("int").alias("dport"),
        F.lower("pr").alias("proto"), F.col("ipkt").try_cast("bigint").alias("packets"),
        F.col("ibyt").try_cast("bigint").alias("bytes"), F.try_to_timestamp("ts").alias("ts"),
        F.try_to_timestamp("te").alias("ts_last")).filter(F.col("ts").isNotNull())


def rank_list(raw: DataFrame) -> DataFrame:
    """Popularity ranking: lower-cased domain and its best rank (columns rank, domain as text)."""
    d = F.regexp_replace(F.lower(F.trim("domain")), r"\.+$", "")
    return raw.select(F.col("rank").try_cast("bigint").alias("rank"), d.alias("domain")).filter(
        F.col("rank").isNotNull() & (F.col("domain") != "")).groupBy("domain").agg(
        F.min("rank").alias("rank"))


def read_rank_list(spark: SparkSession, path) -> DataFrame:
    return rank_list(spark.read.schema("rank STRING, domain STRING").csv(path))


def passive_dns(raw: DataFrame, addresses: DataFrame) -> DataFrame:
    """Passive-DNS rows (ip, name) of the wanted addresses, one row per pair."""
    return raw.select(F.trim("ip").alias("ip"), F.lower(F.trim("name")).alias("name")).join(
        addresses.select("ip").distinct(), "ip", "left_semi").filter(F.col("name") != "").distinct()


EVTX_PAYLOADS = [f"PayloadData{i}" for i in range(1, 7)]


def evtx_rows(raw: DataFrame) -> DataFrame:
    """Exported event rows; rows without an integer event id are skipped."""
    have = [c for c in EVTX_PAYLOADS if c in raw.columns]
    payload = F.create_map(*[x for c in have for x in (F.lit(c), F.coalesce(
        F.col(c), F.lit("")))]) if have else F.create_map().cast("map<string,string>")

    def opt(name):
        return F.col(name) if name in raw.columns else F.lit(None).cast("string")
    return raw.select(
        F.try_to_timestamp("TimeCreated").alias("ts"), F.col("EventId").try_cast("int").alias(
            "event_id"), F.col("Channel").alias("channel"), opt("Provider").alias("provider"),
        F.col("Computer").alias("computer"), opt("UserName").alias("user"),
        opt("MapDescription").alias("map_description"), opt("RemoteHost").alias("remote_host"),
        payload.alias("payload")).filter(F.col("event_id").isNotNull())


def read_evtx_csv(spark: SparkSession, path) -> DataFrame:
    return evtx_rows(spark.read.option("header", True).option("multiLine", True).option(
        "escape", '"').csv(path))


EVENT_XML_SCHEMA = (
    "System STRUCT<EventID: STRING, Channel: STRING, Computer: STRING, "
    "TimeCreated: STRUCT<_SystemTime: STRING>, Provider: STRUCT<_Name: STRING>>, "
    "EventData STRUCT<Data: ARRAY<STRUCT<_Name: STRING, _VALUE: STRING>>>")


def read_event_xml(spark: SparkSession, path) -> DataFrame:
    """Exported event XML: id, time, computer, channel and the named data as a map."""
    return _event_rows(spark.read.format("xml").option("rowTag", "Event").schema(
        EVENT_XML_SCHEMA).load(path))


def parse_event_xml(texts: DataFrame) -> DataFrame:
    """The same for one event text per row (column value)."""
    doc = F.from_xml("value", EVENT_XML_SCHEMA)
    return _event_rows(texts.select(doc.alias("_d")).select("_d.*"))


def _event_rows(raw: DataFrame) -> DataFrame:
    named = F.filter(F.coalesce("EventData.Data", F.array().cast(
        "array<struct<_Name:string,_VALUE:string>>")), lambda d: d["_Name"].isNotNull())
    data = F.map_from_entries(F.transform(named, lambda d: F.struct(d["_Name"], d["_VALUE"])))
    return raw.select(
        F.col("System.EventID").try_cast("int").alias("event_id"),
        F.try_to_timestamp("System.TimeCreated._SystemTime").alias("ts"),
        F.col("System.Computer").alias("computer"), F.col("System.Channel").alias("channel"),
        F.col("System.Provider._Name").alias("provider"), data.alias("data"))
