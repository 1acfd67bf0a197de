"""JSON logs. Known layouts get an explicit schema; open ones are read as VARIANT.

The `*_rows` functions take a DataFrame of JSON texts (column `value`), which covers JSONL files,
streams and derived rows; a text that is no JSON is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _typed(lines: DataFrame, ddl: str) -> DataFrame:
    doc = F.from_json("value", ddl, {"mode": "PERMISSIVE"})
    return lines.filter(F.try_parse_json("value").isNotNull()).withColumn("_d", doc).select(
        *[c for c in lines.columns if c != "value"], "_d.*")


def zeek_rows(lines: DataFrame, ddl: str) -> DataFrame:
    """One log type (schema given); `ts` is a float epoch and becomes a timestamp."""
    rows = _typed(lines, ddl)
    return rows.withColumn("ts", F.timestamp_micros(F.round(
        F.col("ts").cast("decimal(20,6)") * 1_000_000).cast("bigint")))


ECAR = ("object STRING, action STRING, timestamp_ms BIGINT, pid BIGINT, ppid BIGINT, "
        "principal STRING, hostname STRING, properties MAP<STRING, STRING>")


def ecar_rows(lines: DataFrame) -> DataFrame:
    """Endpoint events flattened: object, action, command line, flow, registry, target pid."""
    rows = _typed(lines, ECAR)

    def p(name):
        return F.try_element_at("properties", F.lit(name))
    return rows.select(
        *[c for c in lines.columns if c != "value"], "object", "action", "pid", "ppid",
        "principal", F.col("hostname").alias("host"),
        F.timestamp_millis("timestamp_ms").alias("ts"), p("command_line").alias("command_line"),
        p("image_path").alias("image_path"), p("src_ip").alias("src_ip"),
        p("dest_ip").alias("dst_ip"), p("dest_port").try_cast("int").alias("dst_port"),
        p("key").alias("registry_key"), p("target_pid").try_cast("bigint").alias("target_pid"))


FALCON = ("event_simpleName STRING, timestamp STRING, ComputerName STRING, UserName STRING, "
          "ImageFileName STRING, CommandLine STRING, TargetProcessId STRING, "
          "ContextProcessId STRING, ParentProcessId STRING, RawProcessId STRING, "
          "DomainName STRING, RemoteAddressIP4 STRING")


def falcon_rows(lines: DataFrame) -> DataFrame:
    """Endpoint events keyed by their simple name, with the aliases of each field merged."""
    r = _typed(lines, FALCON)
    return r.filter(F.col("event_simpleName").isNotNull()).select(
        *[c for c in lines.columns if c != "value"], F.col("event_simpleName").alias("event"),
        F.timestamp_millis(F.col("timestamp").try_cast("bigint")).alias("ts"),
        F.col("ComputerName").alias("host"), F.col("UserName").alias("user"),
        F.col("ImageFileName").alias("image"), F.col("CommandLine").alias("command_line"),
        F.coalesce("TargetProcessId", "ContextProcessId", "RawProcessId").alias("pid"),
        F.col("ParentProcessId").alias("ppid"), F.col("DomainName").alias("domain"),
        F.col("RemoteAddressIP4").alias("remote_ip"))


FALCO = ("rule STRING, priority STRING, time STRING, output STRING, tags ARRAY<STRING>, "
         "output_fields MAP<STRING, STRING>")


def falco_rows(lines: DataFrame) -> DataFrame:
    """Container alerts with container and pod taken from the output fields."""
    r = _typed(lines, FALCO)

    def f(name):
        return F.try_element_at("output_fields", F.lit(name))
    return r.filter(F.col("rule").isNotNull()).select(
        *[c for c in lines.columns if c != "value"], "rule", "priority",
        F.try_to_timestamp("time").alias("ts"), "output", "tags",
        f("container.id").alias("container_id"), f("k8s.ns.name").alias("namespace"),
        f("k8s.pod.name").alias("pod"), f("proc.cmdline").alias("command_line"))


K8S = ("auditID STRING, verb STRING, requestURI STRING, requestReceivedTimestamp STRING, "
       "user STRUCT<username: STRING>, impersonatedUser STRUCT<username: STRING>, "
       "objectRef STRUCT<resource: STRING, subresource: STRING, namespace: STRING, name: STRING>, "
       "sourceIPs ARRAY<STRING>, responseStatus STRUCT<code: INT>, "
       "requestObject STRUCT<roleRef: STRUCT<name: STRING>>")


def k8s_rows(lines: DataFrame) -> DataFrame:
    """Cluster audit events with the fields the detectors use."""
    r = _typed(lines, K8S)
    return r.filter(F.col("verb").isNotNull()).select(
        *[c for c in lines.columns if c != "value"], F.col("auditID").alias("audit_id"),
        F.lower("verb").alias("verb"), F.col("user.username").alias("user"),
        F.col("impersonatedUser.username").alias("impersonated"),
        F.col("objectRef.resource").alias("resource"),
        F.col("objectRef.subresource").alias("subresource"),
        F.col("objectRef.namespace").alias("namespace"), F.col("objectRef.name").alias("name"),
        F.col("requestURI").alias("uri"), F.col("sourceIPs").alias("source_ips"),
        F.col("responseStatus.code").alias("code"),
        F.col("requestObject.roleRef.name").alias("role"),
        F.try_to_timestamp("requestReceivedTimestamp").alias("ts"))


JOURNAL = ("__REALTIME_TIMESTAMP STRING, PRIORITY STRING, _SYSTEMD_UNIT STRING, "
           "SYSLOG_IDENTIFIER STRING, _PID STRING, _UID STRING, MESSAGE STRING")


def journal_rows(lines: DataFrame) -> DataFrame:
    r = _typed(lines, JOURNAL)
    return r.select(
        *[c for c in lines.columns if c != "value"],
        F.timestamp_micros(F.col("__REALTIME_TIMESTAMP").try_cast("bigint")).alias("ts"),
        F.col("PRIORITY").try_cast("int").alias("priority"),
        F.col("_SYSTEMD_UNIT").alias("unit"), F.col("SYSLOG_IDENTIFIER").alias("identifier"),
        F.col("_PID").try_cast("bigint").alias("pid"), F.col("_UID").try_cast("bigint").alias(
            "uid"), F.col("MESSAGE").alias("message"))


CLOUDTRAIL = ("Records ARRAY<STRUCT<eventTime: STRING, eventName: STRING, eventSource: STRING, "
              "userIdentity: STRUCT<arn: STRING, userName: STRING, type: STRING>, "
              "sourceIPAddress: STRING, awsRegion: STRING, errorCode: STRING, "
              "responseElements: STRUCT<ConsoleLogin: STRING>>>")


def cloudtrail_rows(files: DataFrame) -> DataFrame:
    """Events of `Records[]` documents (one document per row)."""
    doc = F.from_json("value", CLOUDTRAIL)
    return files.select(*[c for c in files.columns if c != "value"], F.explode(
        doc["Records"]).alias("r")).select(
        *[c for c in files.columns if c != "value"],
        F.try_to_timestamp("r.eventTime").alias("ts"), F.col("r.eventName").alias("event"),
        F.coalesce("r.userIdentity.arn", "r.userIdentity.userName").alias("principal"),
        F.col("r.sourceIPAddress").alias("source"), F.col("r.awsRegion").alias("region"),
        F.col("r.errorCode").alias("error"), F.col("r.responseElements.ConsoleLogin").alias(
            "console_login"))


def read_documents(spark: SparkSession, path) -> DataFrame:
    """Whole JSON files (plain or gzip), one per row."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("path"))


WRAPPERS = ["value", "records", "Records", "logs", "items", "entries"]


def cloud_records(files: DataFrame) -> DataFrame:
    """Records of cloud exports in any wrapper: bare array, wrapped array, or one object per text."""
    doc = F.try_parse_json("value")
    kind = F.schema_of_variant(doc)
    arrays = F.coalesce(
        F.when(kind.startswith("ARRAY"), F.try_variant_get(doc, "$", "array<variant>")),
        *[F.try_variant_get(doc, f"$.{w}", "array<variant>") for w in WRAPPERS],
        F.when(kind.startswith("OBJECT"), F.array(doc)))
    return files.filter(doc.isNotNull()).select(
        *[c for c in files.columns if c != "value"], F.explode(arrays).alias("record"))


def field(record: Column, *paths: str, kind: str = "string") -> Column:
    """First of several paths that is present in a record."""
    return F.coalesce(*[F.try_variant_get(record, p, kind) for p in paths])


def signin_rows(records: DataFrame) -> DataFrame:
    """Sign-in records; a record without an error code counts as a success."""
    r = F.col("record")
    code = field(r, "$.status.errorCode", kind="bigint")
    return records.select(
        field(r, "$.id").alias("event_id"),
        F.try_to_timestamp(field(r, "$.createdDateTime", "$.CreationTime")).alias("ts"),
        F.lower(field(r, "$.userPrincipalName", "$.UserId")).alias("principal"),
        field(r, "$.ipAddress").alias("source"), F.coalesce(code != 0, F.lit(False)).alias(
            "failed"),
        F.upper(field(r, "$.location.countryOrRegion")).alias("country"),
        field(r, "$.clientAppUsed").alias("client_app"),
        field(r, "$.riskLevelAggregated").alias("risk_aggregated"),
        field(r, "$.riskLevelDuringSignIn").alias("risk_signin"),
        field(r, "$.riskState").alias("risk_state"))


def ual_rows(records: DataFrame) -> DataFrame:
    """Unified audit records; `AuditData` may be an object or JSON text, parameters become a map."""
    r = F.col("record")
    audit = F.coalesce(F.try_parse_json(F.try_variant_get(r, "$.AuditData", "string")),
                       F.try_variant_get(r, "$.AuditData", "variant"), r)
    params = F.try_variant_get(audit, "$.Parameters", "array<struct<Name:string,Value:string>>")
    clean = F.filter(F.coalesce(params, F.array().cast("array<struct<Name:string,Value:string>>")),
                     lambda p: p["Name"].isNotNull())
    names = F.array_distinct(F.transform(clean, lambda p: F.lower(p["Name"])))
    ip = F.regexp_replace(F.trim(field(r, "$.ClientIP")), r"^\[+", "")
    return records.select(
        F.trim(field(r, "$.Operation")).alias("operation"),
        F.lower(field(r, "$.UserId", "$.UserKey")).alias("user"),
        F.split_part(F.split_part(ip, F.lit("]"), F.lit(1)), F.lit(":"), F.lit(1)).alias("source"),
        F.try_to_timestamp(field(r, "$.CreationTime", "$.CreationDate")).alias("ts"),
        F.map_from_arrays(names, F.transform(names, lambda n: F.get(F.filter(
            clean, lambda p: F.lower(p["Name"]) == n), F.lit(0))["Value"])).alias("params"))


def activity_rows(records: DataFrame) -> DataFrame:
    """Control-plane activity: operation and principal with their alternative places."""
    r = F.col("record")
    claim = "$.identity.claims['http://schemas.xmlsoap.org/ws/2005/05/identity/claims/name']"
    return records.select(
        field(r, "$.operationName.value", "$.operationName.localizedValue",
              "$.operationName").alias("operation"),
        F.lower(field(r, "$.caller", claim, "$.identity.userPrincipalName")).alias("principal"),
        F.try_to_timestamp(field(r, "$.eventTimestamp", "$.time", "$.CreationTime")).alias("ts"),
        field(r, "$.resourceId").alias("resource"), F.to_json(F.try_variant_get(
            r, "$.properties", "variant")).alias("properties"))


def gcp_rows(records: DataFrame) -> DataFrame:
    """Cloud audit entries: method, principal, status, bindings written as JSON text."""
    r = F.col("record")
    return records.select(
        field(r, "$.protoPayload.methodName").alias("method"),
        F.lower(field(r, "$.protoPayload.authenticationInfo.principalEmail")).alias("principal"),
        field(r, "$.protoPayload.status.code", kind="int").alias("status_code"),
        F.try_to_timestamp(field(r, "$.timestamp")).alias("ts"),
        F.to_json(F.try_variant_get(r, "$.protoPayload.request", "variant")).alias("request"))


# --- STIX -------------------------------------------------------------------------------------------

# fixed values: observable types and the pattern that carries each
STIX_PATTERNS = {
    "ipv4": r"ipv4-addr:value\s*=\s*'([^']+)'", "ipv6": r"ipv6-addr:value\s*=\s*'([^']+)'",
    "domain": r"domain-name:value\s*=\s*'([^']+)'", "url": r"url:value\s*=\s*'([^']+)'",
    "email": r"email-addr:value\s*=\s*'([^']+)'",
    "md5": r"file:hashes\.'?MD5'?\s*=\s*'([^']+)'",
    "sha1": r"file:hashes\.'?SHA-1'?\s*=\s*'([^']+)'",
    "sha256": r"file:hashes\.'?SHA-256'?\s*=\s*'([^']+)'",
}


def stix_indicators(files: DataFrame) -> DataFrame:
    """Observable (type, value) pairs of the indicator patterns in bundles or bare lists."""
    doc = F.try_parse_json("value")
    ddl = "array<struct<type:string,pattern:string>>"
    objects = F.coalesce(F.try_variant_get(doc, "$.objects", ddl), F.try_variant_get(doc, "$", ddl))
    pattern = F.col("o.pattern")
    pairs = F.concat(*[F.transform(
        F.regexp_extract_all(pattern, F.lit(p), F.lit(1)),
        _pair(kind)) for kind, p in STIX_PATTERNS.items()])
    return files.select(F.explode(objects).alias("o")).filter(
        F.col("o.type") == "indicator").select(F.explode(pairs).alias("i")).select(
        "i.ioc_type", "i.value").distinct()


def _pair(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("ioc_type"), v.alias("value"))


EVE = ("timestamp STRING, event_type STRING, src_ip STRING, dest_ip STRING, dest_port STRING, "
       "alert STRUCT<signature_id: STRING, signature: STRING, severity: STRING, category: STRING, metadata: "
       "STRUCT<mitre_technique_id: ARRAY<STRING>, mitre_attack_technique_id: ARRAY<STRING>>>, "
       "fileinfo STRUCT<sha256: STRING, filename: STRING, magic: STRING, size: STRING, stored: BOOLEAN>, "
       "http STRUCT<hostname: STRING, http_user_agent: STRING>, "
       "dns STRUCT<type: STRING, query: STRING, rrname: STRING>, tls STRUCT<sni: STRING>, "
       "anomaly STRUCT<event: STRING, type: STRING>")


def eve_rows(lines: DataFrame) -> DataFrame:
    """Events of an intrusion detector, one JSON object per line, parsed once.

    Numbers that some versions write as text are texts here. Lines that are no object are dropped.
    """
    doc = F.from_json("value", EVE + ", _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.withColumn("_d", doc).filter(F.col("value").rlike(r"^\s*\{"))
    known = ["timestamp", "event_type", "src_ip", "dest_ip", "alert", "http", "dns", "tls", "anomaly", "fileinfo"]
    parsed = F.col("_d._bad").isNull()  # it is also set where one field has another type than usual
    for name in known:
        parsed = parsed | F.col(f"_d.{name}").isNotNull()
    out = rows.filter(parsed).select(*[c for c in lines.columns if c != "value"], "_d.*").drop("_bad")
    return out.withColumn("event_type", F.lower(F.coalesce("event_type", F.lit(""))))
