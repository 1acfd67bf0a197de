"""Cloud control planes, mail audit, cluster audit and container alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from emberlog import functions as fn
from emberlog.fixed import detectors as fx
from emberlog.operators.common import explode_rows


def summary(rows: DataFrame, rule: str, by: str, ts: str = "ts") -> DataFrame:
    """Rows of one detector per principal."""
    return rows.groupBy(F.coalesce(F.col(by), F.lit("")).alias("entity")).agg(
        F.count("*").alias("event_count"), F.min(ts).alias("first_seen"),
        F.max(ts).alias("last_seen")).select(
        F.lit(rule).alias("rule_id"), "entity", "event_count", "first_seen", "last_seen")


def _union(parts) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _distinct_burst(rows: DataFrame, rule: str, by: str, value: str, minimum: int) -> DataFrame:
    """Principals that touch many distinct values; values are merged before they are counted."""
    per = rows.groupBy(F.col(by).alias("entity"), value).agg(
        F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return per.groupBy("entity").agg(
        F.count(value).alias("_d"), F.sum("n").alias("event_count"), F.min("a").alias(
            "first_seen"), F.max("b").alias("last_seen")).filter(F.col("_d") >= minimum).select(
        F.lit(rule).alias("rule_id"), "entity", "event_count", "first_seen", "last_seen")


# --- directory activity ---------------------------------------------------------------------------

def azure_hits(rows: DataFrame, min_secrets: int = 10, min_deletes: int = 20) -> DataFrame:
    """Privileged roles, world-open admin ports, bulk secret reads and mass deletes.

    Columns operation, principal, ts, properties (JSON text).
    """
    op = F.lower(F.coalesce("operation", F.lit("")))

    def prop(*names):
        return F.coalesce(*[F.nullif(F.get_json_object("properties", f"$.{n}"), F.lit(""))
                            for n in names])
    role = F.lower(F.coalesce(prop("roleName", "role"), F.lit("")))
    roles = rows.filter((op.contains("roleassignments/write") | op.contains("add member to role"))
                        & ((role == "") | role.isin(fx.AZURE_ROLES)))
    source = F.lower(F.trim(prop("requestBody.sourceAddressPrefix", "requestBody.source",
                                 "properties.sourceAddressPrefix", "properties.source")))
    port = F.trim(prop("requestBody.destinationPortRange", "requestBody.destinationPort",
                       "properties.destinationPortRange", "properties.destinationPort"))
    opened = rows.filter(op.contains("networksecuritygroups/securityrules/write")
                         & source.isin(fx.OPEN_SOURCES) & port.isin(fx.SENSITIVE_PORTS))
    secrets = rows.filter(op.contains("vaults/secrets") & (
        op.contains("/read") | op.contains("get "))).withColumn(
        "secret", prop("id", "resourceName")).filter(F.col("secret").isNotNull())
    deletes = summary(rows.filter(op.contains("/delete")), "resource_mass_delete", "principal"
                      ).filter(F.col("event_count") >= min_deletes)
    return _union([
        summary(roles, "privileged_role_assignment", "principal"),
        summary(opened, "nsg_open_to_world", "principal"),
        _distinct_burst(secrets, "keyvault_bulk_access", "principal", "secret", min_secrets),
        deletes])


def gcp_hits(rows: DataFrame, min_denied: int = 20,
             bucket_methods=("setiampermissions", "updatebucket")) -> DataFrame:
    """Key creation, privileged bindings, denial bursts and buckets opened to everyone.

    Columns method, principal, status_code, ts, request (JSON text).
    """
    method = F.lower(F.coalesce("method", F.lit("")))
    ddl = "struct<policy:struct<bindings:array<struct<role:string,members:array<string>>>>>"
    bindings = F.coalesce(F.from_json("request", ddl)["policy"]["bindings"],
                          F.array().cast("array<struct<role:string,members:array<string>>>"))
    keys = rows.filter(method.contains("serviceaccountkey") & method.contains("create"))
    grants = rows.filter(method.contains("setiampolicy") & F.exists(
        bindings, lambda b: F.lower(b["role"]).isin(fx.GCP_ROLES)))
    denied = summary(rows.filter((F.col("status_code") == 7) & F.col("principal").isNotNull()),
                     "policy_denied_burst", "principal").filter(
        F.col("event_count") >= min_denied)
    public = rows.filter(fn.any_contains(method, bucket_methods) & F.exists(
        bindings, lambda b: F.exists(b["members"], lambda m: F.lower(m).isin(fx.GCP_PUBLIC))))
    return _union([summary(keys, "service_account_key_creation", "principal"),
                   summary(grants, "iam_privileged_grant", "principal"), denied,
                   summary(public, "storage_bucket_public_open", "principal")])


# --- mail audit -------------------------------------------------------------------------------------

def inbox_rule_forwards(rows: DataFrame, tenant_domains=()) -> DataFrame:
    """Mail rules that forward to an address outside the tenant (columns operation, user, params)."""
    texts = F.map_values(F.map_filter("params", lambda k, v: k.isin(fx.FORWARD_PARAMS)))
    found = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(
        t, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}"), F.lit(0))))
    hits = rows.filter(F.lower("operation").isin("new-inboxrule", "set-inboxrule",
                                                 "updateinboxrules")).select(
        "user", "ts", F.explode(F.array_distinct(found)).alias("target"))
    if tenant_domains:
        hits = hits.filter(~fn.mail_domain(F.col("target")).isin(
            [d.lower() for d in tenant_domains]))
    return hits


def mail_audit_hits(rows: DataFrame, min_access: int = 50, min_failures: int = 10) -> DataFrame:
    """Bulk mailbox reads, OAuth consents and failed-login bursts per user."""
    op = F.lower(F.coalesce("operation", F.lit("")))
    bulk = summary(rows.filter(op == "mailitemsaccessed"), "mail_items_accessed_bulk", "user"
                   ).filter(F.col("event_count") >= min_access)
    consent = summary(rows.filter(op.contains("consent to application")), "oauth_consent_grant",
                      "user")
    failed = summary(rows.filter(op == "userloginfailed"), "user_login_failed_burst", "user"
                     ).filter(F.col("event_count") >= min_failures)
    return _union([bulk, consent, failed])


def cloudtrail_summary(rows: DataFrame) -> DataFrame:
    """One row per event name with principals, sources and regions counted exactly."""
    return rows.groupBy("event").agg(
        F.count("*").alias("event_count"), F.count_distinct("principal").alias("principals"),
        F.count_distinct("source").alias("sources"), F.count_distinct("region").alias("regions"),
        F.count_if((F.col("event") == "ConsoleLogin") & (F.col("console_login") == "Failure"))
        .alias("failed_logins")).withColumn(
        "high_value", F.col("event").isin(fx.CLOUDTRAIL_EVENTS))


# --- cluster audit -------------------------------------------------------------------------------------

def full_resource() -> Column:
    return F.when(F.coalesce("subresource", F.lit("")) != "", F.concat_ws(
        "/", "resource", "subresource")).otherwise(F.coalesce("resource", F.lit("")))


def k8s_hits(rows: DataFrame, min_secrets: int = 50, min_rbac: int = 100,
             min_imbalance: float = 0.3, min_forbidden: int = 50,
             provisioning_changes: int = 30) -> DataFrame:
    """The nine cluster audit detectors, one row per rule and user, with confidence."""
    e = rows.withColumn("_res", full_resource())
    uri = F.split_part(F.coalesce("uri", F.lit("")), F.lit("?"), F.lit(1))
    probe = reduce(lambda a, b: a | b, [uri.startswith(p) for p in fx.PROBE_PATHS])
    external = F.exists(F.coalesce("source_ips", F.array().cast("array<string>")),
                        lambda ip: (ip != "") & ~fn.is_private(ip))
    simple = {
        "ANONYMOUS_NON_PROBE": ((F.col("user") == "system:anonymous") & ~probe, "high"),
        "POD_EXEC": (F.col("_res").isin(fx.EXEC_RESOURCES), "high"),
        "CLUSTER_ADMIN_BINDING": ((F.col("_res") == "clusterrolebindings")
                                  & (F.col("verb") == "create")
                                  & (F.col("role") == "cluster-admin"), "high"),
        "IMPERSONATION": (F.col("impersonated").isNotNull(), "high"),
        "SA_TOKEN_CREATE": ((F.col("_res") == "serviceaccounts/token")
                            & F.col("verb").isin("create", "update"), "low"),
        "EXTERNAL_SOURCE_IP": (external, "medium"),
    }
    found = F.filter(F.array(*[F.when(t, F.struct(F.lit(n).alias("rule_id"), F.lit(c).alias(
        "confidence"))) for n, (t, c) in simple.items()]), lambda x: x.isNotNull())
    direct = explode_rows(e, found, "_h").groupBy(
        "_h.rule_id", "_h.confidence", F.coalesce("user", F.lit("")).alias("entity")).agg(
        F.count("*").alias("event_count"))
    named = e.filter(F.coalesce("user", F.lit("")) != "")
    change = F.col("_res").isin(fx.RBAC_RESOURCES) & F.col("verb").isin(
        "create", "update", "patch", "delete")
    rbac = named.filter(change).groupBy("user").agg(
        F.count("*").alias("changes"), F.count_if(F.col("verb") == "delete").alias("deletes"))
    secrets = named.filter((F.col("_res") == "secrets") & F.col("verb").isin(
        "get", "list", "watch")).select("user", F.concat_ws("/", F.coalesce(
            "namespace", F.lit("")), F.coalesce("name", F.lit(""))).alias("k")).distinct().groupBy(
        "user").agg(F.count("*").alias("event_count")).filter(F.col("event_count") >= min_secrets)
    soft = fn.any_contains(F.lower("user"), fx.OPERATOR_NAMES) | (
        F.coalesce("changes", F.lit(0)) >= provisioning_changes)
    bulk = secrets.join(rbac, "user", "left").select(
        F.lit("BULK_SECRET_ACCESS").alias("rule_id"), F.when(soft, "medium").otherwise(
            "high").alias("confidence"), F.col("user").alias("entity"), "event_count")
    tilt = F.abs(F.col("changes") - 2 * F.col("deletes")) / F.col("changes")
    spike = rbac.filter((F.col("changes") >= min_rbac) & (tilt >= min_imbalance)).select(
        F.lit("RBAC_MUTATION_SPIKE").alias("rule_id"), F.lit("medium").alias("confidence"),
        F.col("user").alias("entity"), F.col("changes").alias("event_count"))
    forbidden = named.filter(F.col("code") == 403).groupBy(F.col("user").alias("entity")).agg(
        F.count("*").alias("event_count")).filter(F.col("event_count") >= min_forbidden).select(
        F.lit("FORBIDDEN_SPIKE").alias("rule_id"), F.lit("medium").alias("confidence"),
        "entity", "event_count")
    return _union([direct.select("rule_id", "confidence", "entity", "event_count"), bulk, spike,
                   forbidden])


def falco_summary(rows: DataFrame) -> DataFrame:
    """Alerts per rule and priority with containers, pods and keyword classes."""
    text = F.lower("rule")
    return rows.groupBy("rule", "priority").agg(
        F.count("*").alias("event_count"), F.count_distinct("container_id").alias("containers"),
        F.count_distinct("pod").alias("pods"),
        F.count_if(fn.any_contains(text, fx.ESCAPE_WORDS)).alias("escape_hits"),
        F.count_if(fn.any_contains(text, fx.PRIVILEGE_WORDS)).alias("privilege_hits"),
    ).withColumn("high_priority", F.lower("priority").isin(fx.HIGH_PRIORITIES))


# --- tickets ------------------------------------------------------------------------------------------

def kerberos_hits(rows: DataFrame) -> DataFrame:
    """RC4 service tickets and service tickets for the ticket service itself, per client."""
    tgs = rows.filter(F.upper("request_type") == "TGS")
    service = F.lower(F.coalesce("service", F.lit("")))
    rc4 = tgs.filter(F.lower("cipher").contains("rc4") & ~service.startswith("krbtgt"))
    own = tgs.filter(service.startswith("krbtgt"))
    return _union([summary(rc4, "rc4_tgs", "client"), summary(own, "krbtgt_tgs", "client")])
