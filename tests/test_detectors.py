from datetime import datetime, timedelta

from pyspark.sql import functions as F

from emberlog.operators import cloud, endpoint, joins

T0 = datetime(2024, 1, 1)


def k8s(spark, rows):
    return spark.createDataFrame(
        rows, "user STRING, verb STRING, resource STRING, subresource STRING, namespace STRING, "
        "name STRING, uri STRING, role STRING, impersonated STRING, code INT, source_ips ARRAY<STRING>")


def row(user="dev", verb="get", resource="pods", sub=None, name="n", uri="/api", role=None,
        imp=None, code=200, ips=("10.0.0.1",)):
    return (user, verb, resource, sub, "ns", name, uri, role, imp, code, list(ips))


def test_cluster_thresholds_and_confidence(spark):
    rows = ([row("dev", name=f"s{i}", resource="secrets") for i in range(50)]
            + [row("few", name=f"s{i}", resource="secrets") for i in range(49)]
            + [row("cert-manager", name=f"s{i}", resource="secrets") for i in range(60)]
            + [row("adm", "create", "roles")] * 70 + [row("adm", "delete", "roles")] * 30
            + [row("bal", "create", "roles")] * 60 + [row("bal", "delete", "roles")] * 40
            + [row("x", code=403)] * 50 + [row("y", code=403)] * 49
            + [row("system:anonymous", uri="/healthz?a"), row("system:anonymous")]
            + [row("z", ips=("8.8.8.8",)), (None,) * 11])
    got = {(r.rule_id, r.entity): r.confidence for r in cloud.k8s_hits(k8s(spark, rows)).collect()}
    assert got[("BULK_SECRET_ACCESS", "dev")] == "high"
    assert got[("BULK_SECRET_ACCESS", "cert-manager")] == "medium"
    assert ("BULK_SECRET_ACCESS", "few") not in got
    assert ("RBAC_MUTATION_SPIKE", "adm") in got and ("RBAC_MUTATION_SPIKE", "bal") not in got
    assert ("FORBIDDEN_SPIKE", "x") in got and ("FORBIDDEN_SPIKE", "y") not in got
    assert ("EXTERNAL_SOURCE_IP", "z") in got
    assert ("ANONYMOUS_NON_PROBE", "system:anonymous") in got


def test_azure_thresholds(spark):
    rows = ([("a", "x/vaults/secrets/read", f'{{"id": "{i}"}}', T0) for i in range(10)]
            + [("b", "x/vaults/secrets/read", f'{{"id": "{i}"}}', T0) for i in range(9)]
            + [("c", "vm/delete", "{}", T0)] * 20 + [("d", "vm/delete", None, T0)] * 19
            + [("e", "Add member to role", '{"role": "Global Administrator"}', T0),
               ("f", "Add member to role", '{"role": "reader"}', T0), (None, None, "bad", None)])
    df = spark.createDataFrame(rows, "principal STRING, operation STRING, properties STRING, "
                               "ts TIMESTAMP")
    got = {(r.rule_id, r.entity) for r in cloud.azure_hits(df).collect()}
    assert got == {("keyvault_bulk_access", "a"), ("resource_mass_delete", "c"),
                   ("privileged_role_assignment", "e")}


def test_inbox_rules(spark):
    df = spark.createDataFrame(
        [("u", T0, "New-InboxRule", {"forwardto": "smtp:a@evil.com", "name": "b@evil.com"}),
         ("u", T0, "New-InboxRule", {"redirectto": "me@corp.com"}), ("v", T0, "Send", {})],
        "user STRING, ts TIMESTAMP, operation STRING, params MAP<STRING, STRING>")
    got = [r.target for r in cloud.inbox_rule_forwards(df, ["corp.com"]).collect()]
    assert got == ["a@evil.com"]


def test_lateral_events(spark):
    rows = [("System", 7045, "PSEXESVC"), ("System", 7045, "Dell Updater"), ("System", 7045, "evil"),
            ("Security", 4624, "LogonType: 10 1.2.3.4"), ("Security", 4624, "LogonType: 3"),
            ("Security", 1102, ""), (None, None, None)]
    df = spark.createDataFrame(rows, "channel STRING, event_id INT, d STRING").withColumns({
        "payload": F.create_map(F.lit("p"), F.col("d")), "map_description": F.lit(None).cast("string"),
        "remote_host": F.lit("-"), "computer": F.lit("pc"), "ts": F.lit(T0)})
    got = sorted((r.technique, r.event_count) for r in endpoint.lateral_summary(df).collect())
    assert got == [("log_cleared", 1), ("psexec/service_install", 1), ("rdp/inbound_session", 1),
                   ("service_install/remote_service", 1)]


def test_technique_probes(spark):
    cols = ("case_id STRING, eid INT, image STRING, parent_image STRING, command_line STRING, target "
            "STRING, source_image STRING, target_image STRING, granted_access STRING")
    rows = [("c", 10, None, None, None, None, "C:\\e.exe", "C:\\lsass.exe", "0x1410"),
            ("c", 10, None, None, None, None, "C:\\svchost.exe", "C:\\lsass.exe", "0x1410"),
            ("c", 1, "C:\\cmd.exe", "C:\\w3wp.exe", "cmd.exe", None, None, None, None),
            ("c", 13, None, None, None, "HKLM\\x\\CurrentVersion\\Run\\a", None, None, None),
            ("n", None, None, None, None, None, None, None, None)]
    got = sorted((r.technique, r.event_count) for r in endpoint.technique_probes(
        spark.createDataFrame(rows, cols)).collect())
    assert got == [("T1003.001", 1), ("T1190", 1), ("T1547.001", 1)]


def test_memory_regions(spark):
    df = spark.createDataFrame([("h", "chrome.exe", "MZ"), ("h", "lsass.exe", "MZ"),
                                ("j", "Chrome.exe", "x")], "host STRING, process STRING, head STRING")
    got = {r.process: r.credential_target for r in endpoint.injected_regions(df).collect()}
    assert got == {"chrome.exe": False, "lsass.exe": True}


def test_process_profile(spark):
    rows = [("h", 4, 0, "System"), ("h", 8, 4, "smss.exe"), ("h", 9, 8, "wininit.exe"),
            ("h", 10, 9, "services.exe"), ("h", 11, 99, "lsass.exe"), ("h", 12, 9, "lsass.exe"),
            ("h", 13, 9, "svchost.exe"), ("h", 14, 10, "svchost.exe"), ("h", 15, 10, "svchost.exe")]
    df = spark.createDataFrame(rows, "host STRING, pid INT, ppid INT, name STRING")
    got = {r.name: r.reason for r in joins.process_profile(df).collect()}
    assert got == {"lsass.exe": "count_high", "svchost.exe": "unexpected_parent"}
    assert [r.pid for r in joins.orphans(df).collect()] == [11]


def test_near_times_and_intervals(spark):
    p = spark.createDataFrame([("d", T0)], "device STRING, t TIMESTAMP")
    fixes = spark.createDataFrame([("d", T0 + timedelta(seconds=s)) for s in (-61, -60, 0, 59, 61)],
                                  "device STRING, at TIMESTAMP")
    got = sorted(r.gap_seconds for r in joins.near_times(p, fixes, "device", "t", "at").collect())
    assert got == [-60.0, 0.0, 59.0]
    spans = spark.createDataFrame(
        [("d", T0 - timedelta(days=40), T0, 1), ("d", T0, T0 + timedelta(1), 2),
         ("d", T0 + timedelta(1), T0 + timedelta(2), 3), ("d", T0 + timedelta(2), T0, 4)],
        "device STRING, a TIMESTAMP, b TIMESTAMP, id INT")
    got = sorted(r.id for r in joins.covering_intervals(p, spans, "device", "t", "a", "b").collect())
    assert got == [1, 2]
