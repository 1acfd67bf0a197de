"""Event-log, process, memory, audit and device detectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from emberlog import functions as fn
from emberlog.fixed import detectors as fx
from emberlog.operators.common import explode_rows, top_list


def _blob() -> Column:
    return F.lower(F.concat_ws(" ", "map_description", F.map_values("payload")))


def _in_channel(part: str, *ids: int) -> Column:
    return F.lower(F.coalesce("channel", F.lit(""))).contains(part) & F.col("event_id").isin(
        list(ids))


LATERAL_TECHNIQUES = {
    "psexec/service_install": ["T1021.002", "T1569.002"],
    "scheduled_task/task_created": ["T1053.005"],
    "service_install/remote_service": ["T1543.003", "T1569.002"],
    "wmi/event_consumer": ["T1546.003"], "wmi/provider_load": ["T1047"],
    "remoting/inbound": ["T1021.006", "T1059.001"], "rdp/inbound_session": ["T1021.001"],
    "log_cleared": ["T1070.001"],
}


def lateral_events(events: DataFrame) -> DataFrame:
    """Events that match a lateral-movement detector, with its name.

    The channel and event id are tested before any payload text.
    """
    relevant = F.col("event_id").isin(7045, 4697, 4698, 106, 5857, 5860, 5861, 91, 4104, 1149,
                                      4624, 1102, 104)
    e = events.filter(relevant).withColumn("_blob", _blob())
    b = F.col("_blob")
    psexec = b.contains("psexesvc") | b.contains("psexec")
    tests = {
        "psexec/service_install": _in_channel("system", 7045) & psexec,
        "scheduled_task/task_created": _in_channel("taskscheduler", 106) | _in_channel(
            "security", 4698),
        "service_install/remote_service": (_in_channel("system", 7045) & ~b.contains("psexesvc")
                                           & ~fn.any_contains(b, fx.BENIGN_SERVICES))
        | _in_channel("security", 4697),
        "wmi/event_consumer": _in_channel("wmi-activity", 5860, 5861),
        "wmi/provider_load": _in_channel("wmi-activity", 5857) & ~fn.any_contains(
            b, fx.WMI_NOISE) & fn.any_contains(b, fx.DROP_PLACES),
        "remoting/inbound": _in_channel("winrm", 91) | (_in_channel(
            "powershell/operational", 4104) & fn.any_contains(
                b, ["enter-pssession", "invoke-command", "new-pssession"])),
        "rdp/inbound_session": _in_channel("remoteconnectionmanager", 1149) | (
            _in_channel("security", 4624) & fn.any_contains(b, fx.RDP_LOGON)),
        "log_cleared": _in_channel("security", 1102) | _in_channel("eventlog", 104),
    }
    found = F.filter(F.array(*[F.when(t, n) for n, t in tests.items()]), lambda x: x.isNotNull())
    ip = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("remote_host", F.lit("")),
                                              r"(\d+\.\d+\.\d+\.\d+)", 1), F.lit("")),
                    F.nullif(F.regexp_extract(b, r"(\d+\.\d+\.\d+\.\d+)", 1), F.lit("")))
    return explode_rows(e, found, "technique").withColumn("source_ip", ip).drop("_blob")


def lateral_summary(events: DataFrame) -> DataFrame:
    """Events per host and detector with the busiest source addresses."""
    hits = lateral_events(events)
    totals = hits.groupBy("computer", "technique").agg(
        F.count("*").alias("event_count"), F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"))
    ips = hits.filter(F.col("source_ip").isNotNull()).groupBy(
        "computer", "technique", "source_ip").agg(F.count("*").alias("n"))
    return totals.join(top_list(ips, ["computer", "technique"], "source_ip", "n", 5),
                       ["computer", "technique"], "left")


# --- process, registry and file events (columns eid, image, parent_image, command_line, target,
# --- source_image, target_image, granted_access) -------------------------------------------------------

def lsass_reads(events: DataFrame, strict: bool = True) -> DataFrame:
    """Reads of the credential process by programs that have no business there."""
    mask = F.lower(F.coalesce("granted_access", F.lit("")))
    ok = mask.isin(fx.DUMP_MASKS) if strict else ~mask.isin("", "0x1000")
    return events.filter((F.col("eid") == 10) & F.lower("target_image").endswith("\\lsass.exe")
                         & ~fn.win_basename(F.col("source_image")).isin(fx.LSASS_READERS) & ok)


def dump_files(events: DataFrame) -> DataFrame:
    t = F.lower(F.coalesce("target", F.lit("")))
    return events.filter((F.col("eid") == 11) & t.contains("lsass") & t.endswith(".dmp"))


def process_search(events: DataFrame, image: str = "", command: str = "") -> DataFrame:
    """Process creations whose image and command line hold the given texts."""
    return events.filter(F.col("eid").isin(1, 4688)
                         & F.lower(F.coalesce("image", F.lit(""))).contains(image.lower())
                         & F.lower(F.coalesce("command_line", F.lit(""))).contains(
                             command.lower()))


def probe_columns() -> dict[str, Column]:
    """One predicate per technique."""
    def low(c):
        return F.lower(F.coalesce(F.col(c), F.lit("")))
    img, cl, target = low("image"), low("command_line"), low("target")
    created = F.col("eid").isin(1, 4688)
    base, pbase = fn.win_basename(img), fn.win_basename(low("parent_image"))
    src, tgt = low("source_image"), low("target_image")

    def ran(*names):
        return created & reduce(lambda a, b: a | b, [img.contains(n) for n in names])

    def said(*words):
        return fn.any_contains(cl, words)
    written, registry = F.col("eid") == 11, F.col("eid") == 13
    lsass = ((F.col("eid") == 10) & tgt.endswith("\\lsass.exe")
             & ~fn.win_basename(src).isin(fx.LSASS_READERS)
             & low("granted_access").isin(fx.DUMP_MASKS))
    bare = created & base.isin("rundll32.exe", "dllhost.exe", "searchprotocolhost.exe") & (
        F.length(F.trim(cl)) <= F.length(base) + 3) & ~pbase.isin(
        "explorer.exe", "services.exe", "svchost.exe", "csrss.exe", "wininit.exe")
    thread = (F.col("eid") == 8) & (src != "") & (tgt != "") & (src != tgt) & ~fn.win_basename(
        src).isin("system", "csrss.exe", "wininit.exe")
    return {
        "T1003.001": lsass | (written & target.contains("lsass") & target.endswith(".dmp")),
        "T1003.003": ran("ntdsutil.exe") | (ran("vssadmin.exe") & said("create shadow"))
        | (written & target.contains("ntds.dit")),
        "T1021.001": ran("mstsc.exe"),
        "T1021.002": created & said("\\admin$", "\\c$", "\\ipc$"),
        "T1021.006": ran("winrs.exe", "wsmprovhost.exe") | (created & said(
            "enter-pssession", "invoke-command")),
        "T1027": ran("powershell") & said(*fx.ENCODED_FLAGS),
        "T1055": thread | bare,
        "T1059.001": ran("powershell.exe", "pwsh.exe"),
        "T1059.003": ran("cmd.exe") & (cl.contains(" /c ") | cl.startswith("cmd /c")),
        "T1059.005": ran("wscript.exe", "cscript.exe") & said(*fx.SCRIPT_FILES),
        "T1112": registry & fn.any_contains(target, fx.GUARDED_KEYS),
        "T1190": created & pbase.isin(fx.WEB_PARENTS) & base.isin(fx.WEB_CHILDREN),
        "T1218.005": ran("mshta.exe") & said(*fx.MSHTA_ARGUMENTS),
        "T1218.011": ran("rundll32.exe") & cl.contains(",") & ~said(*fx.RUNDLL_BENIGN),
        "T1486": (ran("bcdedit") & said("recoveryenabled", "ignoreallfailures"))
        | (ran("manage-bde") & said("-off")) | (written & (reduce(
            lambda a, b: a | b, [target.endswith(x) for x in fx.RANSOM_EXTENSIONS])
            | fn.any_contains(fn.win_basename(target), fx.RANSOM_NOTES))),
        "T1490": (ran("vssadmin") & cl.contains("delete") & cl.contains("shadow"))
        | (ran("wbadmin") & cl.contains("delete") & said("catalog", "systemstatebackup"))
        | (ran("wmic") & cl.contains("shadowcopy") & cl.contains("delete")),
        "T1547.001": registry & fn.any_contains(target, fx.RUN_KEYS),
        "T1562.001": created & said(*fx.DEFENDER_COMMANDS),
    }


def technique_probes(events: DataFrame, by=("case_id",)) -> DataFrame:
    """Techniques with at least one matching event per case, and how many there are."""
    found = F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), n)
                               for n, t in probe_columns().items()]), lambda x: x.isNotNull())
    return explode_rows(events, found, "technique", *by).groupBy(
        *by, "technique").agg(F.count("*").alias("event_count"))


# --- memory regions -----------------------------------------------------------------------------------------

def injected_regions(regions: DataFrame, by=("host",)) -> DataFrame:
    """Flagged regions per process; hosts whose flagged processes all compile code stay silent.

    Columns host, process, pid, head (first bytes as text).
    """
    p = F.lower("process")
    per = regions.groupBy(*by, p.alias("process")).agg(
        F.count("*").alias("regions"), F.count_if(F.col("head").startswith("MZ")).alias(
            "with_header"))
    noisy = per.groupBy(*by).agg(F.bool_and(F.col("process").isin(fx.JIT_PROCESSES)).alias("_jit"))
    return per.join(noisy, list(by)).filter(~F.col("_jit")).withColumn(
        "credential_target", F.col("process").isin(fx.CREDENTIAL_PROCESSES)).drop("_jit")


def unknown_owners(entries: DataFrame) -> DataFrame:
    """Dispatch entries whose owner is not known, per table."""
    owner = F.lower(F.trim(F.coalesce("owner", F.lit(""))))
    return entries.filter(owner.isin("", "unknown", "-")).groupBy("host", "table_name").agg(
        F.count("*").alias("entries"))


# --- audit records, keys, sessions --------------------------------------------------------------------------------

def audit_rollups(records: DataFrame) -> DataFrame:
    """Records per type, audit user and rule key (columns type, fields)."""
    r = records.select("type", F.col("fields").alias("f"))

    def part(kind, column):
        return r.filter(column.isNotNull()).groupBy(F.lit(kind).alias("kind"), column.alias(
            "value")).agg(F.count("*").alias("n"))
    return reduce(lambda a, b: a.unionByName(b), [
        part("type", F.col("type")), part("auid", F.try_element_at("f", F.lit("auid"))),
        part("key", F.try_element_at("f", F.lit("key")))])


def watched_executions(records: DataFrame) -> DataFrame:
    """Execution records of watched programs."""
    r = records.filter(F.col("type") == "EXECVE").select(
        "serial", "ts", F.col("fields").alias("f"))
    program = fn.win_basename(F.try_element_at("f", F.lit("a0")))
    return r.withColumn("program", program).filter(
        F.col("program").isin(fx.WATCHED_PROGRAMS)).select("serial", "ts", "program")


def key_anomalies(keys: DataFrame, min_keys: int = 3) -> DataFrame:
    """Accounts with many authorized keys or a key made on an attack distribution."""
    odd = F.coalesce(F.col("comment").rlike(fx.PENTEST_COMMENT), F.lit(False))
    return keys.groupBy("user").agg(F.count("*").alias("keys"), F.bool_or(odd).alias(
        "odd_comment")).filter((F.col("keys") >= min_keys) | F.col("odd_comment"))


def remote_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions per program and direction with first, last and the busiest peers."""
    per = sessions.groupBy("app", "direction", "peer").agg(
        F.count("*").alias("n"), F.min("started").alias("a"), F.max("started").alias("b"))
    totals = per.groupBy("app", "direction").agg(
        F.sum("n").alias("sessions"), F.count("*").alias("peers"),
        F.min("a").alias("first_seen"), F.max("b").alias("last_seen"))
    return totals.join(top_list(per, ["app", "direction"], "peer", "n", 10), ["app", "direction"])


def sshd_events(rows: DataFrame) -> DataFrame:
    """Accepted, failed and invalid logins of journal messages, and sudo commands."""
    m = F.col("message")
    pattern = (r"(Accepted|Failed) \S+ for (?:invalid user )?(\S+) from (\S+)"
               r"|Invalid user (\S*) from (\S+)")
    sudo = r"^\s*(\S+) : .*COMMAND=(.*)$"
    kind = (F.when(m.rlike(sudo), "sudo").when(m.contains("Accepted "), "accepted")
            .when(m.rlike("Failed \\S+ for"), "failed").when(m.startswith("Invalid user"),
                                                            "invalid"))
    return rows.withColumn("kind", kind).filter(F.col("kind").isNotNull()).withColumns({
        "user": F.coalesce(*[F.nullif(c, F.lit("")) for c in (
            F.when(m.rlike(sudo), F.regexp_extract(m, sudo, 1)),
            F.regexp_extract(m, pattern, 2), F.regexp_extract(m, pattern, 4))]),
        "source": F.coalesce(*[F.nullif(F.regexp_extract(m, pattern, i), F.lit(""))
                               for i in (3, 5)]),
        "command": F.nullif(F.regexp_extract(m, sudo, 2), F.lit(""))})


def suspicious_places(rows: DataFrame, column: str, by: str) -> DataFrame:
    """Persistence or timeline rows whose program lies in a temporary or user-writable place."""
    return rows.filter(F.col(column).rlike(fx.SUSPICIOUS_PLACES)).groupBy(by).agg(
        F.count("*").alias("event_count"), F.min(column).alias("sample"))


def sideloaded(packages: DataFrame, oem=tuple(fx.OEM_INSTALLERS)) -> DataFrame:
    """Packages installed by neither a store nor the maker (columns package, installer).

    A package without an installer came with the system; `oem` are parts of makers' installer names.
    """
    who = F.lower(F.coalesce("installer", F.lit("")))
    kept = packages.filter(~who.isin(fx.FIRST_PARTY_INSTALLERS))
    return kept.filter(~fn.any_contains(who, oem)) if oem else kept


# --- alerts ----------------------------------------------------------------------------------------------------------

def alert_clusters(alerts: DataFrame, k: int = 10) -> DataFrame:
    """Alerts per signature with severity, time range and the busiest sources."""
    key = ["signature_id", "signature"]
    per = alerts.groupBy(*key, "src_ip").agg(
        F.count("*").alias("n"), F.min("severity").alias("s"), F.min("ts").alias("a"),
        F.max("ts").alias("b"))
    totals = per.groupBy(*key).agg(
        F.sum("n").alias("event_count"), F.min("s").alias("severity"), F.count("*").alias(
            "sources"), F.min("a").alias("first_seen"), F.max("b").alias("last_seen"))
    return totals.join(top_list(per, key, "src_ip", "n", k), key)


def device_diagnostics(records: DataFrame) -> DataFrame:
    """Diagnostic records by kind: memory kills, crashes and wakeups per process."""
    kind = F.when(F.col("bug_type") == "298", "memory_kill").when(
        F.col("bug_type").isin("109", "309", "385"), "crash").when(
        F.col("bug_type").isin("142", "144"), "wakeups")
    return records.withColumn("kind", kind).filter(F.col("kind").isNotNull()).groupBy(
        "kind", "process").agg(F.count("*").alias("n"))


def high_signal_logs(rows: DataFrame, subsystems=(), types=("fault", "error")) -> DataFrame:
    """System-log rows of listed subsystems or types, per process."""
    test = F.lower("type").isin([t.lower() for t in types])
    if subsystems:
        test = test | F.col("subsystem").isin(list(subsystems))
    return rows.filter(test).groupBy("process").agg(F.count("*").alias("n"))
