"""Findings derived from `events`: the k of an event picks its claim, tags and tools."""

from __future__ import annotations

K = "k"  # number in `props`, added to `events` by the adapters

# claim, tags, agent, confidence, tool, category, severity, techniques
SEEDS = [
    ("malfind flagged 4 regions", "H_PROCESS_INJECTION", "memory_forensicator", "high",
     "vol3-2.20", "", "", "T1055"),
    ("lsass.exe credential-access target read by mimikatz", "H_CREDENTIAL_ACCESS",
     "memory_forensicator", "high", "vol3", "", "", "T1003.001"),
    ("periodic check-in to beacon host over tcp ports: 4444", "H_C2_OR_REVERSE_SHELL",
     "network_analyst", "medium", "zeek", "", "", "T1071"),
    ("winword.exe launched powershell.exe", "H_INITIAL_ACCESS_DOC_MACRO,H_LIVING_OFF_THE_LAND",
     "log_analyst", "medium", "evtxecmd.exe", "", "", "T1566.001"),
    ("vssadmin delete shadows seen", "H_RANSOMWARE", "malware_triage", "high", "capa", "", "",
     "T1490"),
    ("readme ransom note in sample name", "H_IOC_CORROBORATED", "threat_hunter", "low", "yara",
     "", "", ""),
    ("timestomp on 3 files", "H_ANTI_FORENSICS", "disk_forensicator", "medium", "fls", "", "",
     "T1070"),
    ("artifact gone from live disk", "H_SHADOW_COPY_ARTIFACT_DELETED,H_ANTI_FORENSICS",
     "disk_forensicator", "high", "libvshadow", "", "deleted_in_live", "T1070"),
    ("alternate stream on report.docx", "H_NTFS_ADS_PRESENT", "disk_forensicator", "low", "icat",
     "", "", "T1564.004"),
    ("many failed logons 4625 failed_logon_burst", "H_BRUTE_FORCE,H_EID_4625", "log_analyst",
     "medium", "evtxecmd", "", "", "T1110"),
    ("usb staging with robocopy to removable drive", "H_INSIDER_DATA_STAGING",
     "user_activity", "high", "regipy", "", "", "T1052.001"),
    ("display-name/smtp mismatch in mailbox", "H_INSIDER_EMAIL_EXFIL", "email_forensicator",
     "high", "manual", "", "", "T1048.003"),
    ("strain and price words in notes", "H_ILLICIT_ENTERPRISE", "content_scanner", "medium",
     "narcotic_lexicon", "narcotic_lexicon", "", ""),
    ("bc1 btc wallet in history", "H_ILLICIT_ENTERPRISE", "browser_forensicator", "medium",
     "sqlite", "btc_wallet", "", ""),
    ("http_error_heavy masscan traffic", "H_SCAN_RECON", "network_analyst", "medium", "zeek",
     "", "", "T1595"),
    ("createaccesskey and consolelogin (×4) by root", "H_CLOUD_PERSISTENCE",
     "cloud_forensicator", "high", "cloudtrail", "", "", "T1098.001"),
    ("no non-baseline items observed", "H_PAIRED_CAPTURE_CANDIDATE,H_NOT_CLEAN_BASELINE",
     "memory_forensicator", "medium", "vol3", "", "", ""),
    ("no malicious activity, all signatures verified", "", "memory_forensicator", "medium",
     "vol3", "", "", ""),
    ("netscan blocked by symbol mismatch", "H_C2_OR_REVERSE_SHELL", "memory_forensicator",
     "insufficient", "vol3", "", "", ""),
    ("indicator seen in other case since 2020-01-02", "H_APT_ESPIONAGE", "knowledge_lookup",
     "low", "", "", "", "T1071"),
    ("psexec/service_install PSEXESVC 7045", "H_LATERAL_MOVEMENT,H_EID_7045", "lateral_analyst",
     "high", "evtxecmd", "", "", "T1021.002"),
    ("scheduled_task/task_created 4698 at 2023-05-06 07:08:09", "H_EID_4698", "log_analyst",
     "medium", "sigma", "", "", "T1053.005"),
    ("rundll32.exe [T1218.011] run from temp exe_in_temp", "H_LIVING_OFF_THE_LAND",
     "malware_triage", "medium", "capa", "", "", "T1218.011"),
    ("feed indicator matched", "", "threat_feeds", "low", "misp", "", "", ""),
    ("boot sector wiped, luks volume", "H_INSIDER_DEVICE_DESTRUCTION,H_DISK_ENCRYPTED",
     "disk_forensicator", "high", "mmls", "", "", "T1561.002"),
]


def _pick(column: int) -> str:
    whens = " ".join(f"WHEN {i} THEN '{s[column]}'" for i, s in enumerate(SEEDS))
    return f"CASE {K} % {len(SEEDS)} {whens} END"


FINDING_EXPRESSIONS = [
    "concat('F', CAST(event_id AS STRING)) AS finding_id",
    "concat('case', CAST(user_id % 24 AS STRING)) AS case_id",
    "concat('host', CAST(user_id % 24 % 8 AS STRING)) AS host",
    f"{_pick(0)} AS claim",
    f"{_pick(1)} AS tag_text",
    f"split({_pick(1)}, ',') AS tags",
    f"{_pick(2)} AS agent",
    f"{_pick(3)} AS confidence",
    f"{_pick(4)} AS tool",
    f"split({_pick(4)}, ',') AS tools",
    f"split({_pick(5)}, ',') AS categories",
    f"nullif({_pick(6)}, '') AS severity",
    f"split({_pick(7)}, ',') AS techniques",
    "CAST(event_id % 3 AS INT) AS evidence_count",
    f"CASE WHEN {K} % {len(SEEDS)} = 18 THEN '' ELSE concat('s', repeat('x', CAST({K} * 3 AS INT))) END AS summary",
    "CASE WHEN event_id % 4 = 0 THEN '[LOLBIN_CMDLINE_BENIGN_USE] check' ELSE '' END AS notes",
    f"CASE WHEN {K} % 3 = 0 THEN concat('2023-0', CAST({K} % 9 + 1 AS STRING), '-1', "
    f"CAST({K} % 10 AS STRING), ' 04:05:06') END AS fact_time",
    "ts AS created",
]
