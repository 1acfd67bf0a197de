"""Fixed values of case-level reports: beats, signals, tool ratings and review rules."""

# --- fixed values: story beats --------------------------------------------------------------
BEATS = ["prologue", "trigger", "execution", "persistence", "discovery", "lateral", "collection",
         "command_control", "impact", "aftermath"]

TAG_BEATS = {
    "H_INITIAL_ACCESS_DOC_MACRO": "trigger", "H_INITIAL_ACCESS_WEB": "trigger",
    "H_INITIAL_ACCESS_PHISHING": "trigger", "H_BRUTE_FORCE": "trigger",
    "H_PROCESS_INJECTION": "execution", "H_LIVING_OFF_THE_LAND": "execution",
    "H_PROCESS_HOLLOWING": "execution", "H_PERSISTENCE_SCHEDULED_TASK": "persistence",
    "H_PERSISTENCE_SERVICE": "persistence", "H_PERSISTENCE_AUTORUN": "persistence",
    "H_PERSISTENCE_STARTUP": "persistence", "H_ACCOUNT_CREATED": "persistence",
    "H_CREDENTIAL_ACCESS": "discovery", "H_LATERAL_MOVEMENT": "lateral",
    "H_C2_OR_REVERSE_SHELL": "command_control", "H_BEACONING": "command_control",
    "H_INSIDER_EMAIL_EXFIL": "impact", "H_INSIDER_USB_EXFIL": "impact", "H_CLOUD_EXFIL": "impact",
    "H_RANSOMWARE": "impact", "H_DATA_DESTRUCTION": "impact", "H_APT_ESPIONAGE": "impact",
    "H_OPPORTUNISTIC_COMMODITY": "impact", "H_LOG_CLEARED": "aftermath",
    "H_ANTI_FORENSICS": "aftermath",
}
TACTIC_BEATS = {
    "Initial Access": "trigger", "Execution": "execution", "Persistence": "persistence",
    "Privilege Escalation": "execution", "Defense Evasion": "aftermath",
    "Credential Access": "discovery", "Discovery": "discovery", "Lateral Movement": "lateral",
    "Collection": "collection", "Command and Control": "command_control",
    "Exfiltration": "impact", "Impact": "impact",
}
AGENT_BEATS = [  # part of the agent's name -> beat, first match wins
    ("memory", "execution"), ("network", "command_control"), ("log_analyst", "discovery"),
    ("lateral", "lateral"), ("credential", "discovery"), ("persistence", "persistence"),
    ("autorun", "persistence"), ("cloud", "impact"), ("correlator", "prologue"),
    ("threat_hunter", "execution"), ("malware_triage", "execution"),
]

# --- fixed values: claim signals of the host matrix -----------------------------------------------
CLAIM_SIGNALS = [
    ("malfind regions", ["malfind flagged", "malfind.malfind:"]),
    ("hidden processes", ["hidden processes detected"]),
    ("kernel rootkit", ["hidden kernel driver", "unlinked driver"]),
    ("credential access (lsass)", ["code-injection in credential-access", "mimikatz", "sekurlsa",
                                   "lsass"]),
    ("kerberoasting (RC4)", ["kerberoasting", "rc4-hmac"]),
    ("psexec install", ["psexec/service_install", "psexesvc"]),
    ("rdp inbound", ["rdp/inbound_session"]),
    ("scheduled task persist", ["scheduled_task/task_created", "scheduled_task_nonms"]),
    ("service install (non-PSE)", ["service_install/remote_service"]),
    ("svchost outside system32", ["svchost_outside_system32"]),
    ("pyinstaller dropper", ["pyinstaller_temp_dir"]),
    ("exe in user temp", ["exe_in_temp"]),
    ("zero-size system binary", ["system_binary_zero_size"]),
    ("timestomping", ["system_binary_zero_timestamps"]),
    ("reflective PE inject", ["reflectively-loaded pe"]),
    ("unlinked DLL (ldrmodules)", ["unlinked dll"]),
    ("failed-logon brute burst", ["failed_logon_burst"]),
    ("outlook/mbox EXFIL folder", ["exfil.pst", "exfil folder"]),
    ("consumer-webmail visit", ["consumer-webmail access"]),
    ("BTC wallet exposure", ["bc1", "btc wallet", "bitcoin"]),
]

# --- fixed values: reliability and credibility of tools ----------------------------------------------
TOOL_RATINGS = {
    "vol3": "A1", "volatility3": "A1", "evtxecmd": "A1", "mftecmd": "A1", "amcacheparser": "A1",
    "recmd": "A1", "regipy": "A1", "fls": "A1", "icat": "A1", "mactime": "A1", "mmls": "A1",
    "plaso": "A1", "log2timeline": "A1", "psort": "A1", "ewfinfo": "A1", "ewfverify": "A1",
    "libfsapfs": "A1", "libvshadow": "A1", "libesedb": "A1", "yara": "A2", "yara_hunt": "A2",
    "capa": "A2", "sigma": "A2", "diec": "A2", "detect_it_easy": "A2", "tlsh": "A2", "ssdeep": "A2",
    "iis_w3c": "B2", "webserver_access": "B2", "auditd": "B2", "ausearch": "B2",
    "linux_artifacts": "B2", "linux_triage": "B2", "cloudtrail": "B2", "velociraptor": "B2",
    "zeek": "B2", "misp": "C2", "taxii": "C2", "threat_feeds": "C2", "umbrella_allowlist": "C2",
    "operator": "F3", "manual": "F3",
}
RELIABILITY = "ABCDEFX"
CREDIBILITY = "123456X"

# --- fixed values: words the review rules look for ---------------------------------------------------
OFFICE_PROGRAMS = ["winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe"]
SHELL_PROGRAMS = ["cmd.exe", "powershell.exe"]
CREDENTIAL_TARGETS = ["credential-access target", "lsass.exe", "winlogon.exe", "services.exe",
                      "csrss.exe", "wininit.exe", "smss.exe"]
PROXY_PROGRAMS = ["rundll32.exe", "regsvr32.exe", "mshta.exe", "bitsadmin.exe"]
CONNECTION_WORDS = ["netscan", "connection", "tcp", "udp"]
ATTRIBUTION_WORDS = ["attribut", "identified as", "indicates", "fingerprint",
                     "leading hypothesis", "confirms", "credential-dumping", "process injection",
                     "memory-region attribution"]

# --- fixed values: keys of facts that hold artifact times ------------------------------------------------
TIME_KEYS = """
ts_utc timestamp timestamp_utc create_time create_utc CreateTime last_write_utc last_write
LoadTime Modified modified_utc earliest_ts first_seen_utc mactime_earliest m_earliest
event_time_utc logon_time_utc observed_utc date_utc mtime_utc mtime_latest_utc first_ts_utc
last_ts_utc last_used_start_utc last_seen_utc backup_date_utc earliest_utc latest_utc
""".split()
ADDRESS_KEYS = """
source_ip source_ips src_ip src_ips target_host remote_host smtp_originator_ip x_originating_ip
""".split()
