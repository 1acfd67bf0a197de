"""Which tags, rule ids and words point to which technique, and tactics of each."""

# --- fixed values: tactic order and the primary tactic of each technique ----------------------
TACTICS = ["Initial Access", "Execution", "Persistence", "Privilege Escalation",
           "Defense Evasion", "Credential Access", "Discovery", "Lateral Movement", "Collection",
           "Command and Control", "Exfiltration", "Impact"]

TECHNIQUE_TACTICS = {
    "T1078": "Initial Access", "T1078.004": "Initial Access", "T1133": "Initial Access",
    "T1189": "Initial Access", "T1190": "Initial Access", "T1566": "Initial Access",
    "T1566.001": "Initial Access", "T1566.002": "Initial Access", "T1476": "Initial Access",
    "T1047": "Execution", "T1053": "Execution", "T1053.003": "Execution", "T1053.005": "Execution",
    "T1059": "Execution", "T1059.001": "Execution", "T1059.003": "Execution",
    "T1059.004": "Execution", "T1059.005": "Execution", "T1203": "Execution",
    "T1204.002": "Execution", "T1569": "Execution", "T1569.002": "Execution", "T1609": "Execution",
    "T1098": "Persistence", "T1098.001": "Persistence", "T1098.003": "Persistence",
    "T1098.004": "Persistence", "T1098.007": "Persistence", "T1136": "Persistence",
    "T1136.001": "Persistence", "T1197": "Persistence", "T1543": "Persistence",
    "T1543.001": "Persistence", "T1543.003": "Persistence", "T1543.004": "Persistence",
    "T1546.003": "Persistence", "T1547": "Persistence", "T1547.006": "Persistence",
    "T1574.002": "Persistence", "T1574.006": "Persistence", "T1505.003": "Persistence",
    "T1547.001": "Persistence", "T1574": "Persistence", "T1574.001": "Persistence",
    "T1611": "Privilege Escalation", "T1055": "Privilege Escalation",
    "T1055.012": "Privilege Escalation", "T1068": "Privilege Escalation",
    "T1404": "Privilege Escalation", "T1548.002": "Privilege Escalation",
    "T1548.003": "Privilege Escalation", "T1548.006": "Privilege Escalation",
    "T1014": "Defense Evasion", "T1610": "Defense Evasion", "T1027": "Defense Evasion",
    "T1027.002": "Defense Evasion", "T1027.007": "Defense Evasion", "T1112": "Defense Evasion",
    "T1036.005": "Defense Evasion", "T1070": "Defense Evasion", "T1070.001": "Defense Evasion",
    "T1070.003": "Defense Evasion", "T1218": "Defense Evasion", "T1218.005": "Defense Evasion",
    "T1218.010": "Defense Evasion", "T1218.011": "Defense Evasion", "T1444": "Defense Evasion",
    "T1478": "Defense Evasion", "T1556": "Defense Evasion", "T1556.006": "Defense Evasion",
    "T1620": "Defense Evasion", "T1565.001": "Defense Evasion", "T1622": "Defense Evasion",
    "T1562.001": "Defense Evasion", "T1562.007": "Defense Evasion", "T1564.001": "Defense Evasion",
    "T1564.004": "Defense Evasion", "T1564.008": "Defense Evasion", "T1462": "Defense Evasion",
    "T1036": "Defense Evasion", "T1140": "Defense Evasion", "T1497": "Defense Evasion",
    "T1562": "Defense Evasion", "T1003": "Credential Access", "T1003.001": "Credential Access",
    "T1110": "Credential Access", "T1110.001": "Credential Access",
    "T1110.003": "Credential Access", "T1528": "Credential Access",
    "T1552.001": "Credential Access", "T1552.007": "Credential Access",
    "T1555": "Credential Access", "T1555.006": "Credential Access",
    "T1558.001": "Credential Access", "T1558.003": "Credential Access",
    "T1552": "Credential Access", "T1558": "Credential Access", "T1613": "Discovery",
    "T1016": "Discovery", "T1046": "Discovery", "T1087.004": "Discovery", "T1595": "Discovery",
    "T1018": "Discovery", "T1033": "Discovery", "T1057": "Discovery", "T1069": "Discovery",
    "T1082": "Discovery", "T1083": "Discovery", "T1087": "Discovery", "T1135": "Discovery",
    "T1021": "Lateral Movement", "T1021.001": "Lateral Movement", "T1021.002": "Lateral Movement",
    "T1021.004": "Lateral Movement", "T1021.006": "Lateral Movement", "T1534": "Lateral Movement",
    "T1570": "Lateral Movement", "T1550": "Lateral Movement", "T1550.002": "Lateral Movement",
    "T1550.003": "Lateral Movement", "T1039": "Collection", "T1074.001": "Collection",
    "T1114.002": "Collection", "T1114.003": "Collection", "T1005": "Collection",
    "T1056": "Collection", "T1056.001": "Collection", "T1074": "Collection", "T1113": "Collection",
    "T1119": "Collection", "T1213": "Collection", "T1530": "Collection",
    "T1071": "Command and Control", "T1071.001": "Command and Control",
    "T1071.004": "Command and Control", "T1095": "Command and Control",
    "T1105": "Command and Control", "T1219": "Command and Control",
    "T1568.001": "Command and Control", "T1568.002": "Command and Control",
    "T1481": "Command and Control", "T1571": "Command and Control", "T1572": "Command and Control",
    "T1090": "Command and Control", "T1090.003": "Command and Control",
    "T1102": "Command and Control", "T1573": "Command and Control", "T1041": "Exfiltration",
    "T1048.003": "Exfiltration", "T1567": "Exfiltration", "T1048": "Exfiltration",
    "T1052": "Exfiltration", "T1052.001": "Exfiltration", "T1485": "Impact", "T1561": "Impact",
    "T1561.001": "Impact", "T1561.002": "Impact", "T1486": "Impact", "T1489": "Impact",
    "T1490": "Impact", "T1496": "Impact", "T1531": "Impact", "T1537": "Impact",
}

# --- fixed values: techniques named by review rule ids ------------------------------------------
RULE_TECHNIQUES = {
    "OFFICE_SPAWN_SHELL_BENIGN_AUTOMATION": "T1566.001 T1059.001 T1059.003",
    "MALFIND_JIT_FALSE_POSITIVE": "T1055",
    "LOLBIN_CMDLINE_BENIGN_USE": "T1218",
    "NETSCAN_CONNECTION_NEEDS_ENRICHMENT": "T1071",
}

# --- fixed values: techniques named by tags --------------------------------------------------------
TAG_TECHNIQUES = {
    "H_PROCESS_INJECTION": "T1055", "H_PROCESS_HOLLOWING": "T1055.012",
    "H_INITIAL_ACCESS_DOC_MACRO": "T1566.001 T1204.002", "H_LIVING_OFF_THE_LAND": "T1218",
    "H_C2_OR_REVERSE_SHELL": "T1071 T1571", "H_SCAN_RECON": "T1595 T1046",
    "H_CREDENTIAL_ACCESS": "T1003.001 T1003", "H_LATERAL_MOVEMENT": "T1021.002 T1569.002",
    "H_PERSISTENCE_SCHEDULED_TASK": "T1053.005", "H_PERSISTENCE_SERVICE": "T1543.003",
    "H_MAC_LAUNCH_DAEMON_PERSISTENCE": "T1543.001 T1543.004",
    "H_MAC_TCC_BYPASS": "T1548.006 T1556", "H_MAC_FILELESS_AMFI_BYPASS": "T1620 T1027.007",
    "H_MOBILE_SPYWARE_PERSISTENCE": "T1547 T1404", "H_MOBILE_SIDELOADED_APP": "T1476 T1444",
    "H_MOBILE_MDM_ABUSE": "T1481 T1462", "H_CONTAINER_ESCAPE": "T1611 T1610",
    "H_K8S_PRIVILEGE_ESCALATION": "T1078.004 T1098.003 T1613",
    "H_INSIDER_EMAIL_EXFIL": "T1048.003 T1534 T1566.002",
    "H_INSIDER_DEVICE_DESTRUCTION": "T1561.002 T1561.001 T1485",
    "H_EID_4624": "T1078", "H_EID_4625": "T1110", "H_EID_4634": "T1078", "H_EID_4648": "T1078",
    "H_EID_4672": "T1078 T1548.002", "H_EID_4768": "T1558.003", "H_EID_4769": "T1558.003",
    "H_EID_4776": "T1110", "H_EID_4720": "T1136.001", "H_EID_4722": "T1098",
    "H_EID_4725": "T1531", "H_EID_4726": "T1531", "H_EID_4728": "T1098.007",
    "H_EID_4732": "T1098.007", "H_EID_4740": "T1110", "H_EID_4756": "T1098.007",
    "H_EID_4688": "T1059", "H_EID_4698": "T1053.005", "H_EID_4699": "T1053.005 T1070",
    "H_EID_4700": "T1053.005", "H_EID_4701": "T1053.005", "H_EID_4702": "T1053.005",
    "H_EID_4697": "T1543.003", "H_EID_7034": "T1489", "H_EID_7035": "T1569.002",
    "H_EID_7036": "T1569.002", "H_EID_7040": "T1543.003", "H_EID_7045": "T1543.003 T1569.002",
    "H_EID_5140": "T1021.002", "H_EID_5145": "T1021.002", "H_EID_1102": "T1070.001",
    "H_EID_104": "T1070.001", "H_EID_4103": "T1059.001", "H_EID_4104": "T1059.001",
    "H_EID_400": "T1059.001", "H_EID_403": "T1059.001", "H_EID_800": "T1059.001",
    "H_EID_91": "T1021.006", "H_EID_168": "T1021.006", "H_EID_5857": "T1047",
    "H_EID_5860": "T1546.003", "H_EID_5861": "T1546.003", "H_EID_1149": "T1021.001",
    "H_EID_4778": "T1021.001", "H_EID_4779": "T1021.001", "H_EID_21": "T1021.001",
    "H_EID_22": "T1021.001", "H_EID_25": "T1021.001",
}

# --- fixed values: techniques named by words of the claim ---------------------------------------------
CLAIM_TECHNIQUES = [
    (r"(?i)powershell\.exe", "T1059.001"),
    (r"(?i)\bcmd\.exe\b", "T1059.003"),
    (r"(?i)\bwscript\.exe|cscript\.exe\b", "T1059.005"),
    (r"(?i)\bmshta\.exe\b", "T1218.005"),
    (r"(?i)\brundll32\.exe\b", "T1218.011"),
    (r"(?i)\bregsvr32\.exe\b", "T1218.010"),
    (r"(?i)\bbitsadmin\.exe\b", "T1197"),
    (r"(?i)malfind", "T1055"),
    (r"(?i)scheduled[_ ]?task", "T1053.005"),
    (r"(?i)port[s]?:\s*\{?\d", "T1571"),
]
WRITTEN_TECHNIQUE = r"\bT\d{4}(?:\.\d+)?\b"

# --- fixed values: technique sets of known actors -------------------------------------------------------
PLAYBOOKS = {
    "FIN7": "T1566.001 T1204.002 T1059.005 T1218.005 T1055 T1003.001 T1021.002 T1486",
    "APT29": "T1190 T1078.004 T1059.001 T1027 T1003.001 T1021.001 T1021.006 T1567.002",
    "APT28": "T1566.001 T1204.002 T1547.001 T1059.003 T1003.003 T1071.001",
    "Lazarus": "T1566.001 T1059.001 T1027 T1547.001 T1003 T1071.001 T1041",
    "SaltTyphoon": "T1190 T1078 T1021.004 T1136 T1059 T1071.001",
    "Conti": "T1566.001 T1059.001 T1218.011 T1003.001 T1021.002 T1490 T1486",
    "LockBit": "T1566 T1078 T1059.001 T1547.001 T1021.002 T1490 T1486",
}
