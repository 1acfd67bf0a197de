"""Fixed values of the cloud, container and endpoint detectors."""

# --- fixed values: directory roles and firewall ports -------------------------------------------
AZURE_ROLES = ["global administrator", "privileged role administrator", "security administrator",
               "user access administrator", "application administrator",
               "cloud application administrator", "privileged authentication administrator"]
OPEN_SOURCES = ["*", "0.0.0.0/0", "any", "internet"]
SENSITIVE_PORTS = "22 3389 5985 5986 1433 3306 5432 27017 6379 9200 *".split()
GCP_ROLES = """
roles/owner roles/editor roles/iam.securityadmin roles/resourcemanager.organizationadmin
roles/resourcemanager.projectiamadmin roles/iam.serviceaccountadmin
roles/iam.serviceaccountkeyadmin roles/iam.serviceaccounttokencreator
""".split()
GCP_PUBLIC = ["allusers", "allauthenticatedusers"]
FORWARD_PARAMS = ["forwardto", "redirectto", "forwardasattachmentto", "sendtorecipients"]
CLOUDTRAIL_EVENTS = """
ConsoleLogin AssumeRole AssumeRoleWithSAML AssumeRoleWithWebIdentity CreateAccessKey
DeleteAccessKey UpdateAccessKey CreateUser DeleteUser AttachUserPolicy AttachRolePolicy
PutUserPolicy PutRolePolicy CreateLoginProfile PutBucketPolicy PutBucketAcl DeleteBucketPolicy
PutObjectAcl PutObject GetObject CreateNetworkAclEntry AuthorizeSecurityGroupIngress
GetCallerIdentity DeactivateMFADevice DeleteMFADevice
""".split()

# --- fixed values: cluster audit --------------------------------------------------------------------
PROBE_PATHS = ["/livez", "/readyz", "/healthz", "/version"]
EXEC_RESOURCES = ["pods/exec", "pods/attach", "pods/portforward"]
RBAC_RESOURCES = ["clusterrolebindings", "rolebindings", "clusterroles", "roles"]
OPERATOR_NAMES = ["operator", "controller", "cert-manager", "prometheus"]
ESCAPE_WORDS = ["container escape", "container drift", "mount on suspicious filesystem",
                "write below /proc", "write below /sys", "load kernel module", "module loaded",
                "unprivileged delegation", "docker.sock", "containerd.sock",
                "host pid namespace", "host network namespace"]
PRIVILEGE_WORDS = ["create privileged pod", "create hostnetwork pod", "create hostpath",
                   "attach to cluster-admin", "exec to pod", "service account", "k8s privileged",
                   "k8s sensitive mount", "k8s rbac", "k8s clusterrolebinding"]
HIGH_PRIORITIES = ["emergency", "alert", "critical", "error"]

# --- fixed values: event-log detectors ------------------------------------------------------------------
BENIGN_SERVICES = ["sc manager", "service control manager", "windows modules installer",
                   "microsoft policy platform", "intel", "nvidia", "dell", "hp ",
                   "vmware tools"]
WMI_NOISE = ["wbem", "msiserver", "defrag", "wmsrv"]
DROP_PLACES = ["\\temp\\", "\\appdata\\", "\\programdata\\"]
RDP_LOGON = ["logontype = 10", "logontype=10", "logontype: 10"]

# --- fixed values: credential dumping --------------------------------------------------------------------
DUMP_MASKS = ["0x1010", "0x1410", "0x1438", "0x143a", "0x1fffff", "0x101010", "0x1410ff",
              "0x143aff"]
LSASS_READERS = """
svchost.exe services.exe smss.exe csrss.exe wininit.exe winlogon.exe lsass.exe msmpeng.exe
mssense.exe securityhealthservice.exe taskhostw.exe runtimebroker.exe searchindexer.exe wermgr.exe
system sysmon.exe sysmon64.exe procexp.exe procexp64.exe taskmgr.exe
""".split()

# --- fixed values: technique probes --------------------------------------------------------------------------
RUN_KEYS = ["\\currentversion\\run", "\\currentversion\\runonce", "\\bootexecute"]
GUARDED_KEYS = ["\\wdigest\\uselogoncredential", "\\safeboot\\alternateshell",
                "\\lsa\\notification packages", "\\windows defender\\disableantispyware",
                "\\windows defender\\real-time protection\\disablerealtimemonitoring",
                "\\system\\currentcontrolset\\services\\termservice\\parameters"]
RUNDLL_BENIGN = ["control_rundll", "bthudtask.exe", "windowsupdateelevatedinstaller",
                 "advapi32.dll,processidletasks", "appwiz.cpl", "ncpa.cpl", "inetcpl.cpl",
                 "main.cpl", "system32\\printui.dll", "shell32.dll,shellexec_rundll"]
ENCODED_FLAGS = [" -enc ", " -e ", " -encodedcommand", "/enc ", " -encoded "]
WEB_PARENTS = ["w3wp.exe", "httpd.exe", "nginx.exe", "tomcat.exe", "tomcat9.exe", "javaw.exe",
               "java.exe", "msexchangehmworker.exe", "msexchangemailboxassistants.exe",
               "umworkerprocess.exe", "crushftpservice.exe", "manageenginedesktopcentral.exe",
               "ws_tomcat.exe", "tomcatw.exe", "phpcgi.exe", "fpm.exe", "splunkd.exe"]
WEB_CHILDREN = ["cmd.exe", "powershell.exe", "pwsh.exe", "wmic.exe", "rundll32.exe",
                "regsvr32.exe", "certutil.exe", "bitsadmin.exe", "nslookup.exe", "net.exe",
                "ipconfig.exe", "whoami.exe", "systeminfo.exe", "tasklist.exe", "hostname.exe"]
SCRIPT_FILES = [".vbs", ".vbe", ".vba", ".js", ".jse", ".wsf", ".hta"]
MSHTA_ARGUMENTS = [".hta", "javascript:", "vbscript:", "http:", "https:"]
RANSOM_EXTENSIONS = [".lockbit", ".conti", ".ryk", ".lock", ".crypt", ".encrypted", ".enc"]
RANSOM_NOTES = ["readme", "decrypt", "ransom"]
DEFENDER_COMMANDS = ["set-mppreference -disablerealtimemonitoring",
                     "set-mppreference -disableioavprotection",
                     "set-mppreference -disablebehaviormonitoring",
                     "add-mppreference -exclusionpath", "stop-service windefend",
                     "stop-service sense", "sc stop windefend", "sc stop sense",
                     "sc config windefend start= disabled", "fltmc unload wdfilter"]

# --- fixed values: programs worth a look in process audit records ---------------------------------------------
WATCHED_PROGRAMS = """
nc ncat netcat socat wget curl tftp powershell pwsh msfconsole msfvenom chattr shred wipe dd
iptables nft ufw useradd usermod passwd auditctl service systemctl base64 xxd python python3 perl
ruby bash sh
""".split()
PENTEST_COMMENT = r"(?i)\b(kali|parrot|backbox|metasploit|msfuser|pentest)\b"

# --- fixed values: memory regions ---------------------------------------------------------------------------------
CREDENTIAL_PROCESSES = ["lsass.exe", "winlogon.exe", "services.exe", "wininit.exe", "csrss.exe",
                        "smss.exe", "lsaiso.exe"]
JIT_PROCESSES = ["chrome.exe", "msedge.exe", "firefox.exe", "w3wp.exe", "java.exe", "dotnet.exe",
                 "powershell.exe", "msmpeng.exe", "searchui.exe", "smartscreen.exe"]

# --- fixed values: packages, markers and places on phones and Unix hosts ----------------------------------------------
FIRST_PARTY_INSTALLERS = ["com.android.vending", "com.android.packageinstaller", ""]
OEM_INSTALLERS = ["asus", "samsung", "xiaomi", "huawei", "oppo", "vivo", "oneplus", "lenovo",
                  "motorola"]
ROOT_MARKERS = {
    "rooted": ["data/adb/magisk.db", "data/adb/modules/"],
    "jailbroken": ["applications/cydia.app", "applications/sileo.app", "applications/zebra.app",
                   "applications/installer.app", "applications/unc0ver.app",
                   "applications/checkra1n.app", "applications/taurine.app", "usr/libexec/cydia",
                   "private/var/lib/apt", "private/var/lib/dpkg", "private/var/jb",
                   "private/var/mobile/library/cydia", "usr/bin/ssh"],
    "messenger": ["com.whatsapp", "org.thoughtcrime.securesms", "org.telegram.messenger",
                  "com.wickr.pro", "org.wickr.pro", "org.session.securesms", "com.discord",
                  "com.viber.voip"],
    "staged_executable": ["/data/local/tmp/"],
    "provisioning_profile": [".mobileconfig", ".mobileprovision"],
}
SUSPICIOUS_PLACES = (r"(?i)(^|[\s\"'=])(/tmp/|/var/tmp/|/dev/shm/|/users/shared/)"
                     r"|\\temp\\|\\appdata\\|\\users\\public\\|\\programdata\\|\\downloads\\")

# --- fixed values: path patterns of file listings (either separator, case does not matter) ----
SEP, PART = r"[/\\]", r"[^/\\\r\n|]"
PATH_PATTERNS = {
    "PSEXEC_SERVICE_ARTIFACT": rf"(?i){SEP}PSEXESVC(?:\.EXE)?\b",
    "PYINSTALLER_TEMP_DIR": rf"(?i){SEP}_MEI\d{{2,8}}{SEP}",
    "SVCHOST_OUTSIDE_SYSTEM32": rf"(?i){SEP}({PART}+){SEP}svchost\.exe(?=[|\s]|$)",
    "LSASS_OUTSIDE_SYSTEM32": rf"(?i){SEP}({PART}+){SEP}lsass\.exe(?=[|\s]|$)",
    "EXE_IN_TEMP": rf"(?i){SEP}(?:Temp|AppData{SEP}Local{SEP}Temp){SEP}{PART}+"
                   r"\.(?:exe|dll|scr|bat|ps1|hta|js|vbs)(?=[|\s]|$)",
    "SCHEDULED_TASK_NONMS": rf"(?i){SEP}Windows{SEP}Tasks{SEP}(?!Microsoft)[A-Za-z0-9_.-]+",
    "MIMIKATZ_NAMED_BINARY": rf"(?i){SEP}(?:mimikatz|sekurlsa|kiwi)(?:[.\-_][a-z0-9]+)?"
                             r"\.(?:exe|dll|kirbi)\b",
    "RECYCLE_BIN_EXE": rf"(?i){SEP}\$Recycle\.Bin{SEP}{PART}+\.(?:exe|dll|scr|bat)\b",
    "VSSADMIN_DELETE_SHADOWS_TRACE":
        r"(?i)(?:vssadmin(?:\.exe)?\s+delete\s+shadows"
        r"|wbadmin(?:\.exe)?\s+delete\s+(?:catalog|backup|systemstate)"
        r"|shadowcopy[^|\n]{0,40}delete|delete\s+shadows\s*/all)",
    "NTFS_ALTERNATE_DATA_STREAM":
        rf"(?i){SEP}{PART}+\.(?:exe|dll|sys|com|scr|bat|cmd|ps1|vbs|js|jse|wsf|wsh|hta|jar|py|pyc"
        r"|pyw|docx?|xlsx?|pptx?|pdf|rtf|zip|rar|7z|cab|msi):(?!Zone\.Identifier(?:[\s|:]|$))"
        r"[A-Za-z0-9_.\-$]+(?=[\s|]|$)",
    "BITLOCKER_RECOVERY_KEY_FILE": rf"(?i){SEP}BitLocker Recovery Key {PART}*\.txt\b",
    "AESCRYPT_ENCRYPTED_FILE": rf"(?i){SEP}{PART}+\.aes\b",
    "PGP_GPG_KEY_MATERIAL": rf"(?i){SEP}(?:pubring\.(?:kbx|gpg)|secring\.gpg|trustdb\.gpg"
                            rf"|private-keys-v1\.d(?={SEP})|{PART}+\.(?:asc|gpg|pgp))\b",
    "VERACRYPT_TRUECRYPT_CONTAINER": rf"(?i){SEP}{PART}+\.(?:tc|hc)\b",
}
# --- fixed values: where such paths are usual (matched on lower-case paths with slashes) -----------
PROGRAM_FOLDERS = ["system32", "syswow64", "dllcache", "i386", "amd64"]  # as direct parent only
BACKUP_TREES = ["servicepackfiles", "ntservicepackuninstall", "winsxs", "$hf_mig$"]
COMPONENT_FOLDER = r"\.[0-9]{4,5}\.[0-9]+_none_[a-f0-9]{12,}"
INSTALLER_FOLDER = (r"temp/(?:[0-9a-f]{6,}|_is[a-z0-9]+|\{[0-9a-f-]{8,}\}|installer[0-9]*"
                    r"|msi[0-9a-z]{2,}\.tmp)/")
STOCK_TASKS = ["/tasks/desktop.ini", "/tasks/sa.dat"]
UNPACK_MARKERS = ["drive.v2internal.rest.json", "com.google.drive.nativeproxy.json.template",
                  "anaconda-navigator", "conda-meta", "obs-studio", "spyderlib"]

# --- fixed values: places whose files are tested for back-dating, and places of system programs --------
PROGRAM_EXTENSIONS = (r"\.(?:exe|dll|scr|bat|ps1|hta|js|vbs|cmd|com|pif|sys|jsp|aspx?|elf|so)"
                      r"(?=\s|$)")
BACKDATE_PLACES = [
    r"/users/[^/]+/downloads/", r"/inetpub/wwwroot/", r"^/var/www/", r"^/tmp/", r"^/var/tmp/",
    r"^/home/[^/]+/", r"^/root/", r"/windows/temp/.*" + PROGRAM_EXTENSIONS,
    r"/users/[^/]+/appdata/local/temp/[^/]*" + PROGRAM_EXTENSIONS,
    r"/users/[^/]+/appdata/roaming/.*" + PROGRAM_EXTENSIONS,
]
SYSTEM_PROGRAMS = (r"/windows/(?:system32(?:/dllcache)?|servicepackfiles/(?:i386|amd64))"
                   r"/[^/]+\.(?:exe|dll|sys)\b")

# --- fixed values: script families (matched without regard to case) ------------------------------
SCRIPT_FAMILIES = {
    "mimikatz": [r"\binvoke-?mimikatz\b", r"\bsekurlsa\s*::", r"\bkerberos\s*::",
                 r"\blsadump\s*::", r"\bcrypto\s*::", r"\bpth\s*::",
                 r"\bmisc\s*::\s*memssp\b"],
    "amsi_bypass": [r"AmsiUtils\b", r"amsiInitFailed",
                    r"System\.Management\.Automation\.AmsiUtils", r"\bPatchAmsi\b",
                    r"\[Ref\]\.Assembly\.GetType\("],
    "download_cradle": [r"\(New-Object\s+Net\.WebClient\)\.DownloadString\(",
                        r"\(New-Object\s+Net\.WebClient\)\.DownloadFile\(",
                        r"\bIEX\s*\(\s*\(", r"\bIEX\s*\(\s*New-Object\b",
                        r"\bInvoke-Expression\b.*(DownloadString|DownloadFile)",
                        r"\bInvoke-WebRequest\b.*\.Content", r"\bStart-BitsTransfer\b",
                        r"\bcertutil\b.*-urlcache"],
    "encoded_command": [
        r"-(?:EncodedCommand|Enc|E|EncodedArguments)\s+[A-Za-z0-9+/=]{32,}",
        r"\bFromBase64String\s*\("],
    "c2_framework": [r"\bEmpire\b.*Launcher", r"\bCobalt\s*Strike\b", r"\bCovenant\b",
                     r"\bpowersploit\b", r"\bpowerview\b", r"\bpowercat\b",
                     r"\bSharphound\b", r"\bBloodHound\b", r"\bRubeus\b"],
    "persistence": [r"\bRegister-ScheduledTask\b", r"\bNew-ScheduledTaskAction\b",
                    r"\bSet-ItemProperty\b.*CurrentVersion\\Run", r"\bNew-Service\b",
                    r"\bReg\s+add\b.*CurrentVersion\\Run"],
    "obfuscation": [r"(?:`[A-Z]){5,}", r"(?:\"\+\"|\+'){6,}", r"\bchar\](?:\s*\d+){5,}"],
}
