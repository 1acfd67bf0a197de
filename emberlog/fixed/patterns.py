"""Patterns and word lists that detectors look for in lines and texts."""

# --- fixed values: shell history families (matched without regard to case) -----------------------
SHELL_FAMILIES = {
    "reverse_shell": [
        r"\bnc(?:\.traditional)?\s+-[a-z]*e\b", r"\bbash\s+-i\s*>\s*/dev/tcp/",
        r"\bmkfifo\s+.*\|\s*bash", r"\bpython3?\s+-c\s+['\"].*socket\b.*\bconnect",
        r"\bperl\s+-e\s+['\"].*socket\b", r"/dev/tcp/\d", r"\bsocat\s+.*exec:"],
    "download_cradle": [
        r"\bwget\s+(?:-\S+\s+)*https?://\d+\.\d+\.\d+\.\d+",
        r"\bcurl\s+(?:-\S+\s+)*https?://\d+\.\d+\.\d+\.\d+",
        r"\bwget\s+(?:-\S+\s+)*\S+.*\|\s*(?:sh|bash)\b",
        r"\bcurl\s+(?:-\S+\s+)*\S+.*\|\s*(?:sh|bash)\b", r"\bwget\s+-[a-z]*O\s*-\s*\|"],
    "base64_pipe": [
        r"\becho\s+['\"]?[A-Za-z0-9+/=]{30,}\s*['\"]?\s*\|\s*base64\s+-d\b",
        r"\bbase64\s+-d.*\|\s*(?:sh|bash)\b", r"`echo\s+[A-Za-z0-9+/=]{30,}.*base64"],
    "persistence_cron": [
        r"\bcrontab\s+-e",
        r"\becho\s+['\"].*\*\s*\*\s*\*\s*\*\s*\*['\"]?\s*>>?\s*/etc/cron",
        r">\s*/etc/cron\.d/"],
    "persistence_ssh": [
        r">>\s*~/\.ssh/authorized_keys", r">>\s*/root/\.ssh/authorized_keys",
        r">\s*/root/\.ssh/authorized_keys",
        r"\b(?:vi|vim|nano|emacs|sublime|code|pico|micro)\s+\S*authorized_keys\b"],
    "defense_evasion": [
        r"\bsystemctl\s+(?:stop|disable)\s+auditd\b", r"\bpkill\s+-9?\s+auditd\b",
        r"\bservice\s+auditd\s+stop\b", r"\bunset\s+HISTFILE\b", r"\bhistory\s+-c\b",
        r"\bchattr\s+\+i\b", r"\bchmod\s+[0-7]*7{3}\s+/tmp\b"],
    "priv_esc": [
        r"\bsudo\s+-s\b", r"\bsudo\s+su\s+-\b", r"/tmp/[\w.-]+\.sh\s*$",
        r"\bchmod\s+[\+0-7]*x\s+/tmp/", r"\bchmod\s+[\+0-7]*x\s+/dev/shm/"],
    "credential_access": [
        r"\bcat\s+/etc/shadow\b", r"\bcat\s+/etc/sudoers\b", r"\bcat\s+~/\.aws/credentials\b",
        r"\bcat\s+~/\.ssh/id_\w+\b", r"\bmimipenguin\b", r"\blazagne\b",
        r"/var/lib/kdc/principal"],
    "concealment_tooling": [
        r"\bhexedit\b", r"\bxxd\s+-r\b", r"\bzip2john\b", r"\bjohn\s+.*\.(?:zip|rar|7z|pdf)\b",
        r"\bhashcat\s+.*\.(?:zip|rar|7z|pdf)\b", r"\b(?:openssl\s+enc|gpg\s+-c)\b",
        r"\bbase32\s+(?:-d|--decode)\b", r"\b(?:rot13|tr\s+['\"]?A-Za-z['\"]?)\b",
        r"\b(?:shred|wipe)\s+.*\w", r"\bchattr\s+\+[aiu]\b", r"\bsteghide\b", r"\boutguess\b",
        r"\bzsteg\b", r"\bexiftool\s+.*\s+-(?:Comment|UserComment)="],
    "cracker_tooling": [
        r"\b10-million-password-list(?:-top-\d+)?\.txt\b", r"\brockyou\.txt\b",
        r"\bSecLists/Passwords\b", r"\bcrackstation\.txt\b", r"\bweakpass\b",
        r"\bhashes\.org\b"],
}
MAC_FAMILIES = {
    "remote_access_screensharing": [
        r"\blaunchctl\s+(?:load|enable|bootstrap)\b.*\b(?:screensharing|ScreenSharing|ARDAgent"
        r"|RemoteDesktop)\b",
        r"\bsystemsetup\s+-setremotelogin\s+on\b",
        r"\bkickstart\s+-(?:activate|configure)\s+-access\b"],
    "tunnel_vnc": [
        r"\bssh\s+(?:-\S+\s+)*-L\s+\d+:[^\s]*:5900\b",
        r"\bssh\s+(?:-\S+\s+)*-L\s+\d+:[^\s]*:3283\b",
        r"\bssh\s+(?:-\S+\s+)*-L\s+\d+:[^\s]*:5988\b",
        r"\bssh\s+(?:-\S+\s+)*-R\s+\d+:[^\s]*:5900\b"],
}
SHELL_PRIORITY = ["reverse_shell", "credential_access", "defense_evasion", "persistence_ssh",
                  "persistence_cron", "download_cradle", "base64_pipe", "priv_esc"]

# --- fixed values: planning words by category ------------------------------------------------------
PLANNING_WORDS = {
    "weapon": [
        "kel-tec sub 2000", "kel-tec sub-2000", "keltec sub 2000", "keltech sub 2000",
        "keltec sxusu2000", "kel-tec sub2k", "fn p90", "fnp90", "fn ps90", "fn 5.7", "fn 5 7",
        "mp40", "mp5", "mp7", "9mm sbr", "9mm rifle", "concealable rifle", "tactical rifle",
        "submachine gun", "foldable kel tec", "foldable kel-tec", "ar-15", "ar 15", "glock 17",
        "glock 19", "ruger", "ghost gun", "p80", "polymer80", "80% lower", "silencer",
        "suppressor"],
    "opsec": [
        "escape route", "no extradition", "non-extradition", "no-extradition",
        "non extradition", "extradition treaty", "smuggle cash", "strap cash",
        "transfer money overseas", "overseas bank account", "press release", "latex gloves",
        "tear away clothing", "tear-away clothing", "velcro tear", "burner phone", "burner sim",
        "tor browser", "vpn", "gun-free zone", "gun free zone", "police response time",
        "police response times", "do the cops track", "do cops track web searches",
        "track web searches", "black market", "shooting range near me",
        "best record of on-time departures"],
    "intent": [
        "lone wolf", "the lone wolf", "manifesto", "the manifesto",
        "i will be the revolutionary", "i will be the history maker", "i will be the change",
        "blood has been shed", "defenseless bodies", "atrocity", "another atrocity",
        "commit atrocity", "fresh start in bali", "fresh start in indonesia", "endless freedom",
        "molon labe", "#molonlabe", "what im doing is just and right",
        "what i'm doing is just and right", "for my country", "for our country",
        "even if i'm killed", "even if i am killed", "100 targets", "hundred targets",
        "operation 2nd hand smoke", "operation second hand smoke"],
    "destination": [
        "bali indonesia", "denpasar", "candidasa", "non extradition countries",
        "non-extradition countries", "best country to flee", "live very well on",
        "live very well in", "9 years on savings", "nine years on savings",
        "ronald reagan washington national", "dulles to bali"],
}
PLANNING_PATTERNS = {
    "ammo": r"(?i)\b(?:\d{2,5}[ \t]{0,4}(?:rounds?|rds?|rd|bullets?|shells?|cartridges?)"
            r"|(?:9[ \t]?mm|5\.7|5\.56|7\.62|\.223|\.308|\.45|\.40)[ \t]{0,4}"
            r"(?:ammo|ammunition|rounds?)|\d{3,4}[ \t]{0,4}for[ \t]{0,4}\$\d{2,4})\b",
}

# --- fixed values: trade words, units, prices and symbols -------------------------------------------
TRADE_WORDS = [
    "acapulco gold", "alaskan thunder", "ak-47", "blue dream", "bubba kush", "chemdawg",
    "cookies", "durban poison", "girl scout cookies", "gorilla glue", "granddaddy purple",
    "green crack", "haze", "jack herer", "kush", "lemon haze", "mexican sativa",
    "northern lights", "og kush", "pineapple express", "purple haze", "sour diesel", "tangie",
    "trainwreck", "white widow", "zkittlez", "molly", "mdma", "ecstasy", "x-pills", "addy",
    "adderall", "ritalin", "tina", "crystal meth", "ice meth", "snow", "blow", "coke rock",
    "yayo", "blues", "percs", "oxy", "oxys", "oxycontin", "fenty", "fent", "china white"]
UNIT_PATTERN = (r"(?i)\b(?:\d+(?:\.\d+)?\s?(?:g|gr|gm|grams?|oz|ounces?|qp|hp|lb|lbs|pounds?|kilo"
                r"|kg|ki)\b|(?:\beighth|quarter|half[- ]?oz|qp|hp)\b)")
PRICE_PATTERN = (r"(?i)\$?\s?\d{1,4}\s?(?:/|per|an?)\s?(?:g\b|gm\b|gr\b|gram[s]?\b|oz\b"
                 r"|ounce[s]?\b|eighth\b|qp\b|hp\b)")
TRADE_SYMBOLS = ["❄", "🍁", "💊", "🌿", "💎", "🔥", "🍫"]

# --- fixed values: malware fingerprints: family -> (pattern, contexts, benign pattern) ----------------
ANY, CODE, SCRIPT = ("memory", "network", "disk", "log"), ("memory",), ("memory", "log")
URLS, NAMES, DISK = ("network", "memory"), ("network", "log"), ("disk",)
ANALYTICS = r"(?i)google-analytics|googletagmanager|doubleclick"
MALWARE_FAMILIES = {
    "mimikatz": [
        (r"(?i)\bmimikatz\b", ANY, None), (r"(?i)\bsekurlsa::", SCRIPT, None),
        (r"(?i)\bkerberos::", SCRIPT, None), (r"(?i)\blsadump::", SCRIPT, None),
        (r"(?i)Benjamin DELPY", CODE, None), (r"(?i)gentilkiwi", CODE, None),
        (r"(?i)\bsekurlsa\b.{0,30}\b(logonpasswords|wdigest|kerberos|tspkg|msv)\b", SCRIPT, None)],
    "lumma_stealer": [
        (r"(?i)\bLummaC2\b", ANY, None), (r"TeslaBrowser/5\.5", URLS, None),
        (r"/api/set_agent\?[^\"\s]{0,300}\btoken=", URLS, None),
        (r"(?i)\bact=(life|recive_message|receive_message)\b", URLS, None),
        (r"/api/set_agent\?[^\"\s]{0,300}\bact=log\b", URLS, None)],
    "cobalt_strike": [
        (r"(?i)\bcobalt[\s_-]?strike\b", ANY, None), (r"/__utm\.gif", URLS, ANALYTICS),
        (r"/dpixel", URLS, None), (r"\bMZARUH\b", CODE, None),
        (r"(?i)\bxor[ _]decode_loop\b", CODE, None),
        (r"(?i)\bbeacon[\s_]post[\s_]request\b", CODE, None)],
    "metasploit_meterpreter": [
        (r"(?i)\bmeterpreter\b", ANY, None), (r"(?i)\bmsf::", SCRIPT, None),
        (r"(?i)\bmetasploit\b", ANY, None), (r"(?i)\bstdapi_\w+", CODE, None),
        (r"(?i)\brailgun\b", CODE, None)],
    "empire_powershell": [
        (r"(?i)\bInvoke-Mimikatz\b", SCRIPT, None), (r"(?i)\bInvoke-Empire\b", SCRIPT, None),
        (r"(?i)\bPowerSploit\b", SCRIPT, None), (r"(?i)\bPowerView\b", SCRIPT, None)],
    "finfisher": [
        (r"(?i)\bmsnetobj\.dll\b", CODE, None),
        (r"\bVM(?:Install|Uninstall)KernelDriver\b", CODE, None),
        (r"\bKernelDriver(?:Install|Uninstall)\b", CODE, None),
        (r"/info\?id=%u", URLS, None), (r"(?i)\bfinspy\b", ANY, None),
        (r"(?i)\bfinfisher\b", ANY, None)],
    "darkcomet_rat": [
        (r"(?i)\bdarkcomet\b", ANY, None), (r"(?i)\bDC_MUTEX-\w+", CODE, None),
        (r"(?i)\b#KCMDDC\d+#", CODE, None)],
    "njrat": [
        (r"(?i)\bnjrat\b", ANY, None), (r"(?i)\bnjq8\b", CODE, None),
        (r"(?i)\bcap\d+!\?\?!", CODE, None)],
    "remcos_rat": [
        (r"(?i)\bremcos\b", ANY, None), (r"(?i)\bBreaking-Security\.Net\b", ANY, None),
        (r"(?i)\bRmc-\w+", CODE, None)],
    "agent_tesla": [
        (r"(?i)\bagent[\s_]?tesla\b", ANY, None), (r"(?i)\{[A-F0-9-]{36}\}\.exe", DISK, None)],
    "hancitor": [
        (r"(?i)/[0-9a-z]{1,4}/forum\.php\b", URLS, None), (r"(?i)/footage\.php\b", URLS, None),
        (r"(?i)\bforum\.php\?[a-z]+=[a-zA-Z0-9_]+&[a-z]+=", URLS, None),
        (r"(?i)/\d{3,4}s?\.bin\b", URLS, None),
        (r"(?i)/location/loca\.asp\b", URLS, None)],
    "trickbot": [
        (r"(?i)\btrickbot\b", ANY, None),
        (r"(?i)/(?:topi|table|chrls|psfin|tabDll)\.[a-z0-9]{3,5}\b", URLS, None),
        (r"(?i)/(?:radminDll|networkDll|wormDll|mailsearcher)\b", URLS, None),
        (r"/[a-z0-9]{3,8}/[A-Z0-9-]+_W[0-9]{6}\.[A-F0-9]{32}/\d+/?", URLS, None)],
    "ip_lookup_chain": [
        (r"(?i)\bcheckip\.amazonaws\.com\b", NAMES, None),
        (r"(?i)\bicanhazip\.com\b", NAMES, None), (r"(?i)\bipinfo\.io\b", NAMES, None),
        (r"(?i)\bapi\.ipify\.org\b", NAMES, None), (r"(?i)\bip-api\.com\b", NAMES, None),
        (r"(?i)\bip\.anysrc\.net\b", NAMES, None), (r"(?i)\bwtfismyip\.com\b", NAMES, None)],
    "qakbot": [
        (r"(?i)\bqakbot\b|\bqbot\b", ANY, None),
        (r"/t(?=[A-Z0-9]*[0-9])(?=[A-Z0-9]*[A-Z])[A-Z0-9]{6,12}/", URLS, None)],
    "icedid_bokbot": [
        (r"(?i)\bicedid\b|\bbokbot\b", ANY, None), (r"\?id=\d{19,}\b", URLS, None)],
    "sliver_c2": [
        (r"(?i)\bsliver\b", ANY, None),
        (r"(?i)/(?:samples|fonts|libs|jquery)\.(?:woff2?|css|js)$", URLS, None)],
    "angler_ek": [
        (r"(?i)\bangler\b", ANY, None),
        (r"(?i)/(?:login|welcome|topic|system|news|images|forums)/[a-z0-9]{5,12}\.php\?id=\d{5,12}\b",
         URLS, None)],
    "nuclear_ek": [
        (r"(?i)\bnuclear[\s_-]?pack\b|\bnuclearek\b", ANY, None),
        (r"(?i)\b[a-z0-9]{18,40}[a-f0-9]{32}\.[a-z0-9.-]+/index2?\.php\b", URLS, None),
        (r"(?i)/index\.php\?i=[A-Za-z0-9+/=]{50,}", URLS, None)],
    "fiesta_ek": [
        (r"(?i)\bfiesta[\s_-]?ek\b", ANY, None),
        (r"(?i)/ai_[a-z0-9]{4,8}/[a-f0-9]{32,}(?:;\d+)*\b", URLS, None)],
    "asprox_botnet": [
        (r"(?i)\basprox\b|\bkuluoz\b", ANY, None),
        (r"/b/(?:eve|opt|letr|news|scr)/[A-Fa-f0-9]{16,40}\b", URLS, None)],
    "dyre": [
        (r"(?i)\bdyre\b|\bdyreza\b|\bupatre\b", ANY, None),
        (r"/[a-z0-9]{4,16}/[A-Z0-9-]+-PC/\d+/[A-Z0-9.-]+/\d+/?", URLS, None)],
    "hiddencobra_lazarus": [
        (r"q45tyu6hgvhi7|ghfghjuyufgdgftr|m\*\^&\^ghfge4wer", ANY, None),
        (r"\b(?:Wating|Reamin|laptos)\b", ANY, None)],
}

# --- fixed values: console keywords -> (tag, label); back-slashes may be doubled as in JSON --------------------------------------------------
CONSOLE_KEYWORDS = [
    (r"\bmimikatz\b", "H_CREDENTIAL_ACCESS", "mimikatz"),
    (r"\bsekurlsa::", "H_CREDENTIAL_ACCESS", "sekurlsa::"),
    (r"\blsadump::", "H_CREDENTIAL_ACCESS", "lsadump::"),
    (r"\bkerberos::", "H_CREDENTIAL_ACCESS", "kerberos::"),
    (r"\bpth\b|\bpass[-_]?the[-_]?hash\b", "H_CREDENTIAL_ACCESS", "pass-the-hash"),
    (r"\bprocdump\b.*lsass", "H_CREDENTIAL_ACCESS", "procdump lsass"),
    (r"\breg\s+save\s+hklm(?:\\){1,2}sam\b", "H_CREDENTIAL_ACCESS", "reg save SAM"),
    (r"\bpsexec(?:\.exe)?\b", "H_LATERAL_MOVEMENT", "psexec"),
    (r"\bwmic\b.*\bnode\s*:", "H_LATERAL_MOVEMENT", "wmic /node:"),
    (r"\bschtasks\b.*/s\b", "H_LATERAL_MOVEMENT", "schtasks /s"),
    (r"\bsc\s+(?:\\\\){1,2}", "H_LATERAL_MOVEMENT", "sc \\\\target"),
    (r"\bnet\s+use\s+(?:\\\\){1,2}", "H_LATERAL_MOVEMENT", "net use \\\\target"),
    (r"\bcopy\s+(?:\\\\){1,2}", "H_LATERAL_MOVEMENT", "copy \\\\target"),
    (r"powershell.*-en?c\b", "H_LIVING_OFF_THE_LAND", "powershell -enc"),
    (r"powershell.*-nop\b", "H_LIVING_OFF_THE_LAND", "powershell -nop"),
    (r"powershell.*-w\s+hidden", "H_LIVING_OFF_THE_LAND", "powershell -w hidden"),
    (r"DownloadString|Invoke-Expression|\biex\b", "H_LIVING_OFF_THE_LAND",
     "ps download-cradle"),
    (r"\bwevtutil\s+cl\b|\bClear-EventLog\b", "H_ANTI_FORENSICS", "wevtutil cl"),
    (r"\bsdelete\b", "H_ANTI_FORENSICS", "sdelete"),
    (r"\bvssadmin\s+delete\s+shadows\b", "H_ANTI_FORENSICS", "vssadmin delete shadows"),
    (r"\bwhoami\b\s*/(priv|all|groups)\b", "H_LIVING_OFF_THE_LAND", "whoami /priv"),
    (r"\bnet\s+group\s+\"?Domain\s+Admins\"?", "H_LIVING_OFF_THE_LAND",
     "net group Domain Admins"),
]

# --- fixed values: destinations of browser history -------------------------------------------------------
SHARE_HOSTS = """
pastebin.com paste.ee ghostbin.co hastebin.com file.io transfer.sh wetransfer.com we.tl
anonfiles.com bayfiles.com mega.nz mega.co.nz mediafire.com sendspace.com zippyshare.com
dropfiles.net uploadfiles.io filebin.net 0x0.st catbox.moe files.catbox.moe
""".split()
WEBMAIL_HOSTS = """
mail.google.com gmail.com mail.yahoo.com login.yahoo.com outlook.live.com mail.live.com
hotmail.com mail.proton.me mail.protonmail.com protonmail.com mail.aol.com mail.gmx.com
mail.tutanota.com icloud.com
""".split()
UPLOAD_PATH = (r"(?i)/(?:viewtopic|showthread|thread|post|upload|submit|newpost|newtopic|forum"
               r"|attachment|file/upload)\b")

# --- fixed values: cached URLs -----------------------------------------------------------------------------
CACHE_TLDS = "pw cc top xyz bid click download tk ml ga cf gq info".split()
TRACKER_HINTS = ["syncuserdata", "__utm", "tcode", "uid=", "sessionid=", "synchronization"]
RAW_ADDRESS_URL = r"https?://(\d+\.\d+\.\d+\.\d+)(?:[/:]|$)"
