"""Fixed values about hosts, ports and addresses; detectors depend on them literally."""

# --- fixed values: host name suffixes -------------------------------------
ABUSE_TLDS = "tk ml ga cf gq".split()

NEWGEN_TLDS = """
top xyz click loan work science stream party trade racing accountant download cricket bid men
faith ren mom lol wtf review win date kim gdn country webcam pw
""".split()

MIXED_TLDS = "rocks biz".split()

DDNS_SUFFIXES = """
duckdns.org no-ip.biz no-ip.org no-ip.info no-ip.net myftp.org myftp.biz hopto.org zapto.org
ddns.net sytes.net serveftp.com servebeer.com dyndns.org dyndns.info dyndns.tv homeip.net
chickenkiller.com ignorelist.com jumpingcrab.com crabdance.com mooo.com strangled.net
is-a-hacker.com co.vu
""".split()

TWO_LABEL_CCTLDS = """
co.uk co.jp co.kr co.nz co.in co.za co.id com.au com.br com.cn com.mx com.tw com.hk com.sg com.my
com.vn com.tr org.uk org.au net.au ac.uk gov.uk gov.au
""".split()

CDN_PARENTS = """
amazonaws.com cloudfront.net azureedge.net cloudapp.net cloudapp.azure.com appspot.com
googleusercontent.com akamaiedge.net akamaihd.net akamaitechnologies.com akamaized.net
edgesuite.net edgekey.net llnwd.net fastly.net fastlylb.net cdn.cloudflare.net cloudflare.com
herokuapp.com herokudns.com githubusercontent.com digitaloceanspaces.com linodeobjects.com
windows.net azurewebsites.net core.windows.net segment.io segment.com mktoresp.com googleapis.com
""".split()

DGA_BENIGN_SUFFIXES = """
googleusercontent.com 1e100.net cloudfront.net akamaihd.net akamaiedge.net azureedge.net
azurefd.net s3.amazonaws.com appspot.com cdn.cloudflare.net
""".split()

# --- fixed values: provider ranges (first match wins) ----------------------
PROVIDER_CIDRS = {
    "Microsoft": """
        13.64.0.0/11 13.104.0.0/14 20.33.0.0/16 20.34.0.0/15 20.36.0.0/14 20.40.0.0/13
        20.48.0.0/12 20.64.0.0/10 20.128.0.0/16 40.64.0.0/10 40.74.0.0/15 52.96.0.0/12
        52.112.0.0/14 52.120.0.0/14 52.160.0.0/11 65.52.0.0/14 104.40.0.0/13 131.253.1.0/24
        131.253.61.0/24 191.232.0.0/13 204.79.195.0/24 204.79.197.0/24""".split(),
    "Akamai": "2.16.0.0/13 23.0.0.0/12 23.192.0.0/11 104.64.0.0/10 184.24.0.0/13".split(),
    "Google": """8.8.4.0/24 8.8.8.0/24 142.250.0.0/15 172.217.0.0/16 172.253.0.0/16
        216.58.192.0/19""".split(),
    "AWS": "3.0.0.0/9 13.32.0.0/15 52.216.0.0/15 54.224.0.0/12 99.84.0.0/16".split(),
    "Cloudflare": "104.16.0.0/13 172.64.0.0/13".split(),
    "Fastly": ["151.101.0.0/16"],
    "Dropbox": ["162.125.0.0/16"],
}

# IPv6 provider prefixes as the leading hex groups they fix
PROVIDER_V6_PREFIXES = {
    "2620:1ec": "Microsoft", "2a01:111": "Microsoft", "2607:f8b0": "Google",
    "2606:4700": "Cloudflare", "2620:100:60": "Dropbox",
}

CLOUD_WEB_PORTS = [80, 443, 8443]

# --- fixed values: ports ---------------------------------------------------
ADMIN_PORTS = {
    22: "ssh", 23: "telnet", 135: "rpc_dcom", 139: "netbios_ssn", 445: "smb", 3389: "rdp",
    5900: "vnc", 5985: "winrm_http", 5986: "winrm_https",
}

SERVICE_PORTS = {
    **ADMIN_PORTS,
    80: "http", 443: "https", 8080: "http_alt", 8443: "https_alt", 8000: "http_alt",
    8888: "http_alt", 25: "smtp", 465: "smtps", 587: "submission", 110: "pop3", 995: "pop3s",
    143: "imap", 993: "imaps", 53: "dns", 88: "kerberos", 123: "ntp", 389: "ldap", 636: "ldaps",
    3268: "ldap_gc", 3269: "ldaps_gc", 21: "ftp", 20: "ftp_data", 69: "tftp", 1433: "mssql",
    1434: "mssql_monitor", 3306: "mysql", 5432: "postgres", 6379: "redis", 27017: "mongodb",
    9200: "elasticsearch", 5672: "amqp", 15672: "amqp_mgmt", 61613: "stomp", 808: "ms_net_tcp",
    464: "kerberos_pwd", 593: "rpc_http", 1701: "l2tp", 1812: "radius", 5355: "llmnr",
    161: "snmp", 162: "snmp_trap", 514: "syslog", 500: "isakmp", 4500: "ipsec_nat",
    1194: "openvpn",
}

INTERNAL_DIRECTORY_PORTS = [88, 389, 636, 3268, 3269, 808]

FLOW_ADMIN_PORTS = [22, 3389, 5985, 5986]

NOT_AN_ENDPOINT = ["", "*", "-", "0.0.0.0", "::", "127.0.0.1", "::1"]
NOT_AN_ENDPOINT_PREFIXES = ["127.", "169.254.", "224.", "239.", "255.", "ff00:", "fe80:"]

# --- fixed values: HTTP clients ----------------------------------------------
SCRIPTED_AGENTS = [
    "curl/", "wget/", "python-requests/", "python-urllib/", "go-http-client", "java/", "winhttp",
    "powershell/", "microsoft-winhttprequest", "mozilla/4.0 (compatible; msie 7.0)",
]
BROWSER_AGENTS = ["mozilla/", "chrome/", "firefox/", "safari/", "edge/", "opera/", "trident/"]

RARE_QTYPES = ["TXT", "NULL", "CNAME"]
ADMIN_SHARES = ["\\C$\\", "\\ADMIN$\\", "\\IPC$\\", "\\C$$", "\\ADMIN$$"]

# --- fixed values: sign-in clients without modern authentication -------------
LEGACY_CLIENTS = [
    "authenticated smtp", "imap4", "imap", "pop3", "pop", "exchange activesync", "autodiscover",
    "other clients; imap", "other clients; pop", "other clients; older office clients",
    "other clients", "exchange online powershell", "reporting web services",
    "exchange web services", "offline address book", "mapi over http",
]
HIGH_RISK_LEVELS = ["high"]
RISK_STATES = ["atrisk", "confirmed-compromised"]
