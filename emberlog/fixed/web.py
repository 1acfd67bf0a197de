"""Fixed values about web requests; the access-log detectors depend on them literally."""

# --- fixed values: access logs of Unix web servers ----------------------------------
WEBSHELL_NAMES = """
cmd.php cmd.jsp cmd.cgi cmd.pl cmd.py shell.php shell.jsp shell.cgi shell.pl shell.py c99.php
r57.php wso.php b374k.php weevely.php china.php chopper.php tunnel.php reverse.php upload.php
uploader.php ma.jsp cmdjsp.jsp jspspy.jsp backdoor.php bd.php simpleshell.php eval.php test.php
info.php phpinfo.php adminer.php alfa.php alfashell.php
""".split()

WEBSHELL_QUERY_TOKENS = [
    "cmd=", "exec=", "eval=", "query=", "shell=", "system(", "passthru(", "shell_exec(",
    "base64_decode(", "%00", "../../", "..%2f..%2f", "etc/passwd", "etc/shadow", "boot.ini",
    "wp-config.php",
]

OFFENSIVE_AGENTS = [
    "sqlmap", "nikto", "nmap scripting engine", "masscan", "zgrab", "zmap", "nuclei", "gobuster",
    "dirbuster", "dirb", "wpscan", "ffuf", "hydra", "metasploit",
]
GENERIC_AGENTS = [
    "curl/", "wget/", "go-http-client", "python-requests", "python-urllib", "libwww-perl",
    "powershell", "invoke-webrequest", "httpclient", "java/", "okhttp", "axios/", "ruby",
    "requests",
]
ADMIN_PATHS = [
    "/admin/", "/administrator/", "/wp-admin/", "/wp-login.php", "/phpmyadmin/", "/pma/",
    "/myadmin/", "/manager/html", "/manager/status", "/.env", "/.git/", "/.svn/", "/.aws/",
    "/.ssh/", "/config.php", "/setup.php", "/install.php", "/server-status", "/server-info",
]
TUNNEL_VERBS = "PROPFIND PUT DELETE OPTIONS TRACE MKCOL COPY MOVE LOCK".split()
SCRIPT_EXTENSIONS = [".php", ".jsp", ".cgi", ".pl", ".py", ".aspx"]

# --- fixed values: logs of Windows web servers ------------------------------------------
W3C_WEBSHELL_NAMES = """
cmd.aspx cmd.asp cmd.ashx cmd.jsp cmd.php shell.aspx shell.asp shell.ashx shell.jsp shell.php
c99.php r57.php wso.php b374k.php weevely.php china.aspx chopper.aspx china.php tunnel.aspx
reverse.aspx upload.aspx uploader.aspx ma.jsp cmdjsp.jsp jspspy.jsp backdoor.aspx bd.aspx
simpleshell.aspx iiscmd.aspx iis_cmd.aspx eval.php test.php info.php
""".split()
W3C_QUERY_TOKENS = [
    "cmd=", "exec=", "eval=", "query=", "shell=", "system(", "passthru(", "shell_exec(",
    "base64_decode(", "FromBase64String(", "%00", "../../", "..%2f..%2f", "etc/passwd",
    "boot.ini", "web.config",
]
W3C_ADMIN_PATHS = [
    "/admin/", "/administrator/", "/wp-admin/", "/wp-login.php", "/phpmyadmin/", "/pma/",
    "/myadmin/", "/manager/html", "/manager/status", "/.env", "/.git/", "/.svn/", "/.aws/",
    "/config.php", "/setup.php", "/install.php", "/owa/", "/ecp/", "/autodiscover/", "/rpc/",
    "/ews/exchange.asmx",
]
W3C_SCRIPT_EXTENSIONS = [".aspx", ".asp", ".ashx", ".php", ".jsp", ".jspx"]
