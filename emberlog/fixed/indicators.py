"""Indicator patterns and the noise they are known to match."""

# --- fixed values: patterns of indicators in refanged text -----------------------------------
OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
IPV4 = OCTET + r"(?:\." + OCTET + r"){3}"
IPV6 = (r"(?:[A-Fa-f0-9]{1,4}(?::[A-Fa-f0-9]{1,4}){3,7}"
        r"|(?:[A-Fa-f0-9]{1,4}:)+:[A-Fa-f0-9]{0,4}(?::[A-Fa-f0-9]{1,4})*"
        r"|::[A-Fa-f0-9]{1,4}(?::[A-Fa-f0-9]{1,4})*)")
DOMAIN = r"(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,24}"
BLANKS = (r"\x00-\x20\x7f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}"
          r"\x{3000}")
URL = r"(?i)https?://[^'\"<>()" + BLANKS + r"]+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}"
REGISTRY_KEY = (r"(?i)(?:HKLM|HKCU|HKU|HKCR|HKCC|HKEY_[A-Z_]+)\\"
                r"[\\\p{L}\p{N}_ .${}()-]{3,}")
WINDOWS_PATH = (r"[A-Z]:\\(?:[^\\<>:\"|?*\x00-\x1f\x7f]+\\)*[^\\<>:\"|?*\x00-\x1f\x7f]+")
BTC_LEGACY = r"[13][1-9A-HJ-NP-Za-km-z]{25,34}"
BTC_BECH32 = r"bc1[ac-hj-np-z02-9]{25,60}"
AWS_KEY_ID = r"(?:AKIA|ASIA|AIDA|AROA|AIPA|ANPA|ANVA|ABIA|ACCA)[A-Z0-9]{16}"
AWS_SECRET = (r"(?i)(?:aws[_-]?secret[_-]?(?:access[_-]?)?key|AWSSecretKey)"
              r"\s*[=:]\s*['\"]?([A-Za-z0-9/+=]{40})")

# --- fixed values: minimum number of distinct characters ------------------------------------------
MIN_DISTINCT = {"md5": 8, "sha1": 10, "sha256": 12, "btc": 12, "cryptocurrency": 12, "onion": 10}

# --- fixed values: private address prefixes ----------------------------------------------------------
PRIVATE_PREFIX = (r"^(0\.|10\.|127\.|169\.254\.|224\.|239\.|255\.|192\.168\."
                  r"|172\.(1[6-9]|2[0-9]|3[01])\.)")

# --- fixed values: file extensions that look like a top-level domain ---------------------------------
FILE_EXTENSIONS = """
pcap pcapng exe ex dll sys bin raw mem vmem lime dmp kdmp json txt csv log xml yaml yml toml
doc docx xls xlsx ppt pptx pdf rtf odt zip gz tar bz2 xz rar 7z iso img
e01 l01 ad1 ewf vhd vhdx vmdk ova ovf evtx etl wim reg lnk jpg jpeg png gif htm html
css scss less sass svg webp ico bmp tiff tif woff woff2 ttf eot otf
mp3 mp4 wav avi mov webm flv ogg m4a m4v map md rst swp swo class jar war srt vtt
db db3 sqlite sqlite3 cache dat ce skimlinks py pyc sh bat ps1 vbs js cmd rb go
ini conf cfg tmp bak old php php3 php4 php5 phtml asp aspx ashx asmx cgi pl cfm jsp jspx do
action shtml shtm eml msg pst ost ics vcf drv pdb service ocx cpl msc mui
cmdline dlllist malfind netscan netstat pslist psscan pstree svcscan filescan modules modscan
envars hivelist registry userassist handles pf fon ttc ttcf mum cat cer crt p7b p7s p12 pfx sig
hve nls sdb cab edb jfm chk btr tlb evt pri winmd xbf manifest msstyles inf ftl bof
mca wid mcs acm tsp srd jtx data mo po hlp ntf ppd default
""".split()

INTERNAL_TLDS = "lan local corp home intranet private example test invalid localhost".split()

# Generic top-level domains accepted without a list; two-letter ones always are. Pass the full
# public list as a parameter where one is at hand.

# --- fixed values: names that are no indicators --------------------------------------------------------
NOISE_DOMAINS = """
microsoft.windows process.cpp rescache.hit microsoft.com microsoft.net windows.com
schemas.microsoft.com openxmlformats.org w3.org google.com googleapis.com gstatic.com office.com
live.com msftncsi.com windowsupdate.com in-addr.arpa ip6.arpa net.tcp net.pipe net.msmq
mscorlib.dll system.runtime www.openssl.org http.host http.request http.response http.method
http.uri http.user_agent http.referer http.cookie http.status tls.handshake tls.record
tls.server_name tls.certificate tls.version tls.cipher dns.query dns.response dns.answer dns.qry
tcp.port tcp.flags tcp.seq tcp.ack tcp.srcport tcp.dstport udp.port udp.srcport udp.dstport
ip.src ip.dst ip.addr ip.proto ip.ttl ssl.handshake ssl.record x509sat.printablestring
x509sat.utf8string x509sat.ia5string x509ce.keyusage x509ce.extkeyusage x509ce.basicconstraints
x509af.algorithm x509af.signature pkix1explicit.rdnsequence winhttp.winhttprequest
""".split()

OID_NAMES = """
name.fullname name.relativename value.bykey value.byname value.good value.implicitlyca
value.parameters value.revoked value.set value.single value.unknown p.onbasis p.other p.ppbasis
p.prime p.tpbasis d.cpsuri d.data d.digest d.directoryname d.dnsname d.edipartyname d.encrypted
d.enveloped d.ipaddress d.other d.othername d.registeredid d.sign d.usernotice cert.pem faq.html
""".split()

NOISE_PREFIXES = """
http. https. tls. ssl. dns. tcp. udp. ip. ipv4. ipv6. eth. icmp. x509sat. x509ce. x509af.
x509ocsp. x509ext. pkix1. pkix1explicit. pkix1implicit.
""".split()

SYSTEM_NAME_PREFIXES = """
ntkrnlmp winspool fontdrvhost diagnosticshub macompatsvc system32 syswow64 dwm csrss lsass
svchost rundll32 regsvr32 wininit smss wuauserv
""".split()

CURVE_CONSTANTS = """
79be667ef9dcbbac55a06295ce870b07029bfcdb2dce28d959f2815b16f81798
483ada7726a3c4655da4fbfc0e1108a8fd17b448a68554199c47d08ffb10d4b8
fffffffffffffffffffffffffffffffebaaedce6af48a03bbfd25e8cd0364141
6b17d1f2e12c4247f8bce6e563a440f277037d812deb33a0f4a13945d898c296
4fe342e2fe1a7f9b8ee7eb4a7c0f9e162bce33576b315ececbb6406837bf51f5
ffffffff00000001000000000000000000000000ffffffffffffffffffffffff
5ac635d8aa3a93e7b3ebbd55769886bc651d06b0cc53b0f63bce3c3e27d2604b
""".split()

# --- fixed values: further indicator types (public address and identifier formats) -----------------------
EXTRA_PATTERNS = {
    "cryptocurrency": [
        r"\b0x[0-9a-fA-F]{40}\b", r"\b[LM][1-9A-HJ-NP-Za-km-z]{26,33}\b",
        r"\bD[5-9A-HJ-NP-U][1-9A-HJ-NP-Za-km-z]{32}\b", r"\bX[1-9A-HJ-NP-Za-km-z]{33}\b",
        r"\b4[0-9AB][1-9A-HJ-NP-Za-km-z]{93}\b", r"\br[1-9A-HJ-NP-Za-km-z]{24,34}\b",
        r"\bT[1-9A-HJ-NP-Za-km-z]{33}\b", r"\bt1[1-9A-HJ-NP-Za-km-z]{33}\b",
        r"\btz[123][1-9A-HJ-NP-Za-km-z]{33}\b", r"\bG[A-Z2-7]{55}\b",
        r"\bbitcoincash:[qp][0-9a-z]{41}\b", r"\baddr1[0-9a-z]{53,98}\b",
        r"\b[1-9A-HJ-NP-Za-km-z]{43,44}\b"],
    "onion": [r"\b(?:[a-z2-7]{16}|[a-z2-7]{56})\.onion\b"],
    "cve": [r"(?i)\bCVE-\d{4}-\d{4,7}\b"],
    "social_handle": [
        r"(?i)\b(?:t\.me|telegram\.me|twitter\.com|github\.com|wa\.me|linkedin\.com/in"
        r"|instagram\.com|pinterest\.com|facebook\.com|youtube\.com/(?:user|channel|c))"
        r"/[A-Za-z0-9_.-]{2,}"],
    "phone": [r"\+[1-9]\d{0,2}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}\b"],
    "iban": [r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"],
    "android_package": [r"\b(?:com|org|net|io|de|ru|cn)\.[a-z0-9_]+(?:\.[a-z0-9_]+)+\b"],
    "attack_technique": [r"\bT\d{4}(?:\.\d{3})?\b"],
}
