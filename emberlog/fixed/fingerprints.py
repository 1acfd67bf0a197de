"""Published fingerprints of TLS clients and of DHCP option lists."""

#: JA3 hash, class, label, source.
JA3 = (
    ("a0e9f5d64349fb13191bc781f81f42e1", "known_bad", "Cobalt Strike default TLS profile",
     "https://github.com/salesforce/ja3"),
    ("72a589da586844d7f0818ce684948eea", "known_bad", "Meterpreter / Metasploit reverse_https default",
     "https://github.com/salesforce/ja3"),
    ("6734f37431670b3ab4292b8f60f29984", "known_bad", "Emotet C2", "https://sslbl.abuse.ch/ja3-fingerprints/"),
    ("bd4c5fbce93a6f30bf9fab3af8496b94", "known_bad", "TrickBot C2", "https://sslbl.abuse.ch/ja3-fingerprints/"),
    ("0f94a14c08c9bbcf8a8e23fe4a7f8fed", "benign_common", "curl / libcurl", None),
)

#: DHCP option list (option 55) and operating system.
DHCP = (
    ("1,15,3,6,44,46,47,31,33,121,249,43", "Windows 10 / 11"),
    ("1,15,3,6,44,46,47,31,33,121,249,43,252", "Windows 10 / 11 (proxy)"),
    ("1,3,6,15,28", "Linux (older systemd-networkd)"),
    ("1,121,3,6,15,119,252,95,44,46", "macOS"),
    ("1,3,6,12,15,28,40,41,42,26,121,249,33,252,42,15,44,47", "Android"),
    ("1,33,3,6,15,28,51,58,59,119,121", "iOS"),
)
