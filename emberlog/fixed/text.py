"""Fixed values about text forms; functions and detectors depend on them literally."""

# --- fixed values: defanged indicator forms and their replacement -------------
DEFANG_STEPS = [
    (r"\[\.\]", "."),
    (r"\(\.\)", "."),
    (r"(?i)\[dot\]", "."),
    (r"(?i)\[at\]", "@"),
    (r"\[:\]", ":"),
    (r"(?i)hxxp(s?)://", "http$1://"),
]

# --- fixed values: user-writable directories ------------------------------------
USER_WRITABLE_MARKERS = [
    "\\appdata\\local\\temp\\", "\\appdata\\roaming\\", "\\programdata\\", "\\users\\public\\",
    "\\temp\\", "\\downloads\\", "\\recycle.bin\\",
    "/appdata/local/temp/", "/appdata/roaming/", "/programdata/", "/users/public/", "/temp/",
    "/downloads/", "/recycle.bin/",
]

# --- fixed values: reply prefixes of mail subjects --------------------------------
REPLY_PREFIX = r"(?i)^(?:re|fw|fwd|tr|sv|aw|antw|res)(?:\s*\[\d+\])?\s*:\s*"
REPLY_PREFIXES = r"(?i)^(?:(?:re|fw|fwd|tr|sv|aw|antw|res)(?:\s*\[\d+\])?\s*:\s*)+"

# --- fixed values: consumer mail domains -------------------------------------------
WEBMAIL_DOMAINS = """
gmail.com yahoo.com hotmail.com live.com outlook.com protonmail.com proton.me aol.com icloud.com
mail.com gmx.com zoho.com yandex.com tutanota.com
""".split()

# --- fixed values: acquisition suffixes of device names ------------------------------
CAPTURE_SUFFIXES = (
    r"(?:[-_]?(?:baseline|snapshot\d*|capture|memory|image|clean|pmem|snap\d*|dump|mem|img|raw)"
    r"|(?:[-_]|(?<=\d))[abc])+$")

# --- fixed values: timestamps written in text -------------------------------------------
TEXT_TIMESTAMP = (
    r"\b(?:19[89]\d|20\d{2})-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"
    r"[T ](?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?")
