"""Fixed values about processes, files and mail; the endpoint detectors depend on them literally."""

# --- fixed values: expected process table -------------------------------------------------------
PROCESS_PROFILE = {
    "wininit.exe": {"parents": ["smss.exe"], "exact": 1},
    "services.exe": {"parents": ["wininit.exe"], "exact": 1},
    "lsass.exe": {"parents": ["wininit.exe"], "exact": 1},
    "lsaiso.exe": {"parents": ["wininit.exe"], "max": 1},
    "winlogon.exe": {"parents": ["smss.exe"], "min": 1},
    "csrss.exe": {"parents": ["smss.exe"], "min": 2},
    "smss.exe": {"parents": ["system"], "exact": 1},
    "explorer.exe": {"parents": ["userinit.exe"]},
    "svchost.exe": {"parents": ["services.exe"], "min": 3},
    "runtimebroker.exe": {"parents": ["svchost.exe"]},
    "taskhostw.exe": {"parents": ["svchost.exe"]},
}

OFFICE_PARENTS = ["winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe", "acrord32.exe",
                  "wmic.exe"]
SHELL_CHILDREN = ["powershell.exe", "cmd.exe", "wscript.exe", "cscript.exe", "rundll32.exe",
                  "regsvr32.exe", "mshta.exe", "bitsadmin.exe"]
NOISY_SHORT_LIVED = ["conhost.exe", "consent.exe", "backgroundtaskhost.exe"]

# --- fixed values: sensitive attachments -------------------------------------------------------------
SENSITIVE_WORDS = """
plan roadmap confidential secret salary salaries ssn payroll employees customers acquisition
merger strategy budget forecast q1 q2 q3 q4 client clients pricing contract
""".split()
OFFICE_EXTENSIONS = ".xls .xlsx .xlsm .doc .docx .pdf .csv .zip .7z .rar".split()

# --- fixed values: sync directories and their providers --------------------------------------------
SYNC_DIRECTORIES = {
    "box sync": "Box", "boxsync": "Box", "dropbox": "Dropbox", "onedrive": "OneDrive",
    "onedrive - personal": "OneDrive", "google drive": "Google Drive",
    "google drive file stream": "Google Drive", "googledrive": "Google Drive",
    "drive": "Google Drive", "icloud drive": "iCloud", "icloud": "iCloud", "mega": "MEGA",
    "amazon drive": "Amazon",
}
SYNC_NOISE = ["desktop.ini", ".ds_store", "thumbs.db", "box sync.lnk", "dropbox.lnk",
              "google drive.lnk", "onedrive.lnk", ".tmp.drivedownload"]
MIRROR_MIN_BYTES = 1024

# --- fixed values: hidden directories of a home that are usual ---------------------------------------
USUAL_DOT_DIRECTORIES = """
.cache .local .mozilla .thunderbird .config .gnupg .ssh .vim .vscode .vscode-server .npm .yarn
.cargo .rustup .m2 .gradle .docker .kube .aws .azure .gcloud .mc .minikube .terraform .ansible
.pki .dbus .pulse .java .jdks .steam .wine .dotnet .nuget .git
""".split()
HOARD_EXTENSIONS = """
.zip .rar .7z .tar .tgz .gz .bz2 .xz .pdf .doc .docx .xls .xlsx .ppt .pptx .odt .ods .odp .rtf
.wav .mp3 .flac .ogg .jpg .jpeg .png .gif .bmp .tiff .mp4 .avi .mov .mkv .webm .exe .dll .so
.dylib .elf .bin .pcap .pcapng .cap
""".split()

# --- fixed values: paths of high value, most important first -----------------------------------------
VALUED_PATHS = [
    r"\.ost$", r"\.pst$", r"NTUSER\.DAT$", r"UsrClass\.dat$",
    r"[/\\]config[/\\](SYSTEM|SOFTWARE|SECURITY|SAM)$", r"\.evtx$", r"ConsoleHost_history\.txt$",
    r"[/\\]History$", r"places\.sqlite$", r"\.sqlite$", r"\$MFT$", r"\$UsnJrnl", r"\.lnk$",
    r"[/\\]Recent[/\\]",
]
MIN_WIPED_BYTES = 4096

# --- fixed values: event ids worth counting ---------------------------------------------------------------
VALUED_EVENTS = {
    4624: "successful logon", 4625: "failed logon", 4648: "explicit credential logon",
    4672: "special privileges", 4688: "process created", 4697: "service installed",
    4698: "scheduled task created", 4720: "account created", 4732: "added to local group",
    7045: "new service", 1102: "audit log cleared", 104: "system log cleared",
}

# --- fixed values: file types told by their first bytes (hex), and the extensions they may carry ----------
MAGIC_TYPES = {
    "FFD8FF": "jpeg", "89504E47": "png", "47494638": "gif", "25504446": "pdf", "504B0304": "zip",
    "4D5A": "exe", "7F454C46": "elf", "52617221": "rar", "377ABCAF271C": "7z", "1F8B": "gzip",
    "D0CF11E0": "ole",
}
TYPE_EXTENSIONS = {
    "jpeg": "jpg jpeg jpe jfif", "png": "png", "gif": "gif", "pdf": "pdf ai",
    "zip": "zip docx xlsx pptx odt ods odp jar apk epub xpi kmz", "exe":
    "exe dll sys ocx scr cpl drv com mui", "elf": "so o elf bin ko", "rar": "rar",
    "7z": "7z", "gzip": "gz tgz", "ole": "doc xls ppt msi msg db",
}
