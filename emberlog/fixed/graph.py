"""Node and edge kinds of the entity graph."""

# --- fixed values: node kind -> properties besides its id ---------------------------------------
NODE_KINDS = {
    "Host": ("os",),
    "User": ("name", "host"),
    "Process": ("ppid", "name", "cmdline", "host", "start_utc"),
    "File": ("sha256", "size", "host"),
    "RegistryKey": ("hive", "host", "last_write_utc"),
    "IPAddress": ("version",),
    "Domain": (),
    "Hash": ("algo",),
    "NetworkFlow": ("src", "dst", "sport", "dport", "proto", "bytes", "start_utc"),
    "Event": ("source", "channel", "eid", "ts_utc", "host"),
    "Email": ("subject", "folder", "pst_path", "sent_utc", "has_attachments"),
}

# --- fixed values: edge kind -> kinds of its ends --------------------------------------------------
EDGE_KINDS = {
    "EXECUTED": ("User", "Process"),
    "CHILD_OF": ("Process", "Process"),
    "WROTE": ("Process", "File"),
    "LOADED": ("Process", "File"),
    "HASHES_TO": ("File", "Hash"),
    "WROTE_KEY": ("Process", "RegistryKey"),
    "RESOLVED_TO": ("Domain", "IPAddress"),
    "CONNECTED_TO": ("Process", "IPAddress"),
    "FLOW_SRC": ("NetworkFlow", "IPAddress"),
    "FLOW_DST": ("NetworkFlow", "IPAddress"),
    "AUTHENTICATED_AS": ("Event", "User"),
    "RAISED_BY": ("Event", "Process"),
    "RUNS_ON": ("Process", "Host"),
    "OBSERVED_ON": ("Event", "Host"),
    "SOURCE_IP": ("Event", "IPAddress"),
    "SENT_FROM": ("Email", "User"),
    "SENT_TO": ("Email", "User"),
    "HAS_ATTACHMENT": ("Email", "File"),
    "EMAILS_ON_DOMAIN": ("User", "Domain"),
}

# --- fixed values: addresses of sockets without a peer ----------------------------------------------
NO_PEER = ("", "*", "0.0.0.0", "::", "127.0.0.1", "::1")
