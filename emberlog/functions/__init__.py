from emberlog.functions.net import (  # noqa: F401
    ip_to_long, is_private, is_external, is_rfc1918, is_bogon, provider, port_category,
    port_service, port_annotation, registered_parent, split_parent, tld, suspicious_tld,
    ends_with_any, let,
)
from emberlog.functions.text import (  # noqa: F401
    shannon_entropy, refang, has_repeat_run, distinct_chars, win_basename, is_user_writable,
    subject_stem, reply_stem, mail_domain, display_is_email, name_root, ssdeep_band, tlsh_band,
    phash_distance, any_contains, first_match,
)
from emberlog.functions.times import (  # noqa: F401
    from_filetime, from_prtime, from_apple_epoch, from_any_epoch, parse_iso, timestamps_in_text,
    epoch_seconds,
)
from emberlog.functions.decode import decode_base64_text  # noqa: F401
