from emberlog.streaming.detectors import (  # noqa: F401
    windowed_failures, windowed_repeats, windowed_errors, run_to_table, refresh_rankings,
)
