"""Readers: log files to typed tables. `parse_*` works on lines, `read_*` on paths."""
