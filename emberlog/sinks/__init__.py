"""Sinks: ledgers, registries, indicator bundles, execution logs."""
