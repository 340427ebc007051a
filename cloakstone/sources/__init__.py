"""Readers, validated side records, event logs, sinks and the synthetic table source."""
