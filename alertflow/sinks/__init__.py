"""Sinks: outbox payloads, attempt logs, snapshots, JSON lists."""
