"""Readers: alert batches and files, streams, stored tables, configuration."""
