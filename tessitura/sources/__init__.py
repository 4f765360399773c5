"""Readers, writers, the shard cache and plug-in boundaries."""
