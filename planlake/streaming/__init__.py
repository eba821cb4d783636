"""Streaming operators (I rows). Stateless ones are the batch functions themselves; see streams.py."""
