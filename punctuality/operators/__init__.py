"""Relational building blocks, each safe for skewed keys at scale."""
