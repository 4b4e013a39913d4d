"""Readers, declared schemas, the mapped store tables, and the synthetic row sources."""
