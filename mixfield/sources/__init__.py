"""Readers, views, generators and snapshots."""
