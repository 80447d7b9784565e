"""Readers, writers, manifests, and shipping the package to executors."""
