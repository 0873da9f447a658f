"""Readers, writers, contracts and profiling."""
