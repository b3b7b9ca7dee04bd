"""Readers and writers, and generated listings."""
