"""Readers and writers. Paths are arguments; every reader has an explicit schema."""
