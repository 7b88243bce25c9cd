"""Readers and writers of the stored tables, run logs and run outputs."""
