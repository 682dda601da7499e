"""Readers and writers for raw files, staging tables and exchange formats."""
