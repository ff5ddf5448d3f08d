"""Readers and writers of matrices, maps, records and configuration."""
