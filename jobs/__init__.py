"""Runnable jobs over the engine: ``python -m jobs.<name> --config jobs/<name>.json``."""
