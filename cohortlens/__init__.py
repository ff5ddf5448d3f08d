"""cohortlens: a PySpark-native engine for comparing feature matrices across cohorts."""
