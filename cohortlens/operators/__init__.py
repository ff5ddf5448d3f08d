"""Relational, rank, matrix, learning and scoring operators over the cells model.

Cells are rows (cohort, layer, feature, sample, value): never one column for
each sample or feature, which would not plan at 10^5 columns.
"""
