"""Scalar functions and distribution functions."""
