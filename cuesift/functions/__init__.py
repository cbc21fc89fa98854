"""Scalar, array and model functions."""
