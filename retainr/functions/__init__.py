"""Scalar Column helpers."""
