"""Queries put together from operators."""
