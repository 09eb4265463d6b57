"""Whole data flows put together from the operators."""
