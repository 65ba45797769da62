"""Relational operators outside the training-data subpackage."""

from corvane.operators.pricing import pricing_summary

__all__ = ["pricing_summary"]
