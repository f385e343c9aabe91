"""Whole decision-support queries."""
