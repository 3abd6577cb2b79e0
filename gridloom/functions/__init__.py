"""Helpers on rows that operators share."""
