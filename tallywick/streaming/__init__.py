"""Scoring of payload streams."""
