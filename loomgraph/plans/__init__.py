"""Whole queries: map generation and the structured questions."""
