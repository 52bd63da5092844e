"""Relational and graph operators over symbols, edges and data models."""
