"""Audit, repair and verification of systematic errors in large tables."""
