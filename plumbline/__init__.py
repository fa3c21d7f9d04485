"""Spark jobs for auditing evidence-bound graph claims and preparing their texts."""

__version__ = "0.1.0"
