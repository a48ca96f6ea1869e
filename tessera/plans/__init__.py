"""Timing harness, chart frames and the registered queries."""
