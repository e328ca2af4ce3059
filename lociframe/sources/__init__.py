"""Readers of interval, sequence, variant, motif, structure and log files."""
