"""Readers of simulation output and writers of structures and tables."""
