"""Additive statistics over micro-batches."""
