"""Operators on point sets: neighbours, selection, sampling, normalisation."""
