"""Operators on record journals, references, hierarchies, intervals and evaluations."""
