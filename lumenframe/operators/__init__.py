"""Relational operators over pixels, measures, rules, batches and reviews."""
