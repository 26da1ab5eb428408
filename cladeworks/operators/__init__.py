"""Relational operators: deduplication, rules, hierarchies, enrichment, checks, splits, metrics, sampling."""
