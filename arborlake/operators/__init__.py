"""Relational operators: runs, prefixes, checks, reachability, registries, node tables."""
