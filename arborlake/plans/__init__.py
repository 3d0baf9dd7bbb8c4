"""Schemas and the plans built from them: XSD graphs, X12 guides, validation, queries."""
