"""Readers: XML node tables and structs, X12 segments, guide tables."""
