"""Column functions: leaf codecs and names."""
