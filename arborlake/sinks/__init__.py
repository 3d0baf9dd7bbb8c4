"""Writers: XML and X12 text."""
