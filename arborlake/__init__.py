"""Schema-described documents as tables: XML Schema and X12 guides to Spark schemas, documents to nested rows and back."""
