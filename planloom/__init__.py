"""planloom: document-provenance and plan analytics as Spark DataFrame operators."""
