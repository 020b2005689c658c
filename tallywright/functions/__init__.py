"""Column expressions: row-level classification, extraction and scoring."""
