"""Operators for training-data pipelines: URL filters, deduplication, extraction, decontamination,
token counts, quality rules, scoring and mixing."""
