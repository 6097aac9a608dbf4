"""Operators for training-data pipelines: language, toxicity, pages, privacy, quality, copies, pieces."""
