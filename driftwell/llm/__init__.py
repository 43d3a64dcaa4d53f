"""Operators of a training-data pipeline: exact and near duplicates, quality, language, toxicity, mixing, tokens."""
