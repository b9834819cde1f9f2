"""Operators of a training-data pipeline: text, media and pages in, cleaned, weighted and packed documents out."""
