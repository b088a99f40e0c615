"""Operators for preparing text corpora: packing, de-duplication, filters, scores."""
