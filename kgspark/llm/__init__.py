"""Operators of a training-data pipeline: near copies, licences, tokens, vectors, quality, toxicity, pages, packing, audits.

Nothing else in the library imports this package.
"""
