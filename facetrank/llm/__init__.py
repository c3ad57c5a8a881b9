"""Operators for training-data pipelines: mixing, packing, deduplication, scans, rules,
language identification, nearest neighbours, scoring, sharding, phrase mining, source audits and personal data.

Nothing else in the library imports this subpackage.
"""
