"""Operators of a training-data pipeline: dedup, decontamination, quality, toxicity, secrets, licences, packing.

One module per operator, each with its general interface; ``registry`` binds them to the shared tables.
"""
