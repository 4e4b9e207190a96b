"""Operators of a training-data pipeline: fingerprints, tokens, licences, classifiers, packing, rendering."""
