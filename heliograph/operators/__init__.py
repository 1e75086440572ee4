"""Operators on DataFrames: job listings, interval joins, clustering, taxonomies, decoding, resources."""
