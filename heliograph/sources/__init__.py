"""Scans and sinks: job stores, sprite cues, taxonomies, media files, metrics."""
