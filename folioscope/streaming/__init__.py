"""Streaming of the bibliographic engine."""
