"""Folioscope: bibliographic and citation-graph analytics expressed as Spark plans."""
