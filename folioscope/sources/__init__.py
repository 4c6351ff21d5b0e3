"""Sources of the bibliographic engine."""
