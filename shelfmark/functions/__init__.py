"""functions of the catalog engine."""
