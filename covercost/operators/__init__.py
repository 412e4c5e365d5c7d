"""DataFrame -> DataFrame operators of the costing pipeline."""
