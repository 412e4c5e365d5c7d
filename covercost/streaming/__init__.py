"""The batch operators applied to a stream of incident files."""
