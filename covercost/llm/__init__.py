"""Training-data operators: quality, deduplication, privacy, language and token work on whole corpora.

Nothing outside this subpackage imports it; its queries are registered by
``queries`` and its end-to-end flow is ``corpus_pipeline`` at the repository top.
"""
