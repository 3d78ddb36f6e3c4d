"""Operators of a training-data pipeline: filters, classifiers, near-duplicates,
mixing, tokenizing and main-text extraction.

Nothing else in the library imports this subpackage; it imports only the
library's general helpers (session, shared scratch folder).  ``queries`` holds
the registered ``opN_*`` queries and their SQL.
"""
