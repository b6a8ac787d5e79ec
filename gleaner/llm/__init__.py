"""Operators for preparing training corpora; nothing else in the library imports this folder.

Every operator takes tables and column names and returns tables; ``queries`` holds the thin ``opN_<name>`` queries
derived from them, ``/corpus_pipeline.py`` the pipeline built of five of them.
"""
