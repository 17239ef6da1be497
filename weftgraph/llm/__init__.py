"""Operators for preparing large language-model training corpora.

Self-contained: nothing outside this folder (and ``corpus_pipeline.py``)
imports it, so deleting it leaves the rest of the library working.
"""
