"""Whole lifecycles: load a corpus, search it, answer turns over it."""
