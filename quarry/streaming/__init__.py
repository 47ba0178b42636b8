"""Journals and corpora as streams."""
