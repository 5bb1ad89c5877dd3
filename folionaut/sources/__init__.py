"""Readers: listings, text, markup, office archives, transcripts, cards and source code."""
