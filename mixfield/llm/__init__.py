"""Operators for preparing large text, URL, vector and audio corpora."""
