"""Operators for large text and sequence corpora; nothing else in the library imports this subpackage."""
