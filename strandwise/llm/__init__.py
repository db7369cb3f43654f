"""Operators for text corpora and free-entered values; nothing outside this subpackage imports it."""
