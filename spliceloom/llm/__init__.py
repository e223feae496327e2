"""Operators for preparing text corpora. Nothing outside this subpackage imports it."""
