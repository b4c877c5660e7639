"""Operators for language-model corpora. Nothing outside this subpackage imports it."""
