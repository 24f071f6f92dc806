"""Operators on the text corpus. Nothing outside this subpackage imports it."""
