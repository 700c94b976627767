"""Operators for preparing text at scale. Nothing outside this subpackage imports it."""
