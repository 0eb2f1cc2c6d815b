"""Operators that prepare text and source code as training data. Nothing outside this subpackage imports it."""
