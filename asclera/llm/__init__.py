"""Operators that prepare text for training and evaluation; nothing outside this subpackage imports it."""
