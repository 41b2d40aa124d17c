"""Operators for preparing training data at corpus scale; nothing outside this package imports it."""
