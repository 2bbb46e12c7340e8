"""Operators for text corpora and for the large selections behind them. Nothing outside this subpackage imports it."""
