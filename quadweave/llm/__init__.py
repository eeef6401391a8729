"""Operators for preparing training corpora: filters, de-duplication, scoring, mixing, encoding."""
