"""Operators over DataFrames of payloads and frames."""
