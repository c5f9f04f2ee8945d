"""Training-data pipeline operators: deduplication, mixing, quality, secrets, token counts, media columns and packing.

Nothing else in the library imports this subpackage; ``queries.py`` registers its queries.
"""
