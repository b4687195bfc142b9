"""Operators for preparing large training corpora (text, vectors, pages, media).

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries
only when it is present.
"""
