"""Training-data operators: tokenizing, deduplication, filtering, archives.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries when it is there.
"""
