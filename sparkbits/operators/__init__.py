"""Relational operators on bit vectors: bits or words as rows."""
