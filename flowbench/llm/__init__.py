"""Operators for preparing text corpora: filtering, deduplication, scoring, mixing, archives and token ids."""
