"""Operators for text corpora: packing, archives, deduplication, redaction, language, tokens, quality, fingerprints."""
