"""Training-data operators: packing, deduplication, media, chat, scoring, decontamination, encoding, language, PII.

Nothing else in the library imports this subpackage.
"""
