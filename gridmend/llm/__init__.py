"""Operators for preparing training corpora: filters, deduplication, decontamination, scans, counts and mixing."""
