"""Operators for preparing training data: encoding, decontamination, near duplicates, scans, packing."""
