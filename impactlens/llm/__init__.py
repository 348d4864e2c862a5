"""Operators for preparing training text: mixing, duplicate removal, fingerprints, chat format, scans, packing, quality, archives."""
