"""Operators for building training data: search, archives, formatting, packing, mixing, media, de-duplication, licences, quality, sharding."""
