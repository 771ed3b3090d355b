"""Scans: bytes of one archive to rows of entries."""
