"""Bounds on what is read from untrusted archives, and on how much is reported."""

from __future__ import annotations

from dataclasses import dataclass

MB = 1024 * 1024


@dataclass(frozen=True)
class Limits:
    max_archive_size: int = 256 * MB
    max_entries: int = 50_000
    max_entry_size: int = 32 * MB
    max_total_decompressed: int = 512 * MB
    max_descriptor_size: int = 1 * MB
    suspicious_ratio: float = 100.0
    suspicious_ratio_min_size: int = 1 * MB
    large_file: int = 5 * MB
    max_findings_per_rule: int = 50
    max_nesting_depth: int = 2
    directory_bytes_per_entry: int = 512
