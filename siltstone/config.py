"""Settings of a store, checked against their ranges."""

from __future__ import annotations

from dataclasses import dataclass

from siltstone.errors import InvalidInput

KIB, MIB = 1 << 10, 1 << 20


@dataclass(frozen=True)
class Settings:
    """Sizes in bytes; ``validate`` refuses values outside the ranges below.

    ``sstable_block_size`` is the Parquet page size and ``bloom_false_positive_rate``
    that of the Bloom filters on keys, both of all files but the log's. A write to the
    log takes files of about ``wal_segment_size``. ``max_sstable_file_handles`` is only
    checked: Spark opens files for as long as it reads them and keeps none.
    """

    memtable_size_threshold: int = 4 * MIB
    sstable_block_size: int = 4 * KIB
    max_level0_files: int = 2
    target_sstable_bytes: int = 2 * MIB
    level_base_bytes: int = 16 * MIB
    level_size_multiplier: int = 10
    wal_segment_size: int = MIB
    bloom_false_positive_rate: float = 0.01
    max_sstable_file_handles: int = 64

    def validate(self) -> "Settings":
        for name, low, high in (
            ("memtable_size_threshold", MIB, 64 * MIB),
            ("sstable_block_size", KIB, 64 * KIB),
            ("max_level0_files", 1, 10),
            ("wal_segment_size", 256 * KIB, 10 * MIB),
            ("max_sstable_file_handles", 8, 512),
        ):
            if not low <= getattr(self, name) <= high:
                raise InvalidInput(f"{name} must lie between {low} and {high}")
        if self.target_sstable_bytes < 1 or self.level_base_bytes < 1:
            raise InvalidInput("target and base sizes must be positive")
        if self.level_size_multiplier < 2:
            raise InvalidInput("level_size_multiplier must be at least 2")
        if not 0 < self.bloom_false_positive_rate < 1:
            raise InvalidInput("bloom_false_positive_rate must lie between 0 and 1")
        return self

    @classmethod
    def for_cluster(cls, **changed) -> "Settings":
        """Settings for terabytes: files of 512 MiB instead of 2, and levels to match."""
        large = dict(
            memtable_size_threshold=64 * MIB, sstable_block_size=64 * KIB, target_sstable_bytes=512 * MIB,
            level_base_bytes=64 << 30, wal_segment_size=10 * MIB, max_level0_files=8,
        )
        return cls(**(large | changed)).validate()
