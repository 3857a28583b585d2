"""Settings and limits."""

from __future__ import annotations

from dataclasses import dataclass

from .errors import InvalidArgument

# Limits of the data model.
MAX_KEY_BYTES = 65_536
MAX_SEQUENCE = 2**56 - 1
MAX_BATCH_COUNT = 2**20
MAX_BATCH_BYTES = 64 * 2**20
LEVELS = 7
PUT, DELETE = 1, 0


@dataclass(frozen=True)
class Options:
    """How a store lays out its runs.

    write_buffer_size: runs of level 0 that are smaller wait to be merged; once they add up to this, a flush follows the commit. level0_trigger: runs in
    level 0 at which it is due for compaction. level_base_bytes and level_multiplier: capacity of level 1, and of each
    further level. max_file_size: estimated bytes of one output run. pick: "round_robin" or "min_overlap". bloom_bits:
    bits a key in the Parquet Bloom filters of a run; 0 turns them off. expected_keys: distinct keys of a row group, for
    their size. lease: seconds that a run or scratch table which no manifest names is left alone, as a commit may be under way.
    """

    write_buffer_size: int = 4 << 20
    level0_trigger: int = 4
    level_base_bytes: int = 10 << 20
    level_multiplier: int = 10
    max_file_size: int = 2 << 20
    pick: str = "round_robin"
    bloom_bits: int = 10
    expected_keys: int = 100_000
    verify: bool = True
    lease: float = 3600.0

    def __post_init__(self) -> None:
        for name, least in (("write_buffer_size", 1), ("level0_trigger", 1), ("level_base_bytes", 1), ("level_multiplier", 2), ("max_file_size", 1), ("expected_keys", 1)):
            if getattr(self, name) < least:
                raise InvalidArgument(f"{name} must be {least} or more")
        if not 0 <= self.bloom_bits <= 64:
            raise InvalidArgument("bloom_bits must be 0 to 64")
        if self.pick not in ("round_robin", "min_overlap"):
            raise InvalidArgument("pick must be round_robin or min_overlap")
