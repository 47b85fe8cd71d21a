"""Options of a conversion, and their strict JSON form."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from ..errors import InvalidArgument

#: The keys that a JSON configuration may have.
CONFIG_KEYS = (
    "compression", "compression_level", "block_size", "column_family", "data_block_encoding", "fsync_policy", "error_policy", "bloom_type", "include_mvcc",
    "max_memory_bytes", "compression_threads", "compression_queue_depth", "numeric_sort_fast_path", "default_timestamp_ms", "excluded_columns", "excluded_column_prefixes",
)
#: What the choices may be, in any case.
CHOICES = {
    "compression": ("none", "gz", "gzip"), "data_block_encoding": ("none",), "fsync_policy": ("safe", "fast", "paranoid"), "error_policy": ("strict", "skip_row", "skip_batch"),
    "bloom_type": ("none", "row", "rowcol"), "numeric_sort_fast_path": ("auto", "on", "off"),
}
#: Accepted only as 0.
SPARK_DECIDES = ("max_memory_bytes", "compression_threads", "compression_queue_depth")


@dataclass(frozen=True)
class ConvertOptions:
    """`compression`, `compression_level`, `block_size`, `bloom_type` and `fsync_policy` shape cell files; `error_policy` and `max_errors` say what
    becomes of cells that are not valid; converted cells have no MVCC number, so `include_mvcc` writes the same bytes either way."""

    rule: str = ""
    table_name: str = ""
    column_family: str = "cf"
    default_timestamp_ms: int = 0
    excluded_columns: tuple[str, ...] = ()
    excluded_column_prefixes: tuple[str, ...] = ()
    numeric_sort_fast_path: str = "auto"
    null_keys: str = "skip"
    seed: int | None = None
    compression: str = "gz"
    compression_level: int = 1
    block_size: int = 65536
    data_block_encoding: str = "none"
    fsync_policy: str = "safe"
    error_policy: str = "skip_row"
    bloom_type: str = "row"
    include_mvcc: bool = False
    max_errors: int = 0
    max_memory_bytes: int = 0
    compression_threads: int = 0
    compression_queue_depth: int = 0
    order: tuple[str, ...] = field(default=())

    def __post_init__(self):
        for name, values in CHOICES.items():
            if str(getattr(self, name)).lower() not in values:
                raise InvalidArgument(f"{name} must be one of {', '.join(values)}")
        for name in SPARK_DECIDES:
            if getattr(self, name):
                raise InvalidArgument(f"{name}: Spark's memory settings and task slots decide this; leave it 0")
        if not 0 <= self.compression_level <= 9:
            raise InvalidArgument("compression_level must be 0 to 9")
        if self.block_size <= 0:
            raise InvalidArgument("block_size must be positive")

    @classmethod
    def from_json(cls, text: str, **more) -> ConvertOptions:
        """From a flat JSON object; unknown and repeated keys are refused."""

        def once(pairs):
            seen = dict(pairs)
            if len(seen) < len(pairs):
                raise InvalidArgument("a key occurs twice")
            return seen

        try:
            given = json.loads(text or "{}", object_pairs_hook=once)
        except ValueError as e:
            raise InvalidArgument(f"not JSON: {e}") from e
        if not isinstance(given, dict):
            raise InvalidArgument("the configuration must be an object")
        kinds = {f.name: f.type for f in fields(cls)}
        out = {}
        for key, value in given.items():
            if key not in CONFIG_KEYS:
                raise InvalidArgument(f"unknown key {key!r}")
            if "tuple" in kinds[key]:
                value = tuple(x for x in value.split(",") if x) if isinstance(value, str) else tuple(value) if isinstance(value, list) and all(isinstance(x, str) for x in value) else None
            ok = value is not None and (isinstance(value, bool) if kinds[key] == "bool" else isinstance(value, int) and not isinstance(value, bool) if kinds[key] == "int" else isinstance(value, (str, tuple)))
            if not ok:
                raise InvalidArgument(f"{key} has a value of the wrong kind")
            out[key] = value
        return cls(**out, **more)
