"""The binary cell file: sorted cells in checksummed blocks with an index of one or two levels, row filters, file information and a
trailer, as Apache HBase's store files of version 3 lay them out.

Each range partition is written by one task as one file, with a block in memory at a time (and the index's first keys). No store's reader is
at hand here, so the bytes are tested with the reader below alone.
"""

from __future__ import annotations

import functools
import gzip
import os
import struct
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..errors import SortViolation
from ..operators import layout
from ..operators.encoding import CHUNK, crc32c, read_writable_vint, varint, writable_vint
from .arrow_stream import _filesystem

#: Fixed values of the format.
DATA, LEAF, ROOT, META_INDEX, INFO, FILTER, FILTER_META, TRAILER = b"DATABLK*", b"IDXLEAF2", b"IDXROOT2", b"IDXROOT2", b"FILEINF2", b"BLMFBLK2", b"BLMFMET2", b'TRABLK"$'
HEADER, CHECKSUM_CRC32C, TRAILER_SIZE, VERSION = 33, 2, 4096, 3 << 24 | 3
CODECS = {"gz": 1, "none": 2}
#: Keys of a filter that are hashed at once.
PENDING = 4096
COMPARATOR = "org.apache.hadoop.hbase.InnerStoreCellComparator"
HASH_TYPE, FILTER_VERSION = 1, 3


def cell_key(row: bytes, family: bytes, qualifier: bytes, ts: int, kind: int) -> bytes:
    return struct.pack(">H", len(row)) + row + bytes([len(family)]) + family + qualifier + struct.pack(">qB", ts, kind)


def encode_cell(key: bytes, value: bytes) -> bytes:
    return struct.pack(">ii", len(key), len(value)) + key + value + b"\0\0"


def _field(number: int, value) -> bytes:
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    return varint(number << 3) + varint(value)


class Writer:
    """Blocks of one file, in the order of its cells."""

    def __init__(self, out, compression: str = "gz", level: int = 1, block_size: int = layout.BLOCK_SIZE, filter_keys: int = 0, leaf_target: int = layout.LEAF_TARGET, filter_kind: str = "row"):
        self.filter_kind, self.last_filtered = filter_kind, None
        self.out, self.compression, self.level, self.block_size, self.leaf_target = out, compression, level, block_size, leaf_target
        self.at, self.raw, self.before = 0, 0, {}
        self.block, self.first_key, self.leaf, self.root, self.leaf_bytes, self.index_bytes = bytearray(), None, [], [], layout.LEAF_HEADER, 0
        self.entries, self.key_bytes, self.value_bytes, self.last, self.last_order, self.biggest = 0, 0, 0, None, None, (0, b"")
        self.first_block = self.last_block = 0
        self.pending: list[bytes] = []
        self.filter_keys, self.filters, self.filter, self.filter_n, self.filter_first, self.last_row, self.n_rows = filter_keys, [], bytearray(layout.CHUNK_BYTES), 0, b"", None, 0

    def _put(self, magic: bytes, data: bytes, packed: bool = True) -> tuple[int, int]:
        """(offset, size) of a block."""
        body = gzip.compress(data, self.level, mtime=0) if packed and self.compression == "gz" else data
        whole = HEADER + len(body)
        sums = 4 * (-(-whole // CHUNK))
        head = magic + struct.pack(">iiqbii", len(body) + sums, len(data), self.before.get(magic, -1), CHECKSUM_CRC32C, CHUNK, whole)
        block = head + body
        block += b"".join(struct.pack(">I", c) for c in crc32c(block))
        offset, self.before[magic] = self.at, self.at
        self.out.write(block)
        self.at += len(block)
        self.raw += HEADER + len(data)
        return offset, len(block)

    def append(self, row: bytes, family: bytes, qualifier: bytes, ts: int, kind: int, value: bytes) -> None:
        order = (row, family, qualifier, -ts, -kind)
        if self.last_order is not None and order <= self.last_order:
            raise SortViolation(f"cell {row!r} is not above the one before it")
        if self.block and len(self.block) >= self.block_size:
            self._close_block()
        key = cell_key(row, family, qualifier, ts, kind)
        if not self.block:
            self.first_key = self._separator(row, qualifier, family, key)
        if self.filter_keys:
            filtered = layout.rowcol_key(row, qualifier) if self.filter_kind == "rowcol" else row
            if filtered != self.last_filtered:
                self._filter(filtered)
                self.last_filtered = filtered
        self.block += encode_cell(key, value)
        self.entries, self.key_bytes, self.value_bytes = self.entries + 1, self.key_bytes + len(key), self.value_bytes + len(value)
        if 12 + len(key) + len(value) > self.biggest[0]:
            self.biggest = 12 + len(key) + len(value), key
        self.last, self.last_order, self.last_row = key, order, row

    def _separator(self, row: bytes, qualifier: bytes, family: bytes, key: bytes) -> bytes:
        if self.last_order is None:
            return key
        latest = struct.pack(">qB", 2**63 - 1, 255)
        short = layout.separator(self.last_order[0], row)
        if short is not None:
            return struct.pack(">H", len(short)) + short + b"\0" + latest
        if self.last_order[2] < qualifier:
            return struct.pack(">H", len(row)) + row + bytes([len(family)]) + family + layout.separator(self.last_order[2], qualifier) + latest
        return key

    def _filter(self, key: bytes) -> None:
        if self.filter_n == self.filter_keys:
            self._close_filter()
        if not self.filter_n:
            self.filter_first = key
        self.pending.append(key)
        if len(self.pending) == PENDING:
            self._hash_pending()
        self.filter_n, self.n_rows = self.filter_n + 1, self.n_rows + 1

    def _hash_pending(self) -> None:
        if self.pending:
            places = layout.bloom_positions(self.pending, self.hashes, len(self.filter) * 8).ravel()
            bits = np.frombuffer(self.filter, np.uint8)
            np.bitwise_or.at(bits, places >> 3, (1 << (places & 7)).astype(np.uint8))
            self.pending = []

    hashes = 7

    def _close_filter(self) -> None:
        if self.filter_n:
            self._hash_pending()
            bits, most = bytes(self.filter), self.filter_keys
            while len(bits) % 2 == 0 and most > self.filter_n * 2:
                half = len(bits) // 2
                bits, most = (int.from_bytes(bits[:half], "big") | int.from_bytes(bits[half:], "big")).to_bytes(half, "big"), most // 2
            self.filters.append((*self._put(FILTER, bits), self.filter_first, len(bits), most))
            self.filter, self.filter_n = bytearray(layout.CHUNK_BYTES), 0

    def _close_block(self) -> None:
        if not self.block:
            return
        offset, size = self._put(DATA, bytes(self.block))
        if not self.leaf and not self.root:
            self.first_block = offset
        self.last_block = offset
        self.leaf.append((offset, size, self.first_key))
        self.leaf_bytes += layout.LEAF_ENTRY + len(self.first_key)
        self.block = bytearray()
        if self.leaf_bytes >= self.leaf_target:
            self._close_leaf()

    def _close_leaf(self) -> None:
        if self.leaf:
            parts = [struct.pack(">qi", o, s) + k for o, s, k in self.leaf]
            places = [0]
            for p in parts:
                places.append(places[-1] + len(p))
            data = struct.pack(f">i{len(places)}i", len(parts), *places) + b"".join(parts)
            self.root.append((*self._put(LEAF, data), self.leaf[0][2], len(self.leaf)))
            self.index_bytes += len(data)
            self.leaf, self.leaf_bytes = [], layout.LEAF_HEADER

    @staticmethod
    def _root(entries) -> bytes:
        return b"".join(struct.pack(">qi", o, s) + writable_vint(len(k)) + k for o, s, k in entries)

    def finish(self) -> dict:
        self._close_block()
        self._close_filter()
        levels = 1
        if self.root:
            self._close_leaf()
            levels = 2
        entries = [e[:3] for e in self.root] if self.root else self.leaf
        data = self._root(entries)
        if levels == 2:
            middle, seen = (sum(e[3] for e in self.root) - 1) // 2, 0
            for o, s, _, n in self.root:
                if middle < seen + n:
                    data += struct.pack(">qii", o, s, middle - seen)
                    break
                seen += n
        load = self.at
        self._put(ROOT, data)
        self._put(META_INDEX, b"")
        n = max(1, self.entries)
        info = {
            "hfile.LASTKEY": self.last or b"", "hfile.AVG_KEY_LEN": struct.pack(">i", self.key_bytes // n), "hfile.AVG_VALUE_LEN": struct.pack(">i", self.value_bytes // n), "hfile.CREATE_TIME_TS": struct.pack(">q", int(time.time() * 1000)),
            "hfile.KEY_OF_BIGGEST_CELL": self.biggest[1], "hfile.LEN_OF_BIGGEST_CELL": struct.pack(">i", self.biggest[0]), "DELETE_FAMILY_COUNT": struct.pack(">q", 0), "HISTORICAL": b"\0",
            "hfile.MAX_TAGS_LEN": struct.pack(">i", 0), "hfile.TAGS_COMPRESSED": b"\0",
        }
        if self.filters:
            info |= {"BLOOM_FILTER_TYPE": self.filter_kind.upper().encode(), "LAST_BLOOM_KEY": self.last_filtered}
        pairs = b"".join(_field(1, _field(1, k.encode()) + _field(2, v)) for k, v in sorted(info.items()))
        info_at, _ = self._put(INFO, b"PBUF" + varint(len(pairs)) + pairs)
        if self.filters:
            head = struct.pack(">iqiiqqi", FILTER_VERSION, sum(f[3] for f in self.filters), self.hashes, HASH_TYPE, self.n_rows, sum(f[4] for f in self.filters), len(self.filters))
            self._put(FILTER_META, head + writable_vint(0) + self._root(f[:3] for f in self.filters))
        fields = (info_at, load, self.index_bytes + len(data), self.raw, len(entries), 0, self.entries, levels, self.first_block, self.last_block, COMPARATOR.encode(), CODECS[self.compression])
        proto = b"".join(_field(k, v) for k, v in enumerate(fields, 1))
        trailer = TRAILER + varint(len(proto)) + proto
        self.out.write(trailer.ljust(TRAILER_SIZE - 4, b"\0") + struct.pack(">i", VERSION))
        return {"entries": self.entries, "levels": levels, "file_bytes": self.at + TRAILER_SIZE, "first_row": None, "last_row": self.last_row}


def _most_keys() -> int:
    """Keys of a filter chunk at the default size and error rate."""
    import math

    bits = layout.CHUNK_BYTES * 8
    return int(-bits / Writer.hashes * math.log(1 - math.exp(math.log(layout.ERROR_RATE) / Writer.hashes)))


def _flush(path: str) -> None:
    handle = os.open(path, os.O_RDONLY)
    try:
        os.fsync(handle)
    finally:
        os.close(handle)


def write(cells: DataFrame, folder: str, compression: str = "gz", level: int = 1, block_size: int = layout.BLOCK_SIZE, bloom_type: str = "row", fsync: str = "safe") -> DataFrame:
    """Write sorted files of disjoint row ranges; path, entries, file_bytes, first_row and last_row of each, when an action runs.

    A file is written under a name of its own and renamed when it is whole; a lost attempt's file is in no result. `fsync` holds where the
    folder is on a local disk: `safe` flushes a file before it is renamed, `paranoid` its folder too, `fast` neither.
    """
    names = ["path", "entries", "file_bytes", "first_row", "last_row"]

    def run(batches):
        system, path = _filesystem(folder)
        system.create_dir(path, recursive=True)
        name, writer, out, first = f"{uuid.uuid4().hex}.cells", None, None, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    out = system.open_output_stream(f"{path}/.tmp-{name}", compression=None)
                    writer = Writer(out, "gz" if compression == "gzip" else compression, level, block_size, _most_keys() if bloom_type != "none" else 0, filter_kind=bloom_type)
                    first = row[0]
                writer.append(*row)
        if writer is not None:
            done = writer.finish()
            out.close()
            if system.type_name == "local" and fsync != "fast":
                _flush(f"{path}/.tmp-{name}")
            system.move(f"{path}/.tmp-{name}", f"{path}/{name}")
            if system.type_name == "local" and fsync == "paranoid":
                _flush(path)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{name}"]), pa.array([done["entries"]], pa.int64()), pa.array([done["file_bytes"]], pa.int64()), pa.array([first], pa.binary()), pa.array([done["last_row"]], pa.binary())], names)

    columns = [f"cast({c} as binary) {c}" for c in ("row", "family", "qualifier")]
    rows = cells.selectExpr(*columns, "cast(ts as long) ts", "cast(type as int) type", "cast(value as binary) value")
    order = ["row", "family", "qualifier", rows["ts"].desc(), rows["type"].desc()]
    return rows.repartitionByRange("row").sortWithinPartitions(*order).mapInArrow(run, "path string, entries long, file_bytes long, first_row binary, last_row binary")


class File:
    """Reads a file back: blocks with their checksums, index, filters, information and trailer."""

    def __init__(self, data: bytes):
        self.data = data
        if struct.unpack(">i", data[-4:])[0] != VERSION or data[-TRAILER_SIZE:][:8] != TRAILER:
            raise ValueError("not a cell file")
        self.trailer = self._proto(self._delimited(data[-TRAILER_SIZE + 8 :]))
        self.codec = self.trailer[12][0]
        magic, root, size = self.block(self.trailer[2][0])
        self.root = self._entries(root, self.trailer[5][0])
        _, info, _ = self.block(self.trailer[1][0])
        pairs = [self._proto(p) for p in self._proto(self._delimited(info[4:]))[1]]
        self.info = {p[1][0].decode(): p[2][0] for p in pairs}

    @staticmethod
    def _varint(data: bytes, at: int = 0) -> tuple[int, int]:
        v = shift = 0
        while True:
            b = data[at]
            v, at, shift = v | (b & 127) << shift, at + 1, shift + 7
            if b < 128:
                return v, at

    def _delimited(self, data: bytes) -> bytes:
        n, at = self._varint(data)
        return data[at : at + n]

    def _proto(self, data: bytes) -> dict[int, list]:
        out: dict[int, list] = {}
        at = 0
        while at < len(data):
            tag, at = self._varint(data, at)
            v, at = self._varint(data, at)
            if tag & 7 == 2:
                v, at = data[at : at + v], at + v
            out.setdefault(tag >> 3, []).append(v)
        return out

    @staticmethod
    def _entries(data: bytes, n: int) -> list[tuple[int, int, bytes]]:
        out, at = [], 0
        for _ in range(n):
            offset, size = struct.unpack_from(">qi", data, at)
            length, used = read_writable_vint(data[at + 12 : at + 22])
            at += 12 + used
            out.append((offset, size, data[at : at + length]))
            at += length
        return out

    def block(self, at: int) -> tuple[bytes, bytes, int]:
        """Magic, content and size of the block at this offset."""
        magic = self.data[at : at + 8]
        on_disk, raw, _, kind, chunk, whole = struct.unpack_from(">iiqbii", self.data, at + 8)
        body = self.data[at : at + whole]
        sums = self.data[at + whole : at + HEADER + on_disk]
        if kind == CHECKSUM_CRC32C and b"".join(struct.pack(">I", c) for c in crc32c(body, chunk)) != sums:
            raise ValueError(f"the block at {at} is damaged")
        content = body[HEADER:]
        return magic, gzip.decompress(content) if self.codec == CODECS["gz"] else content, HEADER + on_disk

    def blocks(self):
        at = 0
        while at < len(self.data) - TRAILER_SIZE:
            magic, content, size = self.block(at)
            yield at, magic, content, size
            at += size

    def data_blocks(self) -> list[tuple[int, int, bytes]]:
        """Index entries of the data blocks."""
        if self.trailer[8][0] == 1:
            return self.root
        out = []
        for offset, _, _ in self.root:
            _, leaf, _ = self.block(offset)
            (n,) = struct.unpack_from(">i", leaf)
            places = struct.unpack_from(f">{n + 1}i", leaf, 4)
            base = 4 + 4 * (n + 1)
            for a, b in zip(places, places[1:]):
                o, s = struct.unpack_from(">qi", leaf, base + a)
                out.append((o, s, leaf[base + a + 12 : base + b]))
        return out

    def cells(self):
        """(row, family, qualifier, ts, type, value) in order."""
        for offset, _, _ in self.data_blocks():
            _, data, _ = self.block(offset)
            at = 0
            while at < len(data):
                k, v = struct.unpack_from(">ii", data, at)
                key, value = data[at + 8 : at + 8 + k], data[at + 8 + k : at + 8 + k + v]
                (n,) = struct.unpack_from(">H", key)
                f = key[2 + n]
                yield key[2 : 2 + n], key[3 + n : 3 + n + f], key[3 + n + f : -9], *struct.unpack(">qB", key[-9:]), value
                at += 10 + k + v

    def may_hold(self, row: bytes, qualifier: bytes = b"") -> bool:
        key = layout.rowcol_key(row, qualifier) if self.info.get("BLOOM_FILTER_TYPE") == b"ROWCOL" else row
        return not self.filters or any(layout.might_contain(c, key, Writer.hashes) for c in self.filters)

    @functools.cached_property
    def filters(self) -> list[bytes]:
        return [c for _, m, c, _ in self.blocks() if m == FILTER]


def layout_parts(path: str) -> list[tuple[str, int]]:
    """Category and bytes of each block and the trailer of a file."""
    system, name = _filesystem(path)
    with system.open_input_stream(name, compression=None) as f:
        file = File(f.read())
    category = {DATA: "DATA", LEAF: "INDEX", ROOT: "INDEX", FILTER: "BLOOM", FILTER_META: "BLOOM", INFO: "FILE_INFO"}
    return [(category[m], s) for _, m, _, s in file.blocks()] + [("TRAILER", TRAILER_SIZE)]
