"""Parquet files of dense vectors, made of their few entries and read back as them.

A file holds (node_id int, vector array<float>) with every zero, as any reader of Parquet finds it. Parquet keeps equal values and levels as runs, so a stretch of zeros is one run,
whatever its length: the work and the size follow the entries, not rows times dimension. The runs' lengths are written in five bytes each (as varints may be), so all are made, and read, at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MAGIC, CREATED_BY, CODEC = b"PAR1", "lexspace runs 1", "zstd"
#: Values and entries of a row group, and bytes of a file, beyond which the next is begun. One row, or one row group, may hold more.
GROUP_VALUES, GROUP_ENTRIES, FILE_BYTES = 1 << 24, 1 << 20, 16 << 20
_I32, _I64, _BYTES, _LIST, _STRUCT = 5, 6, 8, 9, 12
_BOOLEANS = (1, 2)
_REQUIRED, _OPTIONAL, _REPEATED = 0, 1, 2
_INT32, _FLOAT, _ZSTD, _PLAIN, _PLAIN_DICTIONARY, _RLE, _RLE_DICTIONARY = 1, 4, 6, 0, 2, 3, 8
_RUN = np.dtype([("length", "u1", 5), ("value", "<u4")])
_LEVEL = np.dtype([("length", "u1", 5), ("value", "u1")])


# --- Thrift's compact protocol, as far as Parquet's headers need it -------------------------------------------------


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _zigzag(n: int) -> bytes:
    return _varint(n << 1 ^ n >> 63)


def _value(kind: int, v) -> bytes:
    if kind in (_I32, _I64):
        return _zigzag(v)
    if kind == _BYTES:
        return _varint(len(v)) + v
    if kind == _LIST:
        of, items = v
        return (bytes([len(items) << 4 | of]) if len(items) < 15 else bytes([240 | of]) + _varint(len(items))) + b"".join(_value(of, x) for x in items)
    return _struct(v)


def _struct(fields: dict[int, tuple[int, object]]) -> bytes:
    """Fields (kind, value) by number, in order."""
    out, last = b"", 0
    for k, (kind, v) in fields.items():
        out, last = out + bytes([k - last << 4 | kind]) + _value(kind, v), k
    return out + b"\0"


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (b[at] & 127) << shift
        at += 1
        if b[at - 1] < 128:
            return n, at
        shift += 7


def _read_struct(b: bytes, at: int) -> tuple[dict, int]:
    """The whole numbers and structs of a struct by number, and where it ends."""
    out, k = {}, 0
    while b[at]:
        k, kind, at = k + (b[at] >> 4), b[at] & 15, at + 1
        if kind in (_I32, _I64):
            n, at = _read_varint(b, at)
            out[k] = n >> 1 ^ -(n & 1)
        elif kind == _STRUCT:
            out[k], at = _read_struct(b, at)
        elif kind == _BYTES:
            n, at = _read_varint(b, at)
            at += n
        elif kind not in _BOOLEANS:
            raise ValueError(f"a page header with a field of kind {kind}")
    return out, at + 1


# --- runs -------------------------------------------------------------------------------------------------------


def _runs(kind: np.dtype, lengths: np.ndarray, values: np.ndarray) -> bytes:
    out, n = np.empty(len(lengths), kind), lengths.astype(np.uint64) << np.uint64(1)
    for k in range(5):
        out["length"][:, k] = (n >> np.uint64(7 * k)).astype(np.uint8) & 127 | (128 if k < 4 else 0)
    out["value"] = values
    return out.tobytes()


def _levels(lengths, values) -> bytes:
    runs = _runs(_LEVEL, np.asarray(lengths), np.asarray(values))
    return len(runs).to_bytes(4, "little") + runs


def _page(kind: int, body: bytes, header: dict) -> tuple[bytes, int]:
    """A page with its header, and their bytes uncompressed."""
    packed = pa.Codec(CODEC).compress(body, asbytes=True)
    head = _struct({1: (_I32, kind), 2: (_I32, len(body)), 3: (_I32, len(packed)), (5 if kind == 0 else 7): (_STRUCT, header)})
    return head + packed, len(head) + len(body)


def _data_page(body: bytes, values: int, encoding: int) -> tuple[bytes, int]:
    return _page(0, body, {1: (_I32, values), 2: (_I32, encoding), 3: (_I32, _RLE), 4: (_I32, _RLE)})


def _chunk(kind: int, encodings: list[int], path: list[bytes], values: int, pages: list[tuple[bytes, int]], at: int, statistics: dict | None = None) -> dict:
    """A column chunk's metadata; at: where its first page stands in the file."""
    size = sum(len(p) for p, _ in pages)
    meta = {1: (_I32, kind), 2: (_LIST, (_I32, encodings)), 3: (_LIST, (_BYTES, path)), 4: (_I32, _ZSTD), 5: (_I64, values), 6: (_I64, sum(n for _, n in pages)), 7: (_I64, size), 9: (_I64, at + size - len(pages[-1][0]))}
    if len(pages) > 1:
        meta[11] = (_I64, at)
    if statistics:
        meta[12] = (_STRUCT, statistics)
    return {2: (_I64, at), 3: (_STRUCT, meta)}


def _row_group(nodes: np.ndarray, lengths: np.ndarray, idx: np.ndarray, val: np.ndarray, dim: int, at: int) -> tuple[bytes, dict]:
    """The bytes and the metadata of one row group; idx ascends within each row, and no val is 0."""
    n = len(nodes)
    keys = nodes.astype("<i4")
    small = {3: (_I64, 0), 5: (_BYTES, keys.max().tobytes()), 6: (_BYTES, keys.min().tobytes())}
    first = _data_page(_levels([n], [1]) + keys.tobytes(), n, _PLAIN)
    # a vector is a new list (level 0) and dim - 1 further elements (level 1)
    rep = _levels(np.tile([1, dim - 1], n), np.tile([0, 1], n)) if dim > 1 else _levels([n], [0])
    found = pa.array(val.astype(np.float32)).dictionary_encode()
    words = np.concatenate([np.zeros(1, "<f4"), found.dictionary.to_numpy().astype("<f4")])
    place = np.repeat(np.arange(n, dtype=np.int64) * dim, lengths) + idx
    runs, value = np.ones(2 * len(place) + 1, np.int64), np.zeros(2 * len(place) + 1, np.uint32)
    runs[::2] = np.diff(np.concatenate([[-1], place, [n * dim]])) - 1
    value[1::2] = found.indices.to_numpy() + 1
    some = runs > 0
    body = rep + _levels([n * dim], [3]) + bytes([32]) + _runs(_RUN, runs[some], value[some])
    second = [_page(2, words.tobytes(), {1: (_I32, len(words)), 2: (_I32, _PLAIN)}), _data_page(body, n * dim, _RLE_DICTIONARY)]
    chunks = [_chunk(_INT32, [_PLAIN, _RLE], [b"node_id"], n, [first], at, small), _chunk(_FLOAT, [_PLAIN, _RLE, _RLE_DICTIONARY], [b"vector", b"list", b"element"], n * dim, second, at + len(first[0]))]
    out = first[0] + second[0][0] + second[1][0]
    return out, {1: (_LIST, (_STRUCT, chunks)), 2: (_I64, first[1] + second[0][1] + second[1][1]), 3: (_I64, n), 5: (_I64, at), 6: (_I64, len(out))}


def _footer(groups: list[dict], rows: int) -> bytes:
    def element(name: bytes, repetition: int | None, kind: int | None = None, children: int = 0, converted: int | None = None, logical: dict | None = None) -> dict:
        every = {1: (_I32, kind), 3: (_I32, repetition), 4: (_BYTES, name), 5: (_I32, children or None), 6: (_I32, converted), 10: (_STRUCT, logical)}
        return {k: v for k, v in every.items() if v[1] is not None}

    schema = [
        element(b"spark_schema", None, children=2), element(b"node_id", _OPTIONAL, _INT32),
        element(b"vector", _OPTIONAL, children=1, converted=3, logical={3: (_STRUCT, {})}), element(b"list", _REPEATED, children=1), element(b"element", _OPTIONAL, _FLOAT),
    ]
    orders = [{1: (_STRUCT, {})}] * 2
    meta = _struct({1: (_I32, 1), 2: (_LIST, (_STRUCT, schema)), 3: (_I64, rows), 4: (_LIST, (_STRUCT, groups)), 6: (_BYTES, CREATED_BY.encode()), 7: (_LIST, (_STRUCT, orders))})
    return meta + len(meta).to_bytes(4, "little") + MAGIC


# --- files ------------------------------------------------------------------------------------------------------


def _parts(lengths: np.ndarray, dim: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows of a row group each."""
    ends, lo, most = np.cumsum(lengths), 0, max(1, GROUP_VALUES // dim)
    while lo < len(lengths):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + GROUP_ENTRIES, "right"))
        hi = min(max(hi, lo + 1), lo + most)
        yield lo, hi
        lo = hi


def files(nodes: np.ndarray, start: np.ndarray, lengths: np.ndarray, idx: np.ndarray, val: np.ndarray, dim: int) -> Iterator[tuple[bytes, int]]:
    """(file, its rows): rows of `dim` values; a row's entries are the `lengths` of (idx, val) from `start` on, which rows may share."""
    body, groups, rows = MAGIC, [], 0
    for lo, hi in _parts(lengths, dim):
        n = lengths[lo:hi]
        take = np.repeat(start[lo:hi] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        own, meta = _row_group(nodes[lo:hi], n, idx[take], val[take], dim, len(body))
        body, rows = body + own, rows + hi - lo
        groups.append(meta)
        if len(body) >= FILE_BYTES or hi == len(lengths):
            yield body + _footer(groups, rows), rows
            body, groups, rows = MAGIC, [], 0


def entries(content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(node_id, idx, val) of the entries other than 0 of a Parquet file of vectors, in parts; a file that `files` didn't make is read value by value."""
    import pyarrow.parquet as pq

    f = pq.ParquetFile(pa.BufferReader(content))
    if f.metadata.created_by != CREATED_BY:
        for g in range(f.metadata.num_row_groups):
            about = f.metadata.row_group(g)
            for b in f.iter_batches(max(1, GROUP_ENTRIES * about.num_rows // max(1, about.column(1).num_values)), [g], ["node_id", "vector"]):
                lists = b.column(1)
                flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy()
                at = np.flatnonzero(flat)
                row = np.repeat(np.arange(len(sizes)), sizes)[at]
                yield b.column(0).to_numpy()[row], at - (np.cumsum(sizes) - sizes)[row], flat[at]
        return

    def page(at: int) -> tuple[dict, bytes, int]:
        head, at = _read_struct(content, at)
        return head, pa.Codec(CODEC).decompress(content[at : at + head[3]], head[2], asbytes=True), at + head[3]

    for g in range(f.metadata.num_row_groups):
        about = f.metadata.row_group(g)
        dim = about.column(1).num_values // about.num_rows
        _, body, _ = page(about.column(0).data_page_offset)
        nodes = np.frombuffer(body, "<i4", offset=len(body) - 4 * about.num_rows)
        _, body, at = page(about.column(1).dictionary_page_offset)
        words = np.frombuffer(body, "<f4")
        _, body, _ = page(at)
        at = 0
        for _ in range(2):  # levels
            at += 4 + int.from_bytes(body[at : at + 4], "little")
        run = np.frombuffer(body, _RUN, offset=at + 1)
        length = np.zeros(len(run), np.int64)
        for k in range(5):
            length |= (run["length"][:, k] & 127).astype(np.int64) << 7 * k
        length >>= 1
        some = np.flatnonzero(run["value"])
        place = (np.cumsum(length) - length)[some]
        yield nodes[place // dim], place % dim, words[run["value"][some]]
