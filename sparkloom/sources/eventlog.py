"""Training event logs: framed records of scalar summaries, read and written without their library.

A record is its length (8 bytes), a checksum of that (4), the data, a checksum of it (4),
all little-endian. The data is a message in protocol-buffer wire format: wall time
(field 1), step (2), summary (5); a summary holds values (1) of tag (1) and number (2).
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator


def _checksums() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


_CRC = _checksums()


def masked_checksum(data: bytes) -> int:
    """The masked Castagnoli checksum that frames records."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc = crc >> 8 ^ _CRC[(crc ^ byte) & 0xFF]
    crc ^= 0xFFFFFFFF
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def records(data: bytes) -> Iterator[bytes]:
    """The records of a file. Raises ValueError at a length that fails its checksum; a record cut short ends the file."""
    at = 0
    while at + 12 <= len(data):
        length, check = struct.unpack_from("<QI", data, at)
        if check != masked_checksum(data[at : at + 8]):
            raise ValueError(f"no record at byte {at}")
        if at + 16 + length > len(data):
            return
        yield data[at + 12 : at + 12 + length]
        at += 16 + length


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, kind, value) of the fields of a message; fixed-width values come as bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"field of kind {kind}")
        yield number, kind, value


def _number(data: bytes) -> float | None:
    """The single float of a tensor message: as content, or as a list of one."""
    found = None
    for number, kind, value in _fields(data):
        if number in (4, 5) and kind == 2 and len(value) == 4:
            found = struct.unpack("<f", value)[0]
        elif number == 5 and kind == 5:
            found = struct.unpack("<f", value)[0]
    return found


def scalars(data: bytes) -> Iterator[tuple[str, int, float, float]]:
    """(tag, step, wall time, value) of the scalars of a file, in order."""
    for record in records(data):
        wall, step, summaries = 0.0, 0, []
        for number, kind, value in _fields(record):
            if number == 1 and kind == 1:
                wall = struct.unpack("<d", value)[0]
            elif number == 2 and kind == 0:
                step = value - (1 << 64) if value >> 63 else value
            elif number == 5 and kind == 2:
                summaries.append(value)
        for summary in summaries:
            for number, kind, value in _fields(summary):
                if number != 1 or kind != 2:
                    continue
                tag, got = "", None
                for n, k, v in _fields(value):
                    if n == 1 and k == 2:
                        tag = v.decode("utf-8", "replace")
                    elif n == 2 and k == 5:
                        got = struct.unpack("<f", v)[0]
                    elif n == 8 and k == 2:
                        got = _number(v)
                if got is not None:
                    yield tag, step, wall, got


def _as_varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def encode_scalars(rows: Iterable[tuple[str, int, float, float]]) -> bytes:
    """A file of (tag, step, wall time, value), one record each."""
    out = []
    for tag, step, wall, value in rows:
        name = tag.encode()
        one = b"\x0a" + _as_varint(len(name)) + name + b"\x15" + struct.pack("<f", value)
        summary = b"\x0a" + _as_varint(len(one)) + one
        data = b"\x09" + struct.pack("<d", wall) + b"\x10" + _as_varint(step) + b"\x2a" + _as_varint(len(summary)) + summary
        head = struct.pack("<Q", len(data))
        out += [head, struct.pack("<I", masked_checksum(head)), data, struct.pack("<I", masked_checksum(data))]
    return b"".join(out)
