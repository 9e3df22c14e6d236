"""MessagePack of JSON-like values, after the published format."""

from __future__ import annotations

import struct
from datetime import date, datetime


def _sized(n: int, short: tuple[int, int] | None, wide: list[tuple[int, str]]) -> bytes:
    """The head of a value of n parts: (base, limit) of the one-byte form, then (byte, code) of wider ones."""
    if short and n < short[1]:
        return bytes([short[0] | n])
    for mark, code in wide:
        if n < 1 << 8 * struct.calcsize(code):
            return bytes([mark]) + struct.pack(">" + code, n)
    raise ValueError("too long for the format")


def _integer(n: int) -> bytes:
    if -32 <= n < 128:
        return struct.pack(">b" if n < 0 else ">B", n)
    for mark, code in zip((0xCC, 0xCD, 0xCE, 0xCF) if n > 0 else (0xD0, 0xD1, 0xD2, 0xD3), "BHIQ" if n > 0 else "bhiq", strict=True):
        try:
            return bytes([mark]) + struct.pack(">" + code, n)
        except struct.error:
            continue
    raise ValueError(f"{n} has more than 64 bits")


def pack(value) -> bytes:
    """Times become {__datetime__: true, as_str: ISO text}; keys keep their order."""
    if value is None or isinstance(value, bool):
        return {None: b"\xc0", False: b"\xc2", True: b"\xc3"}[value]
    if isinstance(value, int):
        return _integer(value)
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, str):
        data = value.encode()
        return _sized(len(data), (0xA0, 32), [(0xD9, "B"), (0xDA, "H"), (0xDB, "I")]) + data
    if isinstance(value, (bytes, bytearray)):
        return _sized(len(value), None, [(0xC4, "B"), (0xC5, "H"), (0xC6, "I")]) + bytes(value)
    if isinstance(value, (datetime, date)):
        return pack({"__datetime__": True, "as_str": value.isoformat()})
    if isinstance(value, dict):
        return _sized(len(value), (0x80, 16), [(0xDE, "H"), (0xDF, "I")]) + b"".join(pack(x) for item in value.items() for x in item)
    if isinstance(value, (list, tuple)):
        return _sized(len(value), (0x90, 16), [(0xDC, "H"), (0xDD, "I")]) + b"".join(map(pack, value))
    raise TypeError(f"no MessagePack for {type(value).__name__}")


_NUMBERS = {0xCA: "f", 0xCB: "d", 0xCC: "B", 0xCD: "H", 0xCE: "I", 0xCF: "Q", 0xD0: "b", 0xD1: "h", 0xD2: "i", 0xD3: "q"}
_LONG = {0xC4: ("bin", "B"), 0xC5: ("bin", "H"), 0xC6: ("bin", "I"), 0xD9: ("str", "B"), 0xDA: ("str", "H"), 0xDB: ("str", "I"), 0xDC: ("list", "H"), 0xDD: ("list", "I"), 0xDE: ("dict", "H"), 0xDF: ("dict", "I")}


def unpack(data: bytes):
    """The value that ``pack`` has written; times come back as times."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        at += n
        if at > len(data):
            raise ValueError("the data ends within a value")
        return data[at - n : at]

    def read():
        mark = take(1)[0]
        if mark < 0x80 or mark >= 0xE0:
            return mark if mark < 0x80 else mark - 256
        if mark in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[mark]
        if mark in _NUMBERS:
            return struct.unpack(">" + _NUMBERS[mark], take(struct.calcsize(_NUMBERS[mark])))[0]
        if mark in _LONG:
            kind, code = _LONG[mark]
            n = struct.unpack(">" + code, take(struct.calcsize(code)))[0]
        elif mark < 0xC0:
            kind, n = ("dict", mark & 15) if mark < 0x90 else ("list", mark & 15) if mark < 0xA0 else ("str", mark & 31)
        else:
            raise ValueError(f"unknown mark {mark:#x}")
        if kind == "str":
            return take(n).decode()
        if kind == "bin":
            return take(n)
        if kind == "list":
            return [read() for _ in range(n)]
        found = {}
        for _ in range(n):
            key = read()
            found[key] = read()
        return datetime.fromisoformat(found["as_str"]) if found.get("__datetime__") is True else found

    value = read()
    if at != len(data):
        raise ValueError("the data goes on after the value")
    return value
