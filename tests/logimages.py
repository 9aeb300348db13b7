"""Writing small binary logs in the documented layout, to check the reader against data of known values."""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

from apexgrid.sources import logfile as layout

CODES = {"float32": (7, 4), "float16": (7, 2), "int16": (3, 2), "int32": (5, 4), "float64": (8, 8)}
NUMPY_TYPES = {"float32": "<f4", "float16": "<f2", "int16": "<i2", "int32": "<i4", "float64": "<f8"}

@dataclass
class Entry:
    """A channel to write; ``values`` are stored values, before scaling."""

    name: str
    values: Iterable[float] = ()
    kind: str = "float64"
    freq: int = 10
    short: str = ""
    unit: str = ""
    scale: int = 1
    dec_places: int = 0
    shift: int = 0
    mul: int = 1
    codes: tuple[int, int] | None = None
    n_data: int | None = None


@dataclass
class Image:
    entries: list[Entry]
    strings: dict[str, str] = field(default_factory=dict)
    event: dict[str, str] = field(default_factory=dict)
    serial: int = 28299
    version: int = 150
    weight: int = 1100


def log_bytes(image: Image, loop: bool = False, truncate: int = 0) -> bytes:
    """File content: header, event chain, channel list, samples. ``loop`` links the last entry to the first."""
    header = bytearray(layout.HEADER_SIZE)
    header[0] = layout.FIRST_BYTE
    for name, (at, n) in layout.HEADER_STRINGS.items():
        _put(header, at, n, image.strings.get(name, ""))
    struct.pack_into("<I", header, 0x46, image.serial)
    struct.pack_into("<H", header, 0x52, image.version)
    struct.pack_into("<I", header, 0x56, len(image.entries))
    blocks = bytearray()
    if image.event:
        event = bytearray(layout.EVENT_SIZE + 2)
        venue = bytearray(layout.VENUE_SIZE + 2)
        vehicle = bytearray(layout.VEHICLE_SIZE)
        for block, strings in (
            (event, layout.EVENT_STRINGS),
            (venue, layout.VENUE_STRINGS),
            (vehicle, layout.VEHICLE_STRINGS),
        ):
            for name, (at, n) in strings.items():
                _put(block, at, n, image.event.get(name, ""))
        struct.pack_into("<I", vehicle, 192, image.weight)
        at = len(header)
        struct.pack_into("<I", header, layout.EVENT_AT, at)
        struct.pack_into("<I", event, layout.VENUE_POINTER, at + len(event))
        struct.pack_into("<I", venue, layout.VEHICLE_POINTER, at + len(event) + len(venue))
        blocks = event + venue + vehicle
    first = len(header) + len(blocks)
    struct.pack_into("<I", header, layout.CHANNEL_LIST_AT, first if image.entries else 0)
    data_at = first + layout.ENTRY_SIZE * len(image.entries)
    listed, data = bytearray(), bytearray()
    for k, e in enumerate(image.entries):
        raw = np.asarray(list(e.values)).astype(NUMPY_TYPES[e.kind]).tobytes()
        entry = bytearray(layout.ENTRY_SIZE)
        last = k == len(image.entries) - 1
        following = (first if loop else 0) if last else first + layout.ENTRY_SIZE * (k + 1)
        count = len(raw) // np.dtype(NUMPY_TYPES[e.kind]).itemsize if e.n_data is None else e.n_data
        struct.pack_into("<III", entry, 4, following, data_at + len(data), count)
        kind, code = e.codes or CODES[e.kind]
        struct.pack_into("<HHHhhhh", entry, 18, kind, code, e.freq, e.shift, e.mul, e.scale, e.dec_places)
        _put(entry, 32, 32, e.name)
        _put(entry, 64, 8, e.short)
        _put(entry, 72, 12, e.unit)
        listed += entry
        data += raw
    content = bytes(header + blocks + listed + data)
    return content[: len(content) - truncate] if truncate else content


def _put(block: bytearray, at: int, size: int, value: str) -> None:
    raw = value.encode()[:size]
    block[at : at + len(raw)] = raw
