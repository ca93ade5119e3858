"""Minimal TIFF: single-channel pages in, float32 OME pages out."""

from __future__ import annotations

import struct
from collections.abc import Iterable
from xml.sax.saxutils import quoteattr

import numpy as np

#: Bytes of each field type of a TIFF tag, and its struct code: fixed values of the format.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, OFFSETS, SAMPLES, ROWS, COUNTS, FORMAT = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279, 339
SCAN_RATE = 32841


def pages(raw: bytes) -> list[dict[int, tuple]]:
    """The tags of every page: number to values (text as one str)."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or len(raw) < 8 or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError("this is no TIFF file")
    out: list[dict[int, tuple]] = []
    at = struct.unpack(order + "I", raw[4:8])[0]
    while at:
        n = struct.unpack_from(order + "H", raw, at)[0]
        tags: dict[int, tuple] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
            if kind not in TYPES:
                continue
            size, code = TYPES[kind]
            where = at + 10 + 12 * k
            if size * count > 4:
                where = struct.unpack_from(order + "I", raw, where)[0]
            data = raw[where : where + size * count]
            tags[tag] = (data.rstrip(b"\0").decode("utf-8", "replace"),) if kind == 2 else struct.unpack(order + code * count, data)
        out.append(tags)
        at = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)[0]
    return out


def image(raw: bytes, tags: dict[int, tuple]) -> np.ndarray:
    """An uncompressed page of one sample as float64."""
    if tags.get(COMPRESSION, (1,))[0] != 1 or tags.get(SAMPLES, (1,))[0] != 1:
        raise ValueError("only uncompressed pages of one channel can be read")
    order = "<" if raw[:2] == b"II" else ">"
    kind = {1: "u", 2: "i", 3: "f"}[tags.get(FORMAT, (1,))[0]]
    dtype = np.dtype(f"{order}{kind}{tags[BITS][0] // 8}")
    data = b"".join(raw[a : a + n] for a, n in zip(tags[OFFSETS], tags[COUNTS], strict=True))
    return np.frombuffer(data, dtype).reshape(tags[LENGTH][0], tags[WIDTH][0]).astype(float)


def ome_xml(n: int, height: int, width: int, pixel_size_nm: float, increment: float, times: list[float], channel: str) -> str:
    um = pixel_size_nm * 1e-3
    planes = "".join(f'<Plane TheC="0" TheT="{t}" TheZ="0" DeltaT="{v!r}"/>' for t, v in enumerate(times))
    return (
        '<?xml version="1.0" encoding="UTF-8"?><OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06"><Image ID="Image:0" Name="stack">'
        f'<Pixels ID="Pixels:0" DimensionOrder="XYZCT" Type="float" SizeX="{width}" SizeY="{height}" SizeZ="1" SizeC="1" SizeT="{n}" PhysicalSizeX="{um!r}" PhysicalSizeXUnit="µm" PhysicalSizeY="{um!r}" PhysicalSizeYUnit="µm" PhysicalSizeZ="1.0" TimeIncrement="{increment!r}" TimeIncrementUnit="s">'
        f'<Channel ID="Channel:0:0" Name={quoteattr(channel)} SamplesPerPixel="1"/><TiffData/>{planes}</Pixels></Image></OME>'
    )


def write_ome(path, frames: Iterable[np.ndarray], n: int, pixel_size_nm: float, times: list[float | None], channel: str) -> None:
    """Frames one after another as float32 pages; only one frame is in memory at a time."""
    stamps = [0.0 if t is None else float(t) for t in times] or [0.0] * n
    increment = stamps[1] if len(stamps) > 1 else 0.0
    per_inch = struct.pack("<II", max(1, round(25.4e6 / pixel_size_nm)), 1)
    with open(path, "wb") as f:
        f.write(struct.pack("<2sHI", b"II", 42, 8))
        for k, frame in enumerate(frames):
            h, w = frame.shape
            text = ome_xml(n, h, w, pixel_size_nm, increment, stamps, channel).encode() + b"\0" if k == 0 else b""
            entries = 13 + bool(text)
            extra = f.tell() + 2 + 12 * entries + 4
            res, desc = extra, extra + 8
            data = desc + len(text) + len(text) % 2
            tags = [(WIDTH, 4, 1, w), (LENGTH, 4, 1, h), (BITS, 3, 1, 32), (COMPRESSION, 3, 1, 1), (PHOTOMETRIC, 3, 1, 1)]
            tags += [(DESCRIPTION, 2, len(text), desc)] if text else []
            tags += [(OFFSETS, 4, 1, data), (SAMPLES, 3, 1, 1), (ROWS, 4, 1, h), (COUNTS, 4, 1, h * w * 4), (282, 5, 1, res), (283, 5, 1, res), (296, 3, 1, 2), (FORMAT, 3, 1, 3)]
            f.write(struct.pack("<H", entries))
            for tag, kind, count, value in tags:
                f.write(struct.pack("<HHI", tag, kind, count) + (struct.pack("<HH", value, 0) if kind == 3 else struct.pack("<I", value)))
            f.write(struct.pack("<I", data + h * w * 4 if k + 1 < n else 0))
            f.write(per_inch + text + b"\0" * (len(text) % 2))
            f.write(frame.astype("<f4").tobytes())
