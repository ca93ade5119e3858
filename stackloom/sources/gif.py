"""GIF: a palette writer with LZW, and the drawing of scale bar and time on frames."""

from __future__ import annotations

import struct
from pathlib import Path

import numpy as np

from stackloom.functions.display import BAR_HEIGHT, BAR_LEFT, BAR_UP, FONT, bar_pixels


def heat_palette() -> np.ndarray:
    """256 colours from black through red and yellow to white."""
    k = np.arange(256)
    return np.clip(np.stack([2 * k, 2 * k - 128, 2 * k - 255], 1), 0, 255).astype(np.uint8)


def grey(frame: np.ndarray) -> np.ndarray:
    z = np.where(np.isfinite(frame), frame, 0.0)
    span = z.max() - z.min() if z.size else 0.0
    if span < np.finfo(float).eps:
        return np.zeros(frame.shape, np.uint8)
    return np.clip(np.floor((z - z.min()) * (255 / span) + 1e-9), 0, 255).astype(np.uint8)


def write_text(image: np.ndarray, text: str, y: int, x: int, value: int = 255, size: int = 1) -> None:
    """Text from (y, x) down and right; what would be outside is left out."""
    for ch in text:
        rows = FONT.get(ch, FONT["-"])
        for r, bits in enumerate(rows):
            for c in range(3):
                if int(bits) >> (2 - c) & 1:
                    image[max(0, y + r * size) : max(0, y + (r + 1) * size), max(0, x + c * size) : max(0, x + (c + 1) * size)] = value
        x += 4 * size


def annotate(image: np.ndarray, timestamp: float, pixel_size_nm: float, bar_nm: float = 100.0, scale: float = 1.0) -> np.ndarray:
    """A copy with a white scale bar (none if bar_nm <= 0), its length and the time."""
    out = image.copy()
    if n := bar_pixels(bar_nm, pixel_size_nm, scale):
        top = out.shape[0] - BAR_UP
        out[max(0, top) : max(0, top + BAR_HEIGHT + 1), BAR_LEFT : BAR_LEFT + n + 1] = 255
        write_text(out, f"{bar_nm:g} nm", top - 7, BAR_LEFT)
    write_text(out, f"Time: {timestamp:.2f} s", 40, 10)
    return out


def lzw(indices: bytes) -> bytes:
    """LZW codes of 8-bit indices, packed from the low bit on."""
    clear, end = 256, 257
    out = bytearray()
    bits = count = 0
    width = 9

    def put(code: int) -> None:
        nonlocal bits, count
        bits |= code << count
        count += width
        while count >= 8:
            out.append(bits & 255)
            bits >>= 8
            count -= 8

    table: dict[tuple[int, int], int] = {}
    put(clear)
    nxt = 258
    prefix = indices[0]
    for b in indices[1:]:
        if (code := table.get((prefix, b))) is not None:
            prefix = code
            continue
        put(prefix)
        table[prefix, b] = nxt
        if nxt == 1 << width and width < 12:
            width += 1
        nxt += 1
        if nxt == 4096:
            put(clear)
            table.clear()
            nxt, width = 258, 9
        prefix = b
    put(prefix)
    put(end)
    if count:
        out.append(bits & 255)
    return bytes(out)


def write_gif(path: str | Path, images: list[np.ndarray], delay_ms: int, palette: np.ndarray | None = None) -> None:
    """Images of one size, looping for ever."""
    h, w = images[0].shape
    with open(path, "wb") as f:
        f.write(b"GIF89a" + struct.pack("<HHBBB", w, h, 0xF7, 0, 0) + (heat_palette() if palette is None else palette).tobytes())
        f.write(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00")
        for image in images:
            f.write(b"\x21\xf9\x04\x04" + struct.pack("<HB", delay_ms // 10, 0) + b"\0")
            f.write(b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0) + b"\x08")
            data = lzw(image.tobytes())
            for i in range(0, len(data), 255):
                block = data[i : i + 255]
                f.write(bytes([len(block)]) + block)
            f.write(b"\0")
        f.write(b"\x3b")


def animate(path: str | Path, frames: list[np.ndarray], pixel_size_nm: float, timestamps: list | tuple | None = None, bar_nm: float = 100.0, duration: float = 0.5) -> None:
    """A GIF with bar and times; a time that isn't a number is the frame's index."""
    if not isinstance(timestamps, (list, tuple)) or len(timestamps) != len(frames):
        raise ValueError("there must be a list of one timestamp for each frame")
    images = []
    for i, (frame, t) in enumerate(zip(frames, timestamps, strict=True)):
        try:
            t = float(t)
        except (TypeError, ValueError):
            t = float(i)
        images.append(annotate(grey(frame), t, pixel_size_nm, bar_nm))
    write_gif(path, images, int(duration * 500))
