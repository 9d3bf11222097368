"""GIF media columns: an LZW codec, frames with palettes, disposal, transparency and timing, colour histograms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLEAR, END, FIRST, MOST = 256, 257, 258, 4096
#: Stored payloads: samples a row, rows a frame, and hundredths of a second a frame.
WIDTH, HEIGHT, DELAY = 64, 1024, 4
#: Pixels of a screen or a frame that are decoded at most: a file may state 65,535 x 65,535 in a few bytes.
MAX_PIXELS = 1 << 26


def _schedule(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths and bit offsets of the codes after a clear code, for a minimum code size."""
    n = (1 << size) + 2
    w = np.array([size + 1] + [min(12, max(size + 1, (n + j - 1).bit_length())) for j in range(1, MOST + 1)])
    return w, np.concatenate([[0], np.cumsum(w)])


_WIDTHS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def schedule(size: int) -> tuple[np.ndarray, np.ndarray]:
    if size not in _WIDTHS:
        _WIDTHS[size] = _schedule(size)
    return _WIDTHS[size]


def lzw_encode(data: bytes) -> bytes:
    """Variable-width LZW of 8-bit samples: the table is cleared whenever it is full."""
    widths, _ = schedule(8)
    runs: list[list[int]] = [[CLEAR]]
    it = iter(data)
    code = next(it, None)
    full = True
    while full:
        run: list[int] = []
        # the table: code of a phrase and the sample after it, as one number -> code of both
        table: dict[int, int] = {}
        put, get, free, full = run.append, table.get, FIRST, False
        if code is not None:
            for c in it:
                key = code << 8 | c
                longer = get(key)
                if longer is None:
                    put(code)
                    table[key] = free
                    code = c
                    free += 1
                    if free == MOST:
                        full = True
                        break
                else:
                    code = longer
            if not full:
                put(code)
        put(CLEAR if full else END)
        runs.append(run)
    codes = np.concatenate(runs).astype(np.uint32)
    width = np.concatenate([[9], *[widths[: len(r)] for r in runs[1:]]])
    at = np.cumsum(width) - width
    # a code of 12 bits at most touches three bytes; the bits of different codes never meet, so bytes are sums
    shifted, byte, n = codes << (at & 7).astype(np.uint32), at >> 3, -(-int(width.sum()) // 8)
    out = np.bincount(byte, shifted & 255, n + 2) + np.bincount(byte + 1, shifted >> 8 & 255, n + 2) + np.bincount(byte + 2, shifted >> 16, n + 2)
    return out[:n].astype(np.uint8).tobytes()


def lzw_decode(data: bytes, size: int, most: int) -> bytes:
    """At most ``most`` samples of a code stream; tolerates late clear codes and streams that end early."""
    if not 2 <= size <= 8:
        raise ValueError(f"minimum code size {size}")
    clear, end = 1 << size, (1 << size) + 1
    widths, offsets = schedule(size)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    bits = np.concatenate([bits, np.zeros(16, np.uint8)])
    total = 8 * len(data)
    out: list[np.ndarray] = []
    pos, have = 0, 0
    while pos < total and have < most:
        k = int(np.searchsorted(offsets, total - pos, side="right")) - 1
        w, o = widths[:k], offsets[:k] + pos
        if k == 0:
            break
        code = _read(bits, o, w, size)
        stop = np.flatnonzero((code == clear) | (code == end))
        if len(stop) == 0 and k == len(widths):  # the table is full and stays: 12 bits each up to the next stop
            at = int(o[-1] + w[-1])
            tail = at + 12 * np.arange((total - at) // 12)
            more = _read(bits, tail, np.full(len(tail), 12), size)
            code, o, w = np.concatenate([code, more]), np.concatenate([o, tail]), np.concatenate([w, np.full(len(tail), 12)])
            stop = np.flatnonzero((code == clear) | (code == end))
        n = int(stop[0]) if len(stop) else len(code)
        got = _expand(code[:n], clear, most - have)
        out.append(got)
        have += len(got)
        if n == len(code) or code[n] == end:
            break
        pos = int(o[n] + w[n])
    return b"".join(x.tobytes() for x in out)[:most]


def _read(bits: np.ndarray, at: np.ndarray, width: np.ndarray, size: int) -> np.ndarray:
    code = np.zeros(len(at), np.int32)
    for b in range(12):
        if b <= size:
            code |= bits[at + b].astype(np.int32) << b
        elif len(width) and width[-1] > b:
            first = int(np.searchsorted(width, b, side="right"))
            code[first:] |= bits[at[first:] + b].astype(np.int32) << b
    return code


def _expand(code: np.ndarray, clear: int, most: int) -> np.ndarray:
    """The samples of the codes between two clear codes, as far as the code with which there are ``most`` of them.

    Entry clear + 2 + j is what code j gave and one sample more, so a code above the literals copies the output from
    where code j began.  Lengths and samples follow these references by pointer doubling.
    """
    n = len(code)
    ref = code - (clear + 2)
    copy = ref >= 0
    if not copy.any():
        return code.astype(np.uint8)
    if (ref >= np.arange(n)).any():
        raise ValueError("code outside the table")
    here = np.arange(n)
    to = np.where(copy, ref, here)
    length = copy.astype(np.int64)
    while True:
        step = length[to]
        if not step.any():
            break
        length = length + step
        to = to[to]
    length += 1
    start = np.cumsum(length) - length
    if start[-1] >= most:
        n = max(1, int(np.searchsorted(start, most)))
        code, ref, copy, length, start = code[:n], ref[:n], copy[:n], length[:n], start[:n]
    total = int(start[-1] + length[-1])
    src = np.arange(total)
    src -= np.repeat(np.where(copy, start - start[np.where(copy, ref, 0)], 0), length)
    value = np.zeros(total, np.uint8)
    value[start[~copy]] = code[~copy]
    while True:
        nxt = src[src]
        if np.array_equal(nxt, src):
            return value[src]
        src = nxt


def default_palette() -> np.ndarray:
    """256 colours: three bits of red, three of green, two of blue."""
    i = np.arange(256)
    return np.stack([(i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 85], axis=1).astype(np.uint8)


@dataclass
class Frame:
    left: int
    top: int
    index: np.ndarray
    palette: np.ndarray
    delay: int = DELAY
    disposal: int = 1
    transparent: int | None = None


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode_gif(frames: list[Frame], width: int, height: int) -> bytes:
    """A GIF89a file; the first frame's palette is global, others are stored with their frames where they differ."""
    first = frames[0].palette
    out = [b"GIF89a", width.to_bytes(2, "little"), height.to_bytes(2, "little"), b"\xf7\0\0", np.resize(first, (256, 3)).tobytes()]
    for f in frames:
        clear = f.transparent is not None
        out += [b"\x21\xf9\x04", bytes([f.disposal << 2 | clear]), f.delay.to_bytes(2, "little"), bytes([f.transparent or 0]), b"\0"]
        h, w = f.index.shape
        own = f.palette is not first and not np.array_equal(f.palette, first)
        out += [b"\x2c", *(x.to_bytes(2, "little") for x in (f.left, f.top, w, h)), b"\x87" if own else b"\0"]
        out += [np.resize(f.palette, (256, 3)).tobytes() if own else b"", b"\x08", _blocks(lzw_encode(f.index.astype(np.uint8).tobytes()))]
    return b"".join([*out, b"\x3b"])


def decode_gif(data: bytes, max_pixels: int = MAX_PIXELS) -> tuple[int, int, list[Frame]]:
    """Screen width and height, and the stored frames (not yet composed).

    ValueError or IndexError where the file breaks the format, or states a screen or frame of more than ``max_pixels``.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    two = lambda i: data[i] | data[i + 1] << 8
    width, height, flags, at = two(6), two(8), data[10], 13
    if width * height > max_pixels:
        raise ValueError(f"screen of {width} x {height}")
    palette = default_palette()
    if flags & 128:
        n = 2 << (flags & 7)
        palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    frames, delay, disposal, transparent = [], 0, 0, None

    def sub(at: int) -> tuple[bytes, int]:
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = sub(at + 2)
            if label == 0xF9:
                disposal, delay = body[0] >> 2 & 7, body[1] | body[2] << 8
                transparent = body[3] if body[0] & 1 else None
        elif data[at] == 0x2C:
            left, top, w, h, flag = two(at + 1), two(at + 3), two(at + 5), two(at + 7), data[at + 9]
            at += 10
            if w * h > max_pixels:
                raise ValueError(f"frame of {w} x {h}")
            own = palette
            if flag & 128:
                n = 2 << (flag & 7)
                own = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
                at += 3 * n
            size = data[at]
            body, at = sub(at + 1)
            raw = lzw_decode(body, size, w * h)
            index = np.frombuffer(raw.ljust(w * h, b"\0"), np.uint8).reshape(h, w)
            if flag & 64:
                rows = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
                straight = np.empty_like(index)
                straight[rows] = index
                index = straight
            frames.append(Frame(left, top, index, own, delay, disposal, transparent))
            delay, disposal, transparent = 0, 0, None
        else:
            raise ValueError("unknown block")
    return width, height, frames


def compose(width: int, height: int, frames: list[Frame]) -> Iterator[np.ndarray]:
    """The screen (height, width, 4) as each frame is shown: transparency leaves what is below, disposal 2 clears a
    frame's area after it was shown, disposal 3 brings back what was there before."""
    screen = np.zeros((height, width, 4), np.uint8)
    for f in frames:
        before = screen.copy() if f.disposal == 3 else None
        h, w = f.index.shape
        area = screen[f.top : f.top + h, f.left : f.left + w]
        index = f.index[: area.shape[0], : area.shape[1]]
        colours = f.palette[index if len(f.palette) == 256 else np.minimum(index, len(f.palette) - 1)]
        if f.transparent is None:
            area[..., :3], area[..., 3] = colours, 255
        else:
            shown = index != f.transparent
            area[shown, :3], area[shown, 3] = colours[shown], 255
        yield screen.copy()
        if f.disposal == 2:
            area[:] = 0
        elif before is not None:
            screen = before


def histogram(rgba: np.ndarray) -> np.ndarray:
    """64 colour bins (two bits a channel) of the opaque pixels."""
    bins = rgba[..., 0] >> 2 & 48 | rgba[..., 1] >> 4 & 12 | rgba[..., 2] >> 6
    opaque = rgba[..., 3] > 0
    return np.bincount(bins.ravel() if opaque.all() else bins[opaque], minlength=64)


def shown_frames(data: bytes, max_pixels: int = MAX_PIXELS) -> Iterator[tuple[int, Frame, np.ndarray]]:
    """(start, frame, histogram of the composed screen) of every frame of a file, one at a time."""
    w, h, found = decode_gif(data, max_pixels)
    start = 0
    for f, shown in zip(found, compose(w, h, found)):
        yield start, f, histogram(shown)
        start += f.delay


def gif_frames(media: DataFrame, *, id_col: str = "media_id", data_col: str = "data", max_pixels: int = MAX_PIXELS) -> DataFrame:
    """One row per shown frame: ``id, frame, start_cs, delay_cs, width, height, disposal, transparent, histogram, error``.

    width, height: of the frame; histogram: 64 colours of the screen as it is shown.  A null media value has no rows;
    one that can't be decoded, or whose screen or frames exceed ``max_pixels``, has a single row with frame -1 and the
    error.  Times are hundredths of a second from the start.  Frames are composed one at a time.  Repeated rows and
    ids come back as often as they stand; other columns are ignored.
    """

    def run(frames):
        for f in frames:
            rows = []
            for i, data in zip(f["id"], f["data"]):
                if data is None:
                    continue
                try:
                    mine = [
                        (i, k, at, g.delay, g.index.shape[1], g.index.shape[0], g.disposal, g.transparent, hist.tolist(), None)
                        for k, (at, g, hist) in enumerate(shown_frames(bytes(data), max_pixels))
                    ]
                except (ValueError, IndexError) as e:
                    mine = [(i, -1, 0, 0, 0, 0, None, None, None, str(e) or type(e).__name__)]
                rows += mine
            out = pd.DataFrame(rows, columns=["id", "frame", "start_cs", "delay_cs", "width", "height", "disposal", "transparent", "histogram", "error"])
            yield out.astype({"disposal": "Int64", "transparent": "Int64"})

    rows = media.select(F.col(id_col).alias("id"), F.col(data_col).alias("data"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, frame int, start_cs long, delay_cs int, width int, height int, disposal int, transparent int, histogram array<long>, error string")


def store_payload(payload: bytes) -> bytes:
    """A payload of whole rows of WIDTH samples as a timed GIF, HEIGHT rows a frame at most."""
    index = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    palette = default_palette()
    frames = [Frame(0, 0, index[i : i + HEIGHT], palette) for i in range(0, len(index), HEIGHT)]
    return encode_gif(frames, WIDTH, min(len(index), HEIGHT))


def text_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Store every whole text as a GIF, read it back, and describe what was read.

    ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature`` (and ``media``
    where asked for).  Null texts are empty; an empty text is one row of 64 zero samples.  Equal texts give equal
    values; other columns are ignored.  feature: frames and screen, then for each frame as it is composed and shown with
    the palette that was read back: start+delay in hundredths, size@left,top, disposal, transparent index or -, number of
    its colours, and the most frequent of 64.
    """

    def run(frames):
        for f in frames:
            rows = []
            for i, t in zip(f["id"], f["text"]):
                raw = (t or "").encode("utf-8", "surrogatepass")
                payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
                media = store_payload(payload)
                w, h, found = decode_gif(media, max(MAX_PIXELS, len(payload)))
                back = b"".join(g.index.tobytes() for g in found)
                said, start = [f"{len(found)}x{w}x{h}"], 0
                for g, shown in zip(found, compose(w, h, found)):
                    hist = histogram(shown)
                    top = np.argsort(-hist, kind="stable")[:4].tolist()
                    clear = "-" if g.transparent is None else g.transparent
                    said.append(f"{start}+{g.delay}:{g.index.shape[1]}x{g.index.shape[0]}@{g.left},{g.top}:d{g.disposal}:t{clear}:c{int((hist > 0).sum())}:" + ",".join(f"{b}={hist[b]}" for b in top if hist[b]))
                    start += g.delay
                rows.append((i, len(raw), len(back), hashlib.sha256(back).hexdigest(), crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), ";".join(said), media if keep_media else None))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary")
    return out if keep_media else out.drop("media")
