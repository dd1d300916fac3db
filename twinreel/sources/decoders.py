"""Decoders: raw grey frames, PGM and Y4M in pure Python; others plug in by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from twinreel.functions import pixels


@dataclass
class Decoded:
    """Grey frames with their times (ms, None if unknown) and what the header says."""

    frames: list[np.ndarray]
    times: list[int | None]
    width: int
    height: int
    duration: float
    codec: str
    frame_rate: float = 0.0
    extra: dict = field(default_factory=dict)


class NotMedia(ValueError):
    pass


def pgm(data: bytes) -> Decoded:
    """A binary grey map (P5), as a medium of one frame."""
    parts, at = [], 2
    while len(parts) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        parts.append(int(data[at:end]))
        at = end
    w, h, most = parts
    if most > 255 or len(data) < at + 1 + w * h:
        raise NotMedia("not an 8-bit grey map, or cut short")
    frame = np.frombuffer(data, np.uint8, w * h, at + 1).reshape(h, w)
    return Decoded([frame], [None], w, h, 0.0, "pgm")


def y4m(data: bytes) -> Decoded:
    """YUV4MPEG2: the luma planes, at the header's frame rate."""
    head, _, rest = data.partition(b"\n")
    tags = {x[:1]: x[1:].decode() for x in head.split(b" ")[1:] if x}
    w, h = int(tags[b"W"]), int(tags[b"H"])
    num, _, den = tags.get(b"F", "0:0").partition(":")
    rate = int(num) / int(den) if int(den or 0) else 0.0
    chroma = {"420": w * h // 2, "422": w * h, "444": 2 * w * h, "mono": 0}[tags.get(b"C", "420")[:3].replace("mon", "mono")]
    frames, at = [], 0
    while rest.startswith(b"FRAME", at):
        at = rest.index(b"\n", at) + 1
        if len(rest) < at + w * h:
            break
        frames.append(np.frombuffer(rest, np.uint8, w * h, at).reshape(h, w))
        at += w * h + chroma
    times = [int(i * 1000 / rate) if rate else None for i in range(len(frames))]
    return Decoded(frames, times, w, h, len(frames) / rate if rate else 0.0, "rawvideo", rate)


#: Magic bytes -> decoder; add to it to support more.
DECODERS: dict[bytes, Callable[[bytes], Decoded]] = {b"P5": pgm, b"YUV4MPEG2": y4m}


def decode(data: bytes) -> Decoded:
    for magic, decoder in DECODERS.items():
        if data.startswith(magic):
            return decoder(data)
    raise NotMedia("no decoder knows this file")


FRAMES = "path string, seq long, t long, coefficients array<float>, valid boolean, width int, height int, duration double, codec string, frame_rate double, file_size long, problem string"


def fingerprint(files: DataFrame) -> DataFrame:
    """A row for each kept frame of files(path, content): coefficients of its moving area; a file that cannot be
    decoded, or whose frames all lack features, is one row with its problem."""

    def one(path: str, data: bytes) -> list[tuple]:
        blank = (path, None, None, None, None, None, None, None, None, None, len(data))
        try:
            d = decode(data)
        except (ValueError, KeyError, IndexError) as e:
            return [(*blank, f"not media: {e}")]
        kept: list[tuple[int | None, np.ndarray]] = []
        for t, f in zip(d.times, d.frames):
            small = pixels.scale(f)
            if not kept or (small != kept[-1][1]).any():
                kept.append((t, small))
        if not kept:
            return [(*blank, "no frame")]
        block = pixels.coefficients(np.stack([f for _, f in kept]))
        dull = pixels.featureless(block)
        if dull.all():
            return [(*blank, f"all {len(kept)} sampled frames were featureless")]
        return [(path, i, t, c.tolist(), not bad, d.width, d.height, d.duration, d.codec, d.frame_rate, len(data), None) for i, ((t, _), c, bad) in enumerate(zip(kept, block, dull))]

    names = [x.split(" ")[0] for x in FRAMES.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, data in zip(part["path"], part["content"]):
                out = pd.DataFrame(one(path, bytes(data)), columns=names)
                yield out.astype({c: "Int64" for c in ("seq", "t", "width", "height")} | {"valid": "boolean"})

    return files.select("path", "content").mapInPandas(run, FRAMES)
