"""Fixed values of the matching and ranking rules, and the tables that follow from them by rule."""

from __future__ import annotations

import errno
from functools import cache
from math import comb, log10

HASH_BITS = 64
#: Largest --distance that can be asked for.
MAX_DISTANCE = 32
#: How much further apart than --distance a frame may be if other frames agree on its time offset.
LOOSE_MARGIN = 6
#: Offsets this far apart (ms, inclusive) agree.
OFFSET_TOLERANCE_MS = 500
#: Evidence wanted: as improbable as two frames this far apart.
SCHEDULE_DISTANCE, SCHEDULE_FRAMES, SCHEDULE_MOST = 12, 2, 64
#: Mean absolute coefficient below which a frame has no features.
LEAST_ENERGY = 8.0
DEFAULT_DISTANCE, DEFAULT_PERCENT, DEFAULT_MIN_KEYFRAMES = 4, 20.0, 12.0
MOST_FRAME_RATE = 1000.0
#: Clique search gives a component up beyond these.
CLIQUE_BUDGET, CLIQUE_GROUPS = 50_000_000, 100_000
#: Bytes of a file looked at to tell whether it is media.
PROBE_BYTES, PROBE_BYTES_MORE = 2048, 16384
SAMPLES_PER_PROBLEM = 20

# Ranking: metrics in their default order, and how close to the best counts as equal.
METRICS = ("length", "resolution", "quality", "size")
REVIEW_METRICS = ("length", "resolution")
LENGTH_TOLERANCE_S, RELATIVE_TOLERANCE = 1.0, 0.05

# Actions a report may name, and file name extensions looked for by default.
ACTIONS = ("keep", "kept", "review", "delete", "deleted", "unlinked", "moved", "failed", "changed", "skipped")
EXTENSIONS = ("mp4", "m4v", "mkv", "webm", "avi", "mov", "flv", "wmv", "asf", "mpg", "mpeg", "m2ts", "mts", "ts", "vob", "ogv", "3gp", "divx")

# The report's columns, in order.
REPORT_COLUMNS = (
    "group", "action", "full_path", "length", "length_seconds", "resolution", "width", "height", "framerate_fps", "codec", "size", "size_bytes",
    "bitrate", "bitrate_bps", "quality", "quality_bits_per_frame", "matched_with", "samples", "matched_seconds", "matched_from", "matched_to",
    "matched_from_seconds", "matched_to_seconds",
)

# Relative decoding cost of a pixel, bytes' worth and seconds' worth where pixels are unknown.
CODEC_COST = {"hevc": 1.7, "av1": 0.8}
SECONDS_PER_KEYFRAME, COST_PER_BYTE = 2.0, 3.8

# Errno values that say the machine, not the file, was at fault.
TRANSIENT_ERRNO = tuple(
    getattr(errno, x)
    for x in (
        "EPERM", "ENOENT", "EINTR", "EIO", "ENXIO", "EBADF", "EAGAIN", "ENOMEM", "EACCES", "EBUSY", "ENODEV",
        "ENFILE", "EMFILE", "ENOSPC", "EROFS", "ELOOP", "ETIMEDOUT", "ECONNREFUSED", "EHOSTUNREACH", "ENETUNREACH", "ESTALE",
    )
)


@cache
def chance_exponent(distance: int) -> float:
    """How many orders of magnitude below certainty a chance match within `distance` bits is."""
    return HASH_BITS * log10(2) - log10(sum(comb(HASH_BITS, i) for i in range(distance + 1)))


@cache
def witnesses_needed(distance: int) -> int | None:
    """Witnesses that a frame pair at this distance needs; None: no number is enough."""
    want = SCHEDULE_FRAMES * chance_exponent(SCHEDULE_DISTANCE)
    for frames in range(2, SCHEDULE_MOST + 1):
        if frames * chance_exponent(distance) >= want:
            return frames - 1
    return None


def tolerances(distance: int) -> tuple[int, int]:
    """(strict, loose) tolerance for a --distance."""
    if not 0 <= distance <= MAX_DISTANCE:
        raise ValueError(f"distance must be between 0 and {MAX_DISTANCE}")
    return distance, min(distance + LOOSE_MARGIN, HASH_BITS)


def masks(bits: int, radius: int) -> list[int]:
    """All masks of `bits` bits with at most `radius` bits set, by number of bits, then value."""
    from itertools import combinations

    return [sum(1 << b for b in at) for k in range(radius + 1) for at in combinations(range(bits), k)]


def block_plan(distance: int, blocks: int) -> list[tuple[int, int, int]]:
    """(shift, bits, radius) of each block of a hash.

    General pigeonhole: if the radii sum to distance - (blocks - 1), a pair within `distance` has a
    block within its radius.
    """
    spare = max(distance - (blocks - 1), 0)
    out, at = [], 0
    for k in range(blocks):
        bits = HASH_BITS // blocks + (k < HASH_BITS % blocks)
        radius = spare // blocks + (k < spare % blocks) if distance >= blocks - 1 else (0 if k <= distance else -1)
        out.append((at, bits, radius))
        at += bits
    return out


#: What a key, which is shuffled, costs, and what a comparison of the direct route costs, in candidates of the
#: block route (measured on 82,000 hashes).
KEY_WORK, PAIR_WORK = 40, 0.15


def block_work(distance: int, blocks: int, rows: int) -> tuple[float, float]:
    """(keys made, candidates met) for each hash, as estimated for evenly spread hashes."""
    keys = meets = 0.0
    for _, bits, radius in block_plan(distance, blocks):
        if radius >= 0:
            n = sum(comb(bits, i) for i in range(radius + 1))
            keys += n
            meets += n * rows / 2**bits
    return keys + blocks, meets


def best_blocks(distance: int, rows: int) -> int:
    """Number of blocks with the least estimated work."""
    return min(range(2, 17), key=lambda b: work_per_hash(distance, b, rows))


def work_per_hash(distance: int, blocks: int, rows: int) -> float:
    """Estimated work of the block route for each hash, in candidates."""
    keys, meets = block_work(distance, blocks, rows)
    return KEY_WORK * keys + meets
