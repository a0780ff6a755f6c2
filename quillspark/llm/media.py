"""Media columns: copies of images by local descriptors.

Plan: one pass takes the digest of every image, decodes it and describes the corners of
a pyramid (steps of 1.2, down to the smallest level that holds a patch; small images are enlarged
first) by 256 binary intensity tests in a patch turned to its own orientation; equal byte strings collapse. A Hamming table
finds candidates: a key is 11 sampled test bits of a corner and of two of its six nearest, and coarsely how
the two lie; images are candidates if three corners of one key also agree in further bits, and on one turn, scale and shift.
A candidate pair is decided on all its corners: matches within the Hamming bound vote for a turn,
scale and shift, the best vote is fitted by least squares, and the pair is linked if enough
distinct corners agree with the fit. Links become components by star contraction.

All images of a table entry are compared as long as such pairs stay in proportion to the table. In larger
entries they first meet a hub (the image of the least hash, the same in all entries), another one each round, as long as
that halves what is not yet connected; then every two images of an entry that are in different components are
compared, in blocks of bounded size. So no link between components is given up, and true copies, however many, are settled
by their hubs.

Defined results: null, empty or undecodable media have no corners and no links (``status`` says which);
equal bytes link; repeated rows count as copies; an empty table gives an empty result; other columns are
not read. Decodes binary PGM and PPM, and PNG of 8 or 16 bits a sample or with a palette, without interlace.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected_components

#: Corners of a level at full size, and of any level at least; the pyramid's step; radius of a patch.
KEYPOINTS, LEAST, STEP, TESTS, RADIUS = 26, 18, 1.2, 256, 12
#: Images whose longer side is under this are enlarged first, in steps, up to it.
SMALL = 96
#: Bits of 256 that matched corners may differ in; agreeing corners that link two images; their distance from the fit in pixels.
MAX_BITS, VOTES, FIT = 40, 7, 3.0
#: Corners of one spot lie in one square of so many pixels.
SPOT = 6.0
#: Neighbours of which every two make a key with their corner, and sampled bits of each of the three in it.
NEIGHBOURS, KEY_BITS = 6, 11
#: Of the three corners of a key: words of tests that are compared, bits of them all that may differ, and by how many pixels
#: of the level they may be off their best fit, by what angle their turns, by what factor (its logarithm) its scale.
WORDS, NEAR_BITS, NEAR_FIT, NEAR_TURN, NEAR_SCALE = 2, 34, 2.0, 0.4, 0.25
#: Tests that key bits are sampled from.
TELLING = 64
#: Rows of a table entry up to which all pairs of it are candidates; larger entries too, while they together make up to so many pairs a row of the table.
PAIRS, PAIRS_A_ROW = 24, 1.0
#: Components of an entry, and images of a component in an entry, that meet as many others at a time.
BLOCK = 256
#: Images whose entries are made at a time, images of one size that are described at a time, and keys held at a time: bound a worker's memory.
PORTION, STACK, KEYS = 256, 16, 1 << 22
#: Rows up to which a side is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 1_500_000
#: Least and most bits of the filter that keys shared by no two images rarely pass (8 to 64 MB), and bits for each key that is shared.
FILTER_BITS, MOST_FILTER_BITS, BITS_A_KEY = 1 << 26, 1 << 29, 32
#: Longest header of a PGM or PPM that is read.
HEADER = 4096
CORNER = np.dtype([("x", "<f4"), ("y", "<f4"), ("scale", "<f4"), ("turn", "<f4"), ("bits", "<u8", 4)])
#: What an entry says of its three corners.
SIGHT = np.dtype([("scale", "<f4"), ("x", "<f4", 3), ("y", "<f4", 3), ("turn", "<f4", 3), ("bits", "<u8", (3, WORDS))])


def status(data: bytes | None) -> str:
    """none, unsupported (a known format that is not read), broken, or decoded."""
    if not data:
        return "none"
    if decode(data) is not None:
        return "decoded"
    known = (b"\xff\xd8\xff", b"GIF8", b"BM", b"RIFF", b"II*\0", b"MM\0*", b"\x89PNG")
    return "unsupported" if data.startswith(known) else "broken"


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values (float32, rows by columns), or None."""
    try:
        if not data:
            return None
        if data[:2] in (b"P5", b"P6"):
            return _netpbm(data)
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
    except (ValueError, TypeError, KeyError, IndexError, struct.error, zlib.error):
        pass
    return None


def _netpbm(data: bytes) -> np.ndarray | None:
    head, at = [], 2
    top = data[:HEADER]
    while len(head) < 3:
        while at < len(top) and (top[at : at + 1].isspace() or top[at : at + 1] == b"#"):
            at = top.find(b"\n", at) + 1 or len(top) if top[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(top) and not top[end : end + 1].isspace():
            end += 1
        if end >= len(top):
            return None  # the header is cut off
        head.append(int(top[at:end]))
        at = end
    w, h, most = head
    n, kind = (1 if data[1:2] == b"5" else 3), (np.uint8 if most < 256 else np.dtype(">u2"))
    if min(w, h, most) < 1 or most > 65535:
        return None
    px = np.frombuffer(data, kind, w * h * n, at + 1).reshape(h, w, n)
    return px.mean(axis=2, dtype=np.float32) * np.float32(255 / most)


def _png(data: bytes) -> np.ndarray | None:
    at, body, head, palette = 8, [], None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    w, h, depth, colour, _, _, interlace = head
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    if depth not in (8, 16) or interlace or min(w, h) < 1:
        return None
    size = depth // 8
    raw = zlib.decompressobj().decompress(b"".join(body), h * (w * n * size + 1))
    px = _unfilter(raw, w, h, n * size)[:, :, ::size]  # of 16 bits the upper 8
    if colour == 3:
        return palette[px[:, :, 0]].mean(axis=2, dtype=np.float32)
    return px[:, :, : 1 if n < 3 else 3].mean(axis=2, dtype=np.float32)


def _unfilter(raw: bytes, w: int, h: int, n: int) -> np.ndarray:
    rows = np.frombuffer(raw, np.uint8, h * (w * n + 1)).reshape(h, w * n + 1)
    out, up = np.zeros((h, w * n), np.uint8), np.zeros(w * n, np.uint8)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:]
        if kind == 1:
            line = np.cumsum(line.reshape(w, n), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            line = line + up
        elif kind in (3, 4):
            line = np.frombuffer(_sequential(line.tobytes(), up.tobytes(), n, int(kind)), np.uint8)
        out[y] = up = line
    return out.reshape(h, w, n)


def _sequential(line: bytes, up: bytes, n: int, kind: int) -> bytearray:
    """A row of filter 3 or 4: every byte depends on the one before of its channel."""
    out = bytearray(line)
    for x in range(len(out)):
        a, b, c = (out[x - n], up[x], up[x - n]) if x >= n else (0, up[x], 0)
        if kind == 3:
            guess = (a + b) >> 1
        else:
            pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
        out[x] = (out[x] + guess) & 255
    return out


#: Of one worker process. A plain table: a function under a cache of functools would be sent to executors by its name only.
_HELD: dict[tuple[int, int], np.ndarray] = {}


def _resampling(n: int, m: int) -> np.ndarray:
    """Matrix from n samples to m: triangular weights as wide as a sample of the coarser side."""
    if (n, m) not in _HELD:
        if len(_HELD) >= 256:
            _HELD.clear()
        _HELD[n, m] = _matrix(n, m)
    return _HELD[n, m]


def _matrix(n: int, m: int) -> np.ndarray:
    ratio = n / m
    centre = (np.arange(m) + 0.5) * ratio - 0.5
    w = np.clip(1 - np.abs(np.arange(n)[None, :] - centre[:, None]) / max(ratio, 1.0), 0, None)
    return (w / w.sum(axis=1, keepdims=True)).astype(np.float32)


def resize(img: np.ndarray, h: int, w: int) -> np.ndarray:
    return img if img.shape[-2:] == (h, w) else _resampling(img.shape[-2], h) @ img @ _resampling(img.shape[-1], w).T


def _framed(img: np.ndarray, r: int) -> np.ndarray:
    """Images with their edges repeated r times."""
    out = np.empty((*img.shape[:-2], img.shape[-2] + 2 * r, img.shape[-1] + 2 * r), img.dtype)
    out[..., r:-r, r:-r] = img
    out[..., :r, r:-r], out[..., -r:, r:-r] = img[..., :1, :], img[..., -1:, :]
    out[..., :r], out[..., -r:] = out[..., r : r + 1], out[..., -r - 1 : -r]
    return out


def _over(img: np.ndarray, r: int, step: np.ufunc) -> np.ndarray:
    """A running step over squares of side 2r + 1 that lie in the image."""
    h, w = img.shape[-2] - 2 * r, img.shape[-1] - 2 * r
    rows = img[..., :h, :].copy()
    for k in range(1, 2 * r + 1):
        step(rows, img[..., k : k + h, :], out=rows)
    out = rows[..., :w].copy()
    for k in range(1, 2 * r + 1):
        step(out, rows[..., k : k + w], out=out)
    return out


def _pattern() -> np.ndarray:
    rng = np.random.default_rng(20240517)
    return np.clip(rng.normal(0, RADIUS / 2.5, (TESTS, 4)), -RADIUS * 0.7, RADIUS * 0.7)


def _patch() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    yy, xx = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
    disc = (xx**2 + yy**2 <= RADIUS**2).astype(np.float32)
    return yy, xx, (disc * yy).astype(np.float32), (disc * xx).astype(np.float32)


PATTERN, PATCH = _pattern(), _patch()


def describe(img: np.ndarray, keypoints: int = KEYPOINTS) -> np.ndarray:
    """Corners: x and y in pixels of the image, the level's scale, turn in radians, 256 test bits."""
    return _corners(img.astype(np.float32)[None], keypoints)[0]


def describe_all(imgs: list[np.ndarray | None], keypoints: int = KEYPOINTS) -> list[np.ndarray | None]:
    """The corners of each image; images of one size are described together."""
    out, sizes = [None] * len(imgs), {}
    for k, img in enumerate(imgs):
        if img is not None:
            sizes.setdefault(img.shape, []).append(k)
    for (h, w), which in sizes.items():
        step = max(1, min(STACK, STACK * SMALL * SMALL // (h * w)))
        for at in range(0, len(which), step):
            part = which[at : at + step]
            for k, made in zip(part, _corners(np.stack([imgs[k] for k in part]).astype(np.float32), keypoints)):
                out[k] = made
    return out


def _corners(imgs: np.ndarray, keypoints: int) -> list[np.ndarray]:
    """Corners of each of the images of one size."""
    edge, pattern = RADIUS + 1, PATTERN
    yy, xx, by_y, by_x = PATCH
    found, out = [], []
    scale, full = 1.0, imgs.shape[1:]
    while max(full) * scale * STEP <= SMALL:
        scale *= STEP
    while True:
        h, w = round(full[0] * scale), round(full[1] * scale)
        if min(h, w) <= 2 * edge + 2:
            break
        smooth = resize(imgs, h, w)
        for _ in range(2):
            smooth = _over(_framed(smooth, 1), 1, np.add)
        smooth = smooth / np.float32(81)
        # only what lies in the edge is a corner: the gradients around that are enough
        near = smooth[:, edge - 3 : 3 - edge, edge - 3 : 3 - edge]
        gy, gx = (near[:, 2:, 1:-1] - near[:, :-2, 1:-1]) / np.float32(2), (near[:, 1:-1, 2:] - near[:, 1:-1, :-2]) / np.float32(2)
        a, b, c = (_over(v, 2, np.add) / np.float32(25) for v in (gx * gx, gy * gy, gx * gy))
        core = a * b - c * c - np.float32(0.05) * (a + b) ** 2
        around = np.full((len(core), h - 2 * edge + 4, w - 2 * edge + 4), -np.inf, np.float32)
        around[:, 2:-2, 2:-2] = core
        which, ys, xs = np.nonzero((core == _over(around, 2, np.maximum)) & (core > 1.0))
        best = np.lexsort((-core[which, ys, xs], which))
        first = np.searchsorted(which, np.arange(len(imgs)))
        best = best[np.arange(len(best)) - first[which] < max(LEAST, int(keypoints * min(1.0, scale)))]
        which, ys, xs = which[best], ys[best] + edge, xs[best] + edge
        if len(ys):
            flat, at = smooth.ravel(), (which * h + ys) * w + xs
            patch = flat[at[:, None, None] + (yy * w + xx)]
            turn = np.arctan2((patch * by_y).sum(axis=(1, 2)), (patch * by_x).sum(axis=(1, 2)))
            cos, sin = np.cos(turn)[:, None], np.sin(turn)[:, None]
            sample = []
            for k in (0, 2):
                px, py = pattern[None, :, k], pattern[None, :, k + 1]
                sample.append(flat[at[:, None] + (np.rint(px * sin + py * cos) * w + np.rint(px * cos - py * sin)).astype(int)])
            made = np.empty(len(ys), CORNER)
            made["x"], made["y"], made["scale"], made["turn"] = (xs + 0.5) / scale - 0.5, (ys + 0.5) / scale - 0.5, scale, turn
            made["bits"] = np.packbits(sample[0] < sample[1], axis=1, bitorder="little").view("<u8")
            found.append(which)
            out.append(made)
        scale /= STEP
    if not out:
        return [np.empty(0, CORNER) for _ in imgs]
    which = np.concatenate(found)
    order = np.argsort(which, kind="stable")
    return np.split(np.concatenate(out)[order], np.searchsorted(which[order], np.arange(1, len(imgs))))


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of words."""
    h = np.full(len(parts[0]), 0x9E3779B97F4A7C15, np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F)
        h = h ^ (h >> np.uint64(29))
    return h


def _masks() -> np.ndarray:
    """Sampled bits of the corner and of its neighbours."""
    rng = np.random.default_rng(20)
    bits = np.zeros((2, TESTS), np.uint8)
    # a patch is turned so that its bright side lies along x: tests along x mostly say that again, tests across
    # it say more, and tests of far points waver less
    ahead, across = np.abs(PATTERN[:, 0] - PATTERN[:, 2]), np.abs(PATTERN[:, 1] - PATTERN[:, 3])
    telling = np.argsort(ahead - across, kind="stable")[:TELLING]
    for side in range(2):
        bits[side, rng.permutation(telling)[:KEY_BITS]] = 1
    return np.packbits(bits, axis=-1, bitorder="little").view("<u8")


MASKS = _masks()
#: Every two of a corner's neighbours.
TWO = np.array(list(itertools.combinations(range(NEIGHBOURS), 2))).T


def pair_keys(made: np.ndarray) -> dict[str, np.ndarray]:
    """Entries of the table: key ``v`` and the three corners, the two neighbours in an order that their own bits and places give."""
    n = len(made)
    if n < 3:
        return {"points": np.empty((0, 3), np.int64), "v": np.empty(0, np.uint64)}
    x, y, scale, turn, bits = (made[k] for k in ("x", "y", "scale", "turn", "bits"))
    dx, dy = x[None, :] - x[:, None], y[None, :] - y[:, None]
    far = np.hypot(dx, dy) * scale[:, None]
    far[(scale[:, None] != scale[None, :]) | (far < 3)] = np.inf
    near = np.argsort(far, axis=1, kind="stable")[:, :NEIGHBOURS]
    if n < NEIGHBOURS:
        near = np.pad(near, ((0, 0), (0, NEIGHBOURS - n)), mode="edge")
    i, j = np.repeat(np.arange(n), NEIGHBOURS), near.ravel()
    held = np.isfinite(far[i, j])
    eighth = lambda angle: np.floor(np.mod(angle, 2 * np.pi) / (np.pi / 4)).astype(np.int64)
    lies = eighth(np.arctan2(dy[i, j], dx[i, j]) - turn[i]) + 8 * eighth(turn[j] - turn[i]) + 64 * np.floor(np.log2(np.where(held, far[i, j], 4)) * 1.5).astype(np.int64)
    masks = MASKS
    own = _mixed(*(bits & masks[0]).T)
    other, held = _mixed(lies, *(bits & masks[1])[j].T).reshape(n, -1), held.reshape(n, -1)
    (one, two), (p, q) = TWO, (near[:, k] for k in TWO)
    held = held[:, one] & held[:, two] & (p != q)
    swap = other[:, one] > other[:, two]
    points = np.stack([np.broadcast_to(np.arange(n)[:, None], p.shape), np.where(swap, q, p), np.where(swap, p, q)], axis=2)[held]
    return {"points": points, "v": (own[:, None] + (other[:, one] + other[:, two]))[held]}


def sights(made: np.ndarray, points: np.ndarray) -> np.ndarray:
    """What entries say of their corners, for ``alike``."""
    out = np.empty(len(points), SIGHT)
    out["scale"] = made["scale"][points[:, 0]]
    for k in ("x", "y", "turn"):
        out[k] = made[k][points]
    out["bits"] = made["bits"][:, :WORDS][points]
    return out


def alike(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which sights of entries with equal keys agree: in bits, and on one turn, scale and shift."""
    out = np.bitwise_count(p["bits"] ^ q["bits"]).sum(axis=(1, 2), dtype=np.int64) <= NEAR_BITS
    p, q = p[out], q[out]
    za, zb = p["x"] + 1j * p["y"], q["x"] + 1j * q["y"]
    za, zb = za - za.mean(axis=1, keepdims=True), zb - zb.mean(axis=1, keepdims=True)
    alpha = (np.conj(za) * zb).sum(axis=1) / np.maximum((np.abs(za) ** 2).sum(axis=1), 1e-9)
    off = np.abs(alpha[:, None] * za - zb).max(axis=1) * q["scale"]
    turn = np.abs(np.mod(q["turn"] - p["turn"] - np.angle(alpha)[:, None] + np.pi, 2 * np.pi) - np.pi).max(axis=1)
    grow = np.abs(np.log(np.maximum(np.abs(alpha), 1e-9) * q["scale"] / p["scale"]))
    out[out] = (off <= NEAR_FIT) & (turn <= NEAR_TURN) & (grow <= NEAR_SCALE)
    return out


def agreement(p: np.ndarray, q: np.ndarray, max_bits: int = MAX_BITS) -> int:
    """Distinct spots with corners of two images that agree on one turn, scale and shift."""
    if not len(p) or not len(q):
        return 0
    apart = np.bitwise_count(p["bits"][:, None, :] ^ q["bits"][None, :, :]).sum(axis=2, dtype=np.int64)
    i, j = np.nonzero(apart <= max_bits)
    if len(i) < 2:
        return len(i)
    turn, grow = np.mod(q["turn"][j] - p["turn"][i], 2 * np.pi), p["scale"][i] / q["scale"][j]
    za, zb = p["x"][i] + 1j * p["y"][i], q["x"][j] + 1j * q["y"][j]
    shift = zb - grow * np.exp(1j * turn) * za
    reach = 0.2 * max(np.ptp(q["x"]), np.ptp(q["y"]), 40.0)
    if len(np.unique(i)) < 2:
        return 1
    place, parts = None, (turn / (np.pi / 6), np.log(grow) / (2 * np.log(STEP)), shift.real / reach, shift.imag / reach)
    for g in range(16):  # bins of every quantity twice, half a bin apart
        bins = [np.floor(v + 0.5 * (g >> k & 1)).astype(np.int64) for k, v in enumerate(parts)]
        code = ((bins[0] % 12) * 64 + bins[1] % 64) * 4096 + (bins[2] % 64) * 64 + bins[3] % 64
        order = np.sort(code)
        first = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
        n = np.diff(np.append(first, len(order)))
        if place is None or n.max() > len(place):
            place = np.flatnonzero(code == order[first[n.argmax()]])
    for _ in range(3):  # fit zb = alpha za + beta, and take what lies near the fit
        if len(np.unique(i[place])) < 2:
            break
        ma, mb = za[place].mean(), zb[place].mean()
        spread = (np.abs(za[place] - ma) ** 2).sum()
        if spread <= 0:
            break
        alpha = (np.conj(za[place] - ma) * (zb[place] - mb)).sum() / spread
        off = np.abs(alpha * (za - ma) + mb - zb)
        # a corner of a coarse level is known to that level's pixels only
        fine = (off <= FIT / np.minimum(1.0, np.minimum(p["scale"][i] * 1.0, q["scale"][j]))) & (np.abs(np.log(np.maximum(np.abs(alpha), 1e-9) / grow)) <= 1.5 * np.log(STEP))
        if not fine.any() or np.array_equal(np.flatnonzero(fine), place):
            break
        place = np.flatnonzero(fine)
    # one spot may have a corner in several levels: it counts once
    spots = lambda m, k: len(np.unique(np.rint(m["x"][k] / SPOT) + 1j * np.rint(m["y"][k] / SPOT)))
    return min(spots(p, i[place]), spots(q, j[place]))


def pictures(images: DataFrame, keypoints: int = KEYPOINTS) -> DataFrame:
    """``images(node, media)`` -> (node, digest: null without media, status, corners: the packed corners of the image, null if there are none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PORTION):
                part = batch.slice(at, PORTION)
                media = part.column(1).to_pylist()
                imgs = [decode(data) for data in media]
                state = ["decoded" if img is not None else status(data) for data, img in zip(media, imgs)]
                made = [m.tobytes() if m is not None and len(m) else None for m in describe_all(imgs, keypoints)]
                digest = [hashlib.sha256(data).digest() if data else None for data in media]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digest, pa.binary()), pa.array(state), pa.array(made, pa.binary())], names=["node", "digest", "status", "corners"])

    return images.select("node", "media").mapInArrow(run, "node long, digest binary, status string, corners binary")


def _buckets(images: int) -> int:
    """Bits that the buckets of so many images' keys are numbered by: about 4,096 images' keys in a bucket, 64 buckets at least."""
    return min(24, max(6, (images // 4096).bit_length()))


def _shared_keys(made: DataFrame, bucket_bits: int) -> DataFrame:
    """``(bucket, n, keys)``: of the keys' first bits, a bucket's number and 32 more, those that two images or more have. Only these
    32 bits travel, sorted and byte by byte, each of a portion of images twice at most."""
    rest = np.uint64(32 - bucket_bits)

    def gathered(held: list[np.ndarray]) -> pa.RecordBatch:
        g = np.sort(np.concatenate(held))
        if len(g) > 2:
            g = g[np.concatenate([[True, True], g[2:] != g[:-2]])]
        ends = np.searchsorted(g, np.arange(1, 1 << bucket_bits, dtype=np.uint64) << np.uint64(32))
        parts = [(k, p) for k, p in enumerate(np.split(g, ends)) if len(p)]
        keys = [p.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for _, p in parts]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array(keys, pa.binary())], names=["bucket", "keys"])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for data in batch.column(0):
                held.append(np.unique(pair_keys(np.frombuffer(data.as_py(), CORNER))["v"] >> rest))
                n += len(held[-1])
                if n > KEYS:
                    yield gathered(held)
                    held, n = [], 0
        if n:
            yield gathered(held)

    def met(table: pa.Table) -> pa.Table:
        planes = [np.frombuffer(k, np.uint8).reshape(4, -1).T for k in table.column("keys").to_pylist()]
        g = np.sort(np.concatenate(planes).copy().view("<u4").ravel())
        again = g[1:] == g[:-1]
        g = np.unique(g[1:][again])
        return pa.table({"bucket": table.column("bucket")[:1], "n": pa.array([len(g)], pa.int64()), "keys": pa.array([g.tobytes()], pa.binary())})

    return made.select("corners").mapInArrow(sent, "bucket int, keys binary").groupBy("bucket").applyInArrow(met, "bucket int, n long, keys binary")


def _places(g: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a filter of so many bits that stand for each key's first bits."""
    h = _mixed(g)
    return (h & np.uint64(size - 1)).view(np.int64), (h >> np.uint64(32) & np.uint64(size - 1)).view(np.int64)


def _filter_of(shared: DataFrame) -> np.ndarray:
    """The filter of ``shared(bucket, n, keys)``: or-ed in Spark, its size bounded however many keys there are."""
    n = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = min(MOST_FILTER_BITS, max(FILTER_BITS, 1 << (n * BITS_A_KEY).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = np.unique(np.concatenate(_places(np.frombuffer(keys, "<u4").astype(np.uint64) | np.uint64(bucket << 32), size)))
                if len(at):
                    w = at >> 6
                    first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                    b = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(w[first], pa.int32()), pa.array(b)], names=["w", "b"])

    found = shared.select("bucket", "keys").mapInArrow(run, "w int, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[found["w"].to_numpy()] = found["b"].to_numpy()
    return bits.view(np.uint64)


def _entries(made: DataFrame, bits: np.ndarray, bucket_bits: int) -> DataFrame:
    """Table entries of all images whose key has its bits in the filter."""
    shared, rest = made.sparkSession.sparkContext.broadcast(bits), np.uint64(32 - bucket_bits)

    def of(node: int, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, held = pair_keys(corners), True
        for at in _places(keys["v"] >> rest, 64 * len(shared.value)):
            held = held & (shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) == 1)
        v = keys["v"][held].view(np.int64)
        return v, np.full(len(v), node), sights(corners, keys["points"][held])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PORTION):
                part = batch.slice(at, PORTION)
                made = [of(node, np.frombuffer(data, CORNER)) for node, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                key, node, sight = (np.concatenate(p) for p in zip(*made))
                ends = pa.py_buffer(np.arange(len(sight) + 1, dtype=np.int32) * np.int32(SIGHT.itemsize))
                sight = pa.Array.from_buffers(pa.binary(), len(sight), [None, ends, pa.py_buffer(sight.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), sight], names=["key", "node", "sight"])

    return made.select("node", "corners").mapInArrow(run, "key long, node long, sight binary")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


PLACE = ["sight"]


def _evidence(met: DataFrame) -> DataFrame:
    """``met(p, fp, q, fq)`` of images and their corners as evidence ``(a, b, fa, fb)``, the lesser image first."""
    first = F.col("p") < F.col("q")
    sides = [F.when(first, F.col(x)).otherwise(F.col(y)).alias(n) for x, y, n in (("p", "q", "a"), ("q", "p", "b"), ("fp", "fq", "fa"), ("fq", "fp", "fb"))]
    return met.where("p != q").select(*sides)


def _sided(rows: DataFrame, side: str, *columns: str) -> DataFrame:
    return rows.select(*columns, F.col("node").alias(side), F.struct(*PLACE).alias(f"f{side}"))


def _together(rows: DataFrame) -> DataFrame:
    """Evidence of all pairs of images in one entry of ``rows(key, node, sight)``."""
    return _sided(rows, "a", "key").join(_sided(rows, "b", "key"), "key").where("a < b").select("a", "b", "fa", "fb")


def _with_hubs(rows: DataFrame, turn: int) -> DataFrame:
    """Evidence of each entry's hub and the images of ``rows(.., c)`` in it that are in another component than the hub."""
    hub = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", *PLACE, "c")).alias("hub"))
    hub = hub.select("key", F.col("hub.node").alias("q"), F.struct(*[F.col(f"hub.{k}").alias(k) for k in PLACE]).alias("fq"), F.col("hub.c").alias("d"))
    return _evidence(_sided(rows, "p", "key", "c").join(hub, "key").where("c != d"))


def _across(rows: DataFrame, block: int) -> DataFrame:
    """Evidence of all pairs of images of ``rows(.., c)`` in one entry that are in different components c. Components meet in
    blocks, and so do the images of two components: no task holds an entry, and copies of one component are not paired."""
    classes = rows.groupBy("key", "c").agg(F.count("*").alias("n"))
    several = classes.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").withColumn("slots", F.ceil(F.col("m") / block))
    classes = classes.join(several, "key").withColumn("at", F.pmod(F.xxhash64("c"), "slots")).withColumn("n", F.ceil(F.col("n") / block))
    # every two blocks of components meet once, at the lesser and the greater of their places
    dealt = classes.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1))).select("key", F.least("at", "o").alias("i"), F.greatest("at", "o").alias("j"), "at", "c", "n")
    p, q = (dealt.select("key", "i", "j", *[F.col(k).alias(k + side) for k in ("at", "c", "n")]) for side in "pq")
    met = p.join(q, ["key", "i", "j"]).where("cp < cq and (atp = atq) = (i = j)")
    parts = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    met = met.select("key", "cp", "cq", "nq", parts("np").alias("kp")).select("key", "cp", "cq", "kp", parts("nq").alias("kq"))
    rows = rows.join(classes.select("key", "c", "n"), ["key", "c"]).withColumn("k", F.pmod(F.xxhash64("node"), "n"))
    for side in "pq":
        met = met.join(_sided(rows, side, "key", F.col("c").alias(f"c{side}"), F.col("k").alias(f"k{side}")), ["key", f"c{side}", f"k{side}"])
    return _evidence(met)


def _agreeing(evidence: DataFrame) -> DataFrame:
    """Pairs (a, b) of which a piece of evidence agrees in bits, and on one turn, scale and shift."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = (np.frombuffer(b"".join(batch.column(k).to_pylist()), SIGHT) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(alike(p, q)))

    return evidence.select("a", "b", F.col("fa.sight").alias("p"), F.col("fb.sight").alias("q")).mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, made: DataFrame, votes: int) -> DataFrame:
    """Pairs ``(a, b, votes)`` whose images agree in enough corners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [agreement(np.frombuffer(p, CORNER), np.frombuffer(q, CORNER)) for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32())], names=["a", "b", "votes"])

    side = lambda n: made.select(F.col("node").alias(n), F.col("corners").alias(f"c{n}"))
    # only the corners of images that are in a pair travel
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    made = made.join(_small(asked), "node", "left_semi")
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ca", "cb")
    return both.mapInArrow(run, "a long, b long, votes int").where(F.col("votes") >= votes)


def _all_pairs_up_to(sizes: DataFrame, rows: int) -> int:
    """Rows of an entry up to which all pairs of it are compared: PAIRS, or as many times two as keep the pairs of larger entries in proportion to the table."""
    most, room = PAIRS, PAIRS_A_ROW * rows
    steps = F.greatest(F.lit(1), F.ceil(F.log2(F.col("n") / PAIRS))).cast("int")
    for r in sizes.groupBy(steps.alias("step")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).orderBy("step").collect():  # one row a power of two
        room -= r["pairs"]
        if room < 0:
            break
        most = PAIRS << r["step"]
    return most


def image_links(spark: SparkSession, made: DataFrame, scratch: Scratch, votes: int = VOTES) -> DataFrame:
    """Pairs ``(a, b, votes)`` of nodes whose corners agree on one turn, scale and shift: all of them between different components
    that are candidates; within a component of images that share a very large entry, those that were met."""
    bucket_bits = _buckets(made.count())
    shared = scratch.write(_shared_keys(made, bucket_bits), "shared")
    # entries that only the filter lets through have one image, and no partner in the join
    entries = scratch.write(_entries(made, _filter_of(shared), bucket_bits), "entries")
    sizes = scratch.write(entries.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > PAIRS), "sizes")
    large = sizes.where(F.col("n") > _all_pairs_up_to(sizes, entries.count())).select("key")
    few = _together(entries.join(_small(large), "key", "left_anti"))
    rest = scratch.write(entries.join(_small(large), "key", "left_semi"), "large")
    if rest.isEmpty():
        return scratch.write(_verified(scratch.write(_agreeing(few), "candidates"), made, votes), "links")
    rows, links, tried = rest.withColumn("c", F.col("node")), None, None
    left, before = _open(rows), None
    for turn in itertools.count():
        hubs = _with_hubs(rows, turn)
        asked = _agreeing(hubs if turn else few.unionByName(hubs))
        asked = scratch.write(asked.join(tried, ["a", "b"], "left_anti") if turn else asked, "candidates")
        tried = scratch.write(tried.union(asked), "tried") if turn else asked
        links, rows = _linked(spark, asked, links, rest, made, scratch, votes)
        left, before = _open(rows), left
        if left == 0:
            return links
        if left > before / 2:
            break
    # whatever is left: all pairs of different components in an entry
    asked = scratch.write(_agreeing(_across(rows, BLOCK)).join(tried, ["a", "b"], "left_anti"), "candidates")
    return _linked(spark, asked, links, rest, made, scratch, votes)[0]


def _open(rows: DataFrame) -> int:
    """Components that the entries of ``rows(key, .., c)`` hold beyond one each."""
    beyond = rows.select("key", "c").distinct().groupBy("key").agg((F.count("*") - 1).alias("n"))
    return beyond.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _linked(spark: SparkSession, asked: DataFrame, links: DataFrame | None, rest: DataFrame, made: DataFrame, scratch: Scratch, votes: int) -> tuple[DataFrame, DataFrame]:
    """links with those of the pairs asked, and ``rest`` with the component c of each image by them."""
    new = _verified(asked, made, votes)
    links = scratch.write(new if links is None else links.union(new), "links")
    parts = connected_components(spark, links.select("a", "b"), scratch)
    return links, scratch.write(rest.join(parts, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component"), "parts")


def image_copies(media: DataFrame, id_col: str, media_col: str, *, keypoints: int = KEYPOINTS, votes: int = VOTES) -> DataFrame:
    """``(id, component, n_links, status)`` of every row: images linked by equal bytes or agreeing corners; the component is
    the smallest id reached, n_links the other pictures that the row's picture was found to agree with (of a large
    group of copies not all pairs are compared), status whether the media was decoded."""
    spark = media.sparkSession
    scratch = Scratch(spark, "media")
    # the pictures themselves are never shuffled: all are described, and the corners of one of each are kept
    described = scratch.write(pictures(media.select(F.col(id_col).alias("node"), F.col(media_col).alias("media"))), "described")
    digest = F.coalesce("digest", F.encode(F.concat(F.lit("none "), F.coalesce(F.col("node").cast("string"), F.lit(""))), "UTF-8"))
    ids = described.select(F.col("node").alias("id"), digest.alias("digest"))
    nodes = scratch.write(ids.groupBy("digest").agg(F.min("id").alias("node")), "nodes")
    named = ids.join(nodes, "digest")
    copies = scratch.write(named.where("id != node").select(F.col("id").alias("node")).distinct(), "copies")
    state = described.groupBy("node").agg(F.min("status").alias("status"))
    held = described.where("node is not null and corners is not null").join(_small(copies), "node", "left_anti")
    made = held.select("node", "corners")
    if not ids.groupBy("id").count().where("count > 1").isEmpty():  # rows that repeat an id
        made = scratch.write(held.groupBy("node").agg(F.min("corners").alias("corners")), "pictures")
    links = image_links(spark, made, scratch, votes)
    parts = connected_components(spark, links.select("a", "b"), scratch)
    degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("n_links"))
    out = named.join(parts, "node", "left").join(degree, "node", "left").join(state.withColumnRenamed("node", "sid"), F.col("id").eqNullSafe(F.col("sid")), "left")
    return out.select("id", F.coalesce("component", "node").alias("component"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "status")


# ---- registered query: no table has images, so every vector is drawn as one ---------------


def render(values: np.ndarray, variant: int = 0) -> bytes:
    """A 96 x 96 picture of shades and boxes that a vector's bytes decide, or an edited copy of it:
    1 cut out, 2 other brightness and contrast, 3 turned by a quarter, 4 with noise, 5 and 6 at 0.8 and 0.6 of its size."""
    rng = np.random.default_rng(zlib.crc32(np.ascontiguousarray(values, "<f4").tobytes()))
    coarse = rng.uniform(40, 200, (13, 13))
    t = np.linspace(0, 11.99, 96)
    k, f = t.astype(int), t - t.astype(int)
    rows = coarse[k] * (1 - f)[:, None] + coarse[k + 1] * f[:, None]
    img = rows[:, k] * (1 - f) + rows[:, k + 1] * f
    for _ in range(24):
        y, x, h, w = *rng.integers(0, 90, 2), *rng.integers(5, 26, 2)
        img[y : y + h, x : x + w] = img[y : y + h, x : x + w] * 0.4 + rng.uniform(0, 255) * 0.6
    if variant == 1:
        img = img[9:91, 6:90]
    elif variant == 2:
        img = img * 0.7 + 30
    elif variant == 3:
        img = np.rot90(img)
    elif variant == 4:
        img = img + rng.normal(0, 1.0, img.shape)
    elif variant > 4:
        side = 77 if variant == 5 else 58
        img = resize(img, side, side)
    px = np.clip(np.rint(img), 0, 255).astype(np.uint8)
    return b"P5\n%d %d\n255\n" % (px.shape[1], px.shape[0]) + px.tobytes()


def rendered_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, media)`` for every vector; each twentieth id is drawn as an edited copy of the picture of the id before, where there is one."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    before = vectors.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("before"))
    # drawing is the work here: the vectors are dealt out to all cores first
    both = vectors.join(before, "vec_id", "left").repartition(4 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, own, prior in zip(*(c.to_pylist() for c in batch.columns)):
                copy = i is not None and i % 20 == 7 and prior is not None
                values = prior if copy else own
                out.append(None if values is None else render(np.array(values, np.float32), 1 + i // 20 % 6 if copy else 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "media"])

    return both.mapInArrow(run, "vec_id long, media binary")


def op8_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = image_copies(rendered_media(spark, sf_dir), "vec_id", "media")
    return done.select(F.col("id").alias("vec_id"), F.col("component").alias("component_id"), "n_links", "status")
