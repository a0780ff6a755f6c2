"""Copies of images: recall by edit, all pairs compared, awkward columns and workers without this package."""

import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillspark.llm import media

N = 40


def pgm(img):
    px = np.clip(np.rint(img), 0, 255).astype(np.uint8)
    return b"P5\n%d %d\n255\n" % (px.shape[1], px.shape[0]) + px.tobytes()


def vectors(seed, n=N):
    return np.random.default_rng(seed).normal(size=(n, 16)).astype(np.float32)


def turned(img, degrees):
    a = np.deg2rad(degrees)
    h, w = img.shape
    y, x = np.mgrid[:h, :w] - 47.5
    ys, xs = np.clip(y * np.cos(a) - x * np.sin(a) + 47.5, 0, h - 1.001), np.clip(y * np.sin(a) + x * np.cos(a) + 47.5, 0, w - 1.001)
    i, j, f, g = ys.astype(int), xs.astype(int), ys % 1, xs % 1
    return (img[i, j] * (1 - f) + img[i + 1, j] * f) * (1 - g) + (img[i, j + 1] * (1 - f) + img[i + 1, j + 1] * f) * g


EDITS = {
    "left half": lambda i: i[:, :48],
    "lower half": lambda i: i[48:],
    "crop": lambda i: i[9:91, 6:90],
    **{f"size {s}": lambda i, s=s: media.resize(i, round(96 * s), round(96 * s)) for s in (0.5, 0.6, 0.7, 0.8, 1.5)},
    "noise 3": lambda i: i + np.random.default_rng(1).normal(0, 3, i.shape),
    "turned 10": lambda i: turned(i, 10),
    "turned 90": np.rot90,
    "darker": lambda i: i * 0.7 + 20,
}


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_by_edit(spark, seed):
    """At least nine of ten copies of every edit are found, and no picture is linked to another."""
    found = {}
    originals = [media.decode(media.render(v)) for v in vectors(seed)]
    rows = [(k, pgm(img)) for k, img in enumerate(originals)]
    for e, (name, edit) in enumerate(EDITS.items()):
        rows += [(1000 * (e + 1) + k, pgm(edit(img))) for k, img in enumerate(originals)]
    got = {r.id: r.component for r in media.image_copies(spark.createDataFrame(rows, "id long, media binary"), "id", "media").collect()}
    for e, name in enumerate(EDITS):
        found[name] = sum(got[1000 * (e + 1) + k] == got[k] for k in range(N)) / N
    assert min(found.values()) >= 0.9, found
    parts = {}
    for i, c in got.items():
        parts.setdefault(c, set()).add(i % 1000)
    assert all(len(p) == 1 for p in parts.values())


def test_links_of_all_pairs(spark):
    """Table candidates against the comparison of every pair."""
    rng, rows = np.random.default_rng(5), []
    for v in vectors(5, 30):
        img = media.decode(media.render(v))
        rows += [pgm(img), pgm(img[10:86, 8:80]), pgm(img * 0.8 + rng.normal(0, 2, img.shape))]
    made = [media.describe(media.decode(r)) for r in rows]
    want = {(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if media.agreement(made[a], made[b]) >= media.VOTES}
    got = media.image_copies(spark.createDataFrame(list(enumerate(rows)), "id long, media binary"), "id", "media").collect()
    root = list(range(len(rows)))
    for a, b in sorted(want):
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    part = {r.id: r.component for r in got}
    assert len(want) >= 80 and sum(part[a] == part[b] for a, b in want) >= 0.98 * len(want)
    assert all(root[i] == root[c] for i, c in part.items())


def test_clashing_columns_and_a_large_image(spark):
    img = media.decode(media.render(vectors(7, 1)[0]))
    large = media.resize(img, 700, 700)
    rows = [(1, pgm(img), 5, b"k", "x"), (2, pgm(large), 6, b"k", "y"), (3, None, 7, b"k", "z")]
    frame = spark.createDataFrame(rows, "id long, media binary, node long, digest binary, status string")
    got = {r.id: (r.component, r.status) for r in media.image_copies(frame, "id", "media").collect()}
    assert got == {1: (1, "decoded"), 2: (1, "decoded"), 3: (3, "none")}


def test_functions_travel_whole():
    """A process that has no quillspark runs what is sent to it."""
    for job in (lambda: len(media.describe(media.decode(media.render(np.arange(64))))), lambda: len(media.pair_keys(media.describe(media.decode(media.render(np.arange(64)))))["v"])):
        code = "import sys, pickle; sys.path = [p for p in sys.path if 'repo' not in p]; print(pickle.load(sys.stdin.buffer)())"
        done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(job), capture_output=True, cwd="/", env={"PATH": "/usr/bin:/bin"}, timeout=120)
        assert done.returncode == 0 and int(done.stdout) == job(), done.stderr[-500:]


def test_entries_of_many_images(spark, monkeypatch):
    """Entries above the size whose pairs are all compared lose no link between pictures: every entry is made such a one."""
    rng, rows = np.random.default_rng(8), []
    for v in vectors(8, 12):
        img = media.decode(media.render(v))
        rows += [img, img[10:86, 8:80], *(img * 0.8 + rng.normal(0, 6, img.shape) for _ in range(4))]
    made = [media.describe(img.astype(np.float32)) for img in rows]
    frame = spark.createDataFrame([(k, m.tobytes()) for k, m in enumerate(made)], "node long, corners binary")

    def parts():
        links = media.image_links(spark, frame, media.Scratch(spark, "test"))
        return {r.node: r.component for r in media.connected_components(spark, links.select("a", "b"), media.Scratch(spark, "test")).collect()}

    want = parts()
    assert len(set(want.values())) == 12 and len(want) >= 0.9 * len(rows)
    for name, value in {"PAIRS": 1, "PAIRS_A_ROW": 0.0, "BLOCK": 2}.items():
        monkeypatch.setattr(media, name, value, raising=False)
    assert parts() == want


def test_pairs_across_components(spark, monkeypatch):
    """Blocks of components and of their images: every pair of different components in an entry once, none of the same."""
    monkeypatch.setattr(media, "PLACE", ["x"])
    rows = [(key, node, float(node), node % 7 if node < 40 else node) for key, n in ((1, 50), (2, 3), (3, 1)) for node in range(n)] + [(4, n, 0.0, 0) for n in range(20)]
    got = media._across(spark.createDataFrame(rows, "key long, node long, x double, c long"), 4).select("a", "b", "fa.x", F.col("fb.x").alias("y")).collect()
    want = [(p[1], q[1], p[2], q[2]) for p in rows for q in rows if p[0] == q[0] and p[1] < q[1] and p[3] != q[3]]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 1000
