"""Keys of pictures: unrelated ones rarely share any, shared ones are all kept, and pictures described together are as alone."""

import numpy as np
import pytest

from quillspark.llm import media


def drawn(seed, n):
    return [media.decode(media.render(v)) for v in np.random.default_rng(seed).normal(size=(n, 16)).astype(np.float32)]


@pytest.fixture(scope="module")
def made():
    return [media.describe(img) for img in drawn(3, 500)]


def test_unrelated_pictures_rarely_share_an_entry(made):
    """Pairs in entries that unrelated pictures share by chance grow with the square of their number: of 500 there are next to none."""
    v = [np.unique(media.pair_keys(m)["v"]) for m in made]
    _, n = np.unique(np.concatenate(v), return_counts=True)
    assert sum(map(len, v)) > 100_000 and (n * (n - 1) // 2).sum() <= 60


def test_described_together_as_alone():
    imgs = drawn(4, 5)
    imgs = [imgs[0], None, imgs[1][:48], *imgs[2:], np.zeros((96, 96), np.float32), imgs[1][:48] * 0.5, np.zeros((5, 9), np.float32)]
    together = media.describe_all(imgs)
    assert together[1] is None
    assert all(t.tobytes() == media.describe(img).tobytes() for t, img in zip(together, imgs) if img is not None)
    assert [len(t) > 0 for t in together if t is not None] == [True, True, True, True, True, False, True, False]


def test_shared_keys_are_all_kept(spark, made, monkeypatch):
    """Keys of two pictures and more pass the filter, in portions and buckets; nearly all others do not."""
    monkeypatch.setattr(media, "KEYS", 5000)
    some = [*made[:20], *made[:4], media.describe(drawn(3, 1)[0][4:90]), made[0][:0], made[0][:2], made[0][:5]]
    frame = spark.createDataFrame([(k, m.tobytes()) for k, m in enumerate(some)], "node long, corners binary").repartition(3)
    shared = media._shared_keys(frame, 6).collect()
    got = {(r.bucket << 32) + int(k) for r in shared for k in np.frombuffer(r["keys"], "<u4")}
    keys = [np.unique(media.pair_keys(m)["v"]) for m in some]
    v, n = np.unique(np.concatenate([k >> np.uint64(26) for k in keys]), return_counts=True)
    assert got == set(v[n > 1].tolist()) and len(got) == sum(r.n for r in shared) > 1000
    entries = media._entries(frame, media._filter_of(media._shared_keys(frame, 6)), 6).collect()
    held = {(r.key, r.node) for r in entries}
    want = {(int(key), node) for node, k in enumerate(keys) for key, first in zip(k.view(np.int64), k >> np.uint64(26)) if int(first) in got}
    assert want <= held and len(held) <= len(want) + 50
    assert {len(r.sight) for r in entries} == {media.SIGHT.itemsize}


def test_alike_sights():
    """Equal sights agree, also turned, grown and shifted; a corner out of place, another turn, size or other bits do not."""
    p = np.zeros(6, media.SIGHT)
    p["scale"], p["x"], p["y"], p["turn"] = 1, [0, 20, 5], [0, 3, 18], [0.1, 1, 2]
    q = p.copy()
    z = (p["x"] + 1j * p["y"]) * 2j + (30 - 7j)  # a quarter turn, twice as large, shifted
    q["x"], q["y"], q["turn"], q["scale"] = z.real, z.imag, p["turn"] + np.pi / 2, 0.5
    q["x"][1, 2] += 30
    q["turn"][2, 0] += 1
    q["scale"][3] = 1
    q["bits"][4, :, 0] = 0xFFFF
    q["bits"][5, :, 0] = 0xFF
    assert media.alike(p, q).tolist() == [True, False, False, False, False, True]
    assert media.alike(p[:0], q[:0]).tolist() == []


def test_an_empty_batch_of_unshared_keys(spark, made):
    """Pictures of which no two share a key have no links."""
    frame = spark.createDataFrame([(0, made[0].tobytes()), (1, made[1].tobytes())], "node long, corners binary")
    assert media.image_links(spark, frame, media.Scratch(spark, "test")).count() == 0
