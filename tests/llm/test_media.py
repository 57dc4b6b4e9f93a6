import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import media
from quillspark.llm.queries import op9_media


def expected(text):
    raw = (text or "").encode()
    body = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
    return len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:])


def test_query(spark, sf, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    by_text = {}
    rows = op9_media(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == expected(texts[r.doc_id])
        assert by_text.setdefault(texts[r.doc_id], (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_odd_rows(odd_documents, no_documents):
    got = media.features(media.images(odd_documents)).collect()
    want = sorted(str(expected(r.text)) for r in odd_documents.collect())
    assert sorted(str((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32)) for r in got) == want
    assert media.features(media.images(no_documents)).count() == 0


@settings(deadline=None)
@given(st.integers(1, 7), st.integers(1, 9), st.integers(0, 2**32), st.integers(0, 9))
def test_every_filter_is_undone(height, width, seed, level):
    rng = np.random.default_rng(seed)
    pixels = rng.integers(0, 256, (height, width), dtype=np.uint8)
    filters = rng.integers(0, 5, height, dtype=np.uint8)
    assert (media.decode(media.encode(pixels, level, filters)) == pixels).all()
    assert (media.decode(media.encode(pixels, level)) == pixels).all()


def test_broken_images_are_errors():
    png = media.encode(np.arange(576 * 3, dtype=np.uint32).astype(np.uint8).reshape(3, 576))
    for i in range(len(png)):
        bad = bytearray(png)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            media.decode(bytes(bad))
    for cut in (0, 8, 30, len(png) - 12):
        with pytest.raises(ValueError):
            media.decode(png[:cut])


def brute_hash(pixels):
    """The definition, sum by sum."""
    h, w = pixels.shape
    small = [[0.0] * 32 for _ in range(32)]
    for i in range(32):
        for j in range(32):
            y, x = i * h // 32, j * w // 32
            block = pixels[y : max(y + 1, (i + 1) * h // 32), x : max(x + 1, (j + 1) * w // 32)]
            small[i][j] = float(block.mean())
    c = lambda k, n: np.cos(np.pi / 32 * (n + 0.5) * k)
    low = np.array([[sum(small[i][j] * c(u, i) * c(v, j) for i in range(32) for j in range(32)) for v in range(8)] for u in range(8)]).round(6)
    low[0, 0] = 0
    return np.packbits((low > np.median(low)).ravel()).tobytes().hex()


@pytest.mark.parametrize("height", [1, 5, 32, 70])
def test_cosine_hash(height):
    pixels = np.random.default_rng(height).integers(0, 256, (height, 576), dtype=np.uint8)
    assert media.cosine_hash(pixels) == brute_hash(pixels)


def test_near_images_have_near_hashes():
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 200, (64, 576), dtype=np.uint8)
    noisy = (pixels + rng.integers(0, 4, pixels.shape)).astype(np.uint8)
    far = rng.integers(0, 200, (64, 576), dtype=np.uint8)
    bits = lambda a, b: (int(media.cosine_hash(a), 16) ^ int(media.cosine_hash(b), 16)).bit_count()
    assert bits(pixels, noisy) <= 8 < bits(pixels, far)
