"""The local embedder against its definition, and how many hashes it takes."""

import hashlib
import re

import numpy as np

from quern.operators import embedding


def plain(texts, dims):
    out = np.zeros((len(texts), dims))
    for i, text in enumerate(texts):
        for word in re.findall(r"[^\W_]+", text.lower()):
            out[i, int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dims] += 1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def test_words_and_their_places(monkeypatch):
    texts = ["", "one two  TWO", "a_b-c\x1cd\x1fe\x0bf\x00g\x7fh\u0085i", "Ünder Äpfel STRASSE ẞ İx", "٣ ½ x² 持久化，集群", "w" * 100 + " " + "w" * 100, "...", "a b a’b"]
    for most in (1 << 18, 2):
        monkeypatch.setattr(embedding, "REMEMBERED", (64, most))
        embedding._HASHES.clear()
        for dims in (64, 7):
            assert np.array_equal(embedding.hashed_words(texts, dims), plain(texts, dims))
        assert len(embedding._HASHES) <= most and max(map(len, embedding._HASHES)) <= 64


def test_a_word_is_hashed_once_a_worker(monkeypatch):
    embedding._HASHES.clear()
    made, md5 = [], hashlib.md5
    monkeypatch.setattr(hashlib, "md5", lambda x: made.append(x) or md5(x))
    for _ in range(3):
        embedding.hashed_words(["one two", "two three"])
    assert sorted(made) == [b"one", b"three", b"two"]
