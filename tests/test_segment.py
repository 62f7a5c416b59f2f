"""Dictionary segmentation against plain loops over all words and places."""

import random

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.operators import retrieval, segment


def plain(text, words, unspaced=segment.UNSPACED):
    words = {w.lower() for w in words if w and all(regex.fullmatch(unspaced, c) for c in w.lower())}
    found = [(i, len(w)) for w in words for i in range(len(text)) if text.startswith(w, i)]
    covered = {k for i, n in found for k in range(i, i + n)}
    found += [(i, 1) for i, c in enumerate(text) if regex.fullmatch(unspaced, c) and i not in covered]
    found += [(m.start(), len(m[0])) for m in regex.finditer(rf"[[\p{{L}}\p{{N}}]--[{unspaced}]]+", text, regex.V1)]
    return [text[i : i + n] for i, n in sorted(found, key=lambda x: (x[0], -x[1]))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc中文", min_size=1, max_size=5), max_size=12), st.lists(st.text("abcd中文 1\n", max_size=30), max_size=4))
def test_any_dictionary(words, texts):
    made = SEGMENTERS.setdefault(tuple(words), segment.Segmenter(words, r"\p{L}"))
    assert made.split(texts) == [plain(t, words, r"\p{L}") for t in texts]


SEGMENTERS = {}


@pytest.mark.parametrize("lane", [1, 3, 256])
def test_words_across_lanes(monkeypatch, lane):
    monkeypatch.setattr(segment, "LANE", lane)
    r = random.Random(lane)
    words = ["".join(r.choice("ab") for _ in range(r.randrange(1, 7))) for _ in range(25)]
    texts = ["".join(r.choice("abab c") for _ in range(r.randrange(300))) for _ in range(10)]
    assert segment.Segmenter(words, r"\p{L}").split(texts) == [plain(t, words, r"\p{L}") for t in texts]


def test_a_large_dictionary():
    r = random.Random(2)
    words = {"".join(chr(0x4E00 + int(r.random() ** 3 * 3000)) for _ in range(r.choice((1, 2, 2, 2, 3, 4)))) for _ in range(20_000)}
    text = "".join(chr(0x4E00 + int(r.random() ** 3 * 3000)) for _ in range(3000)) + " redis 6.0 集群"
    want = [text[i : i + n] for i in range(len(text)) for n in (4, 3, 2, 1) if text[i : i + n] in words and i + n <= len(text)]
    got = segment.Segmenter(words).split([text])[0]
    assert [w for w in got if w in words] == want and "redis" in got and "".join(dict.fromkeys(got))
    assert got == plain(text, words & {text[i : i + n] for i in range(len(text)) for n in (1, 2, 3, 4)})


def test_chinese_words_overlap(spark):
    words = spark.createDataFrame([("集群",), ("健康",), ("健康状态",), ("状态",), (None,), ("",), ("Redis",), ("集群",)], "w string")
    split = segment.segmenter(words)
    texts = spark.createDataFrame([(1, "Redis集群健康状态很好"), (2, None), (3, ""), (3, "没有 blanks_here9")], "doc_id long, text string")
    got = [(r.doc_id, r.t) for r in texts.select("doc_id", split("text").alias("t")).collect()]
    assert got == [(1, ["redis", "集群", "健康状态", "健康", "状态", "很", "好"]), (2, []), (3, []), (3, ["没", "有", "blanks", "here9"])]
    assert texts.limit(0).select(split("text")).collect() == []


def test_bm25_finds_words_within_runs(spark):
    words = spark.createDataFrame([("持久化",), ("集群",), ("状态",)], "w string")
    docs = spark.createDataFrame([(1, "数据持久化方案"), (2, "集群状态检查"), (3, "其他内容")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "持久化")], "query_id long, text string")
    assert retrieval.bm25(docs, asked).collect() == []
    assert [(r.query_id, r.id) for r in retrieval.bm25(docs, asked, tokenizer=segment.segmenter(words)).collect()] == [(7, 1)]


def test_large_dictionaries_are_refused(spark, monkeypatch):
    monkeypatch.setattr(segment, "DICTIONARY_BYTES", 10)
    with pytest.raises(ValueError, match="too large"):
        segment.segmenter(spark.range(100).select(F.col("id").cast("string")))


def test_words_are_copied_as_bytes(monkeypatch):
    import sys

    made, texts = segment.Segmenter(["ab", "b", "ü中", "中"], r"\p{L}"), ["ab ü中x 12", "", "中" * 50_000, "\U0001f600ab"]
    want, before = made.split(texts), sys.getallocatedblocks()
    out = made.words(texts)
    assert sys.getallocatedblocks() - before < 1000  # before, each of 50,000 words was an object
    assert out.to_pylist() == want == [plain(t, ["ab", "b", "ü中", "中"], r"\p{L}") for t in texts]


def test_texts_in_small_batches(spark, monkeypatch):
    words = spark.createDataFrame([("ab",), ("b",)], "w string")
    texts = spark.createDataFrame([(i, "abb" * (i % 7)) for i in range(50)] + [(50, None)], "i long, text string").coalesce(1)
    want = [r.t for r in texts.select(segment.segmenter(words, r"\p{L}")("text").alias("t")).collect()]
    monkeypatch.setattr(segment, "BATCH", 1)
    assert [r.t for r in texts.select(segment.segmenter(words, r"\p{L}")("text").alias("t")).collect()] == want == [["ab", "b", "b"] * (i % 7) for i in range(50)] + [[]]
