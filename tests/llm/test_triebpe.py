"""Operator 12 against the tokenizers library: random words, texts with nulls, repeats and added tokens, and very long words."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import queries, triebpe
from test_small import docs

PATH = public_tokenizers.path("byte_bpe_50k.json")


LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return LIBRARY


def unpack(ids):
    return np.frombuffer(ids, "<u4").tolist()


def check(library, texts):
    pairs = triebpe.coder(PATH)
    got = pairs.encode(texts)
    want = library.encode_batch(texts, add_special_tokens=False)
    assert [unpack(g) for g in got] == [w.ids for w in want]
    assert [pairs.decode(g).decode() for g in got] == [library.decode(w.ids, skip_special_tokens=False) for w in want]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40) | st.text("ab '-st\n ", max_size=60), max_size=5))
def test_any_text(texts):
    check(LIBRARY, texts)


def test_shared_prefixes_and_repetitions(library):
    r = random.Random(3)
    check(library, ["".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(1, 90))) for _ in range(3000)])
    check(library, [a * n + b for a in ("a", "-", "ab", "é", " ", "\n", "aa ") for n in (1, 2, 3, 127, 128, 129, 1000) for b in ("", "x")])


def test_each_prefix_is_a_node_once():
    made = triebpe.Trie([b"walked", b"walk", b"walking", b"talk", b"walk"])
    prefixes = {w[:n] for w in (b"walked", b"walking", b"talk") for n in range(1, len(w) + 1)}
    assert made.nodes() == len(prefixes)


def test_characters_of_other_versions_of_unicode(library):
    check(library, [f"a{chr(c)}1{chr(c)}{chr(c)} {chr(c)}!" for c in [*range(0xD800), *range(0xE000, 0x110000, 97)]])


def test_very_long_words(library):
    check(library, [" " * 1_000_000 + "a", "ab" * 300_000, "日本" * 100_000, "\t \n" * 200_000 + "x"])


def test_remembered_words_are_forgotten(library, monkeypatch):
    monkeypatch.setattr(triebpe, "REMEMBERED", 10)
    for _ in range(3):
        check(library, ["some words here", "and some there"])


def test_table(spark, library):
    texts = ["<|endoftext|>a <|endoftext|> b<|endoftext", None, "", "the same text", "the same text", "naïve 日本 \x00\x1c\x85", "x " * 50_000]
    ids = [1, 2, None, 4, 4, 5, 6]
    table = docs(spark, texts, ids)
    out = triebpe.encode(table, PATH, with_decoded=True)
    key = lambda x: (str(x[0]), x[1])
    want = [(i, library.encode(t or "", add_special_tokens=False).ids, (t or "").encode()) for i, t in zip(ids, texts, strict=True)]
    assert sorted([(r.doc_id, unpack(r.ids), bytes(r.decoded)) for r in out.collect()], key=key) == sorted(want, key=key)
    back = triebpe.decode(out.withColumn("text", out.ids), PATH)
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted(w[2] for w in want)
    assert triebpe.encode(table.limit(0), PATH).collect() == []


def test_query(spark, tmp_path, library):
    texts = ["one <|endoftext|>", None, "two words\n\nhere"]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(np.asarray(ids, "<u4").tobytes()), sha((t or "").encode())))
    out = queries.op12_trie_bpe(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert sorted(map(tuple, out.collect())) == want


def test_ids_without_a_token_and_broken_bytes(library):
    ids = [257, 99_999_999, 50256, 0x40, 220]
    assert triebpe.coder(PATH).decode(np.asarray(ids, "<u4").tobytes()).decode() == library.decode(ids, skip_special_tokens=False)
    broken = [triebpe.coder(PATH).id_of[bytes([b])] for b in (0xE6, 0x97, 0x41, 0xFF, 0xE6)]
    assert triebpe.coder(PATH).decode(np.asarray(broken, "<u4").tobytes()).decode() == library.decode(broken, skip_special_tokens=False)


def test_other_kinds_of_files_are_refused(tmp_path):
    made = json.load(open(PATH))
    made["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(made))
    with pytest.raises(ValueError, match="byte-level"):
        triebpe.coder(str(tmp_path / "t.json"))
