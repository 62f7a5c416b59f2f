"""Each operator against a brute-force version on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import bpe, decontam, embdup, linedup, neardup, pii, quality, queries, sharding, sufarr, toxicity
from quern.llm.common import components

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
DOC = "doc_id long, text string, lang string, source string, n_chars long, __text string, key string, id string, label string, score string"


def docs(spark, texts, ids=None):
    """A table with columns whose names operators use within."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", 0 if t is None else len(t), None, "k", "x", "y", "z") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOC)


def words(n, seed, size=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


# 1 sharding


def test_table_is_filled_by_turns_and_stays_put():
    names = [f"s{i}" for i in range(7)]
    owner = sharding.lookup_table(names, 1009)
    # Brute force: explicit permutations.
    perms = []
    for s in names:
        d = hashlib.sha256(s.encode()).digest()
        off, skip = int.from_bytes(d[:8], "big") % 1009, int.from_bytes(d[8:16], "big") % 1008 + 1
        perms.append([(off + k * skip) % 1009 for k in range(1009)])
        assert sorted(perms[-1]) == list(range(1009))
    want = [-1] * 1009
    for k in itertools.count():
        free = [x for x in perms[k % 7] if want[x] < 0]
        if not free:
            break
        want[free[0]] = k % 7
    assert owner.tolist() == want
    shares = np.bincount(owner)
    assert shares.max() - shares.min() <= 1
    less = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(owner, less, strict=True) if a != 6)
    assert moved < 0.1 * 1009
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 11)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 10)


def test_assign_shards(spark, tmp_path):
    d = docs(spark, ["a", None, "b", "b"], [1, None, 5, 5])
    out = sharding.assign_shards(d, ["p", "q"], size=11).collect()
    owner = sharding.lookup_table(["p", "q"], 11)
    for r in out:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 11
        assert (r.slot, r.shard) == (slot, "pq"[owner[slot]])
    assert len(out) == 4 and sharding.assign_shards(d.limit(0), ["p"], size=11).count() == 0
    sharding.write_shards(d, str(tmp_path / "s"), ["p", "q"], size=11)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 4


# 2 decontamination


def test_decontamination(spark):
    r = random.Random(1)
    items = [" ".join(f"x{r.randrange(5000)}" for _ in range(30)) for _ in range(12)] + [None, "", "!!"]
    common = lambda n, s: words(n, s, 40)
    swapped = items[2].split()
    swapped[4] = swapped[15] = swapped[22] = "other"
    texts = [common(300, 1), common(100, 2) + " " + items[0].upper() + "! " + common(200, 3), f"{common(50, 4)} {' '.join(swapped)} {common(60, 5)}", items[3], None, "", common(5000, 6) + " " + items[4], items[3], " ".join(items[5].split()[:9])]
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    out = decontam.contaminated(docs(spark, texts, [0, 1, 2, 3, 4, 5, 6, 3, 8]), b)
    assert {(x.doc_id, x.item_id) for x in out.collect()} == {(1, 0), (2, 2), (3, 3), (6, 4)}
    assert decontam.contaminated(docs(spark, texts).limit(0), b).count() == 0
    assert decontam.contaminated(docs(spark, texts), b.limit(0)).count() == 0


def test_benchmark_with_a_hot_item(spark):
    """One item in more rows than a block takes."""
    items = [(i, words(30, 500 + i, 100_000)) for i in range(40)]
    b = spark.createDataFrame(items + [items[0]] * 1500, "item_id long, text string")
    texts = [words(100, 1) + " " + items[0][1] + " " + words(100, 2), words(200, 3), items[7][1]]
    out = decontam.contaminated(docs(spark, texts), b).collect()
    assert sorted((x.doc_id, x.item_id) for x in out) == [(0, 0), (2, 7)]


def accepted(text, item, size=64):
    """Brute force over the rule of acceptance: at some place of the text, around as many words as a passage and the item have."""
    t, i = (re.findall(r"[0-9a-z\u0080-\U0010ffff]+", x.lower()) for x in (text, item))
    return any(decontam.longest_common_subsequence(i, t[max(0, k - len(i)) : k + size + len(i)]) >= 0.6 * len(i) for k in range(0, max(1, len(t)), 32))


def test_reworded_passages(spark):
    """More items than the space has dimensions, planted with up to a third of their words replaced: at least 0.9 of what the rule accepts is found, and nothing else."""
    r = random.Random(11)
    # Half of the words are common ones, as in texts.
    word = lambda: f"c{r.randrange(60)}" if r.random() < 0.5 else f"v{r.randrange(8000)}"
    items = [" ".join(word() for _ in range(r.randrange(25, 60))) for _ in range(150)]
    texts, planted = [], []
    for k in range(600):
        i = r.randrange(150)
        w = items[i].split()
        for at in r.sample(range(len(w)), int(len(w) * r.choice([0, 0.1, 0.2, 0.3, 0.35]))):
            w[at] = word()
        fill = [word() for _ in range(r.randrange(300))]
        at = r.randrange(len(fill) + 1)
        texts.append(" ".join(fill[:at] + (w if k % 3 else []) + fill[at:]))
        planted += [(k, i)] if k % 3 else []
    out = {(x.doc_id, x.item_id) for x in decontam.contaminated(docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    want = {(k, i) for k, i in planted if accepted(texts[k], items[i])}
    assert len(want) > 300 and len(out & want) >= 0.9 * len(want) and all(accepted(texts[k], items[i]) for k, i in out)


def test_part_of_a_long_item(spark):
    item = words(300, 31, 100_000)
    part = " ".join(item.split()[130:230])
    b = spark.createDataFrame([(7, item), (8, words(40, 32, 100_000))], "item_id long, text string")
    out = decontam.contaminated(docs(spark, [words(80, 1) + " " + part, words(200, 2)], [0, 1]), b).collect()
    assert [(x.doc_id, x.item_id) for x in out] == [(0, 7)]


@given(st.lists(st.integers(0, 5), max_size=12), st.lists(st.integers(0, 5), max_size=12))
@settings(max_examples=100, deadline=None)
def test_longest_common_subsequence(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert decontam.longest_common_subsequence(a, b) == t[-1][-1]


# 3 near duplicates


def cells(t):
    w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
    return collections.Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])


def classes(texts, links):
    root = list(range(len(texts)))
    for _ in texts:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def near_texts():
    base = words(200, 1)
    out = [base, base.upper() + ".", None, "", "one two", "One, two", words(150, 2), "!?"]
    for k in range(12):
        w = base.split()
        for j in range(k):
            w[(j * 17 + k) % 200] = f"z{k}{j}"
        out.append(" ".join(w))
    return out + ["same same same same same same", "same same same same same same same"] + [words(120, 7)] * 5


def test_near_duplicates(spark):
    texts = near_texts()
    c = [cells(t) for t in texts]
    links = [(i, j) for j in range(len(c)) for i in range(j) if c[i] and c[j] and 5 * (c[i] & c[j]).total() >= 4 * (c[i] | c[j]).total()]
    out = {r.doc_id: (r.class_id, r.kept) for r in neardup.near_duplicates(docs(spark, texts)).collect()}
    want = classes(texts, links)
    assert out == {i: (w, w == i) for i, w in enumerate(want)}
    odd = neardup.near_duplicates(docs(spark, ["a b c d e f"] * 3, [None, 4, 4])).collect()
    assert sorted((r.doc_id is None, r.class_id, r.kept) for r in odd if r.doc_id) == [(False, 4, True)] * 2 and len(odd) == 3
    assert neardup.near_duplicates(docs(spark, texts).limit(0)).count() == 0


def test_family_without_its_original(spark):
    """Edited copies of an absent text, pairs of which lie around the similarity: no link may be left out because better estimates come first."""
    r, base, texts = random.Random(8), words(300, 21, 5000).split(), []
    for k in range(150):
        w = base.copy()
        for j, at in enumerate(r.sample(range(300), 4)):
            w[at] = f"z{k}x{j}"
        texts.append(" ".join(w))
    c = [cells(t) for t in texts]
    links = [(i, j) for j in range(len(c)) for i in range(j) if 5 * (c[i] & c[j]).total() >= 4 * (c[i] | c[j]).total()]
    out = {x.doc_id: x.class_id for x in neardup.near_duplicates(docs(spark, texts)).collect()}
    assert out == dict(enumerate(classes(texts, links)))


def test_darts_estimate_weighted_similarity():
    a, b = words(300, 3, 60), words(300, 3, 60).split()
    b = " ".join(b[:250] + words(50, 9, 60).split())
    data = (a + b).encode()
    row, cell = neardup.shingles(np.frombuffer(data, np.uint8), np.array([0, len(a), len(data)]))
    sig = neardup.dart_signatures(row, cell, 2, 2048)
    x, y = cells(a), cells(b)
    assert (sig[0] == sig[1]).mean() == pytest.approx((x & y).total() / (x | y).total(), abs=0.05)


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)] + [(900, 900 + i) for i in range(1, 200)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {}
    for a, b in edges:
        want.setdefault(a, {a}), want.setdefault(b, {b})
        if want[a] is not want[b]:
            whole = want[a] | want[b]
            for n in whole:
                want[n] = whole
    for n, s in want.items():
        assert got.get(n, n) == min(s)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 4 quality


def kneser_ney(texts, order):
    """Probabilities by the textbook recursion over dictionaries."""
    grams = collections.Counter()
    for t in texts:
        b = b"\0" * (order - 1) + t
        grams.update(b[i : i + order] for i in range(len(t)))
    tables = {order: grams}
    for k in range(order - 1, 0, -1):
        tables[k] = collections.Counter(g[1:] for g in tables[k + 1])

    def p(g):
        if not g:
            return 1 / 256
        c = tables[len(g)]
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        div = lambda a, b: a / b if b else 1.0
        d = [0] + [min(max(x, 0.05), i - 0.05) for i, x in ((1, 1 - 2 * y * div(n[1], n[0])), (2, 2 - 3 * y * div(n[2], n[1])), (3, 3 - 4 * y * div(n[3], n[2])))]
        same = {k: v for k, v in c.items() if k[:-1] == g[:-1]}
        total = sum(same.values())
        if not total:
            return p(g[1:])
        v = c.get(g, 0)
        return (v - d[min(v, 3)]) / total + sum(d[min(x, 3)] for x in same.values()) / total * p(g[1:])

    return p


@pytest.mark.parametrize("served", [16_384, 1])
def test_perplexities_are_those_of_the_recursion(spark, served, monkeypatch):
    monkeypatch.setattr(quality, "SERVED", served)
    monkeypatch.setattr(quality, "BLOCK_ROWS", 1 if served == 1 else 100_000)
    trusted = ["the cat sat on the mat", "the dog sat", "a cat", ""]
    asked = ["the cat", "zzz é", None, "", "mat dog the the"]
    model = quality.fit(docs(spark, trusted), "text", 3)
    got = {r.doc_id: r.perplexity for r in quality.perplexities(docs(spark, asked), model, order=3).collect()}
    p = kneser_ney([t.encode() for t in trusted], 3)
    for i, t in enumerate(asked):
        if not t:
            assert got[i] is None
            continue
        b = b"\0\0" + t.encode()
        want = math.exp(-sum(math.log(p(b[j : j + 3])) for j in range(len(t.encode()))) / len(t.encode()))
        assert got[i] == pytest.approx(want, rel=1e-4)


def test_classify(spark):
    good = [words(80, i, 50) for i in range(60)]
    bad = ["".join(random.Random(i).choice("#$%&@!*") for _ in range(300)) for i in range(6)]
    d = docs(spark, good + bad + [None, ""])
    labels = spark.createDataFrame([(i, 1) for i in range(50)] + [(60, 0), (None, 1), (3, 1)], "doc_id long, quality int")
    out = {r.doc_id: r.keep for r in quality.classify(d, labels).collect()}
    assert all(out[i] for i in range(60)) and not any(out[i] for i in range(60, 68))
    free = {r.doc_id: r.keep for r in quality.classify(d, labels.limit(0)).collect()}
    assert all(free[i] for i in range(66)) and not free[66]
    assert quality.classify(d.limit(0), labels).count() == 0


# 5 toxicity


def test_texts_that_repeat_an_id_reach_the_fit_once(spark, monkeypatch):
    got = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, share: got.append((texts, labels.tolist())))
    d = docs(spark, [f"text {i % 7}" for i in range(400)], [i % 40 for i in range(400)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0)], "doc_id long, toxic int")
    toxicity.train(d, labels, rows=10)
    assert len(got[0][0]) == 20 and sorted(got[0][1]) == [0] * 10 + [1] * 10
    toxicity.train(d, labels)
    # Of each id the smallest text, as 40 and 7 have no common divisor.
    assert got[1][0] == [f"text {min((i + 40 * k) % 7 for k in range(10))}".encode() for i in range(40)]


def test_toxicity_on_held_out_rows(spark):
    r, texts, marks = random.Random(2), [], []
    for i in range(300):
        w = words(r.randrange(20, 200), i, 3000).split()
        if i % 4 == 0:
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(["vile", "scum", "idiot", "trash"])
        texts.append(" ".join(w))
        marks.append(int(i % 4 == 0))
    d = docs(spark, [*texts, None, ""])
    held = {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks) if i not in held] + [(0, 1), (None, 1)], "doc_id long, toxic int")
    net = toxicity.train(d, labels)
    out = {x.doc_id: x.score for x in toxicity.score(d, net).collect()}
    assert all(0 <= s <= 1 for s in out.values()) and out[300] < 0.5 and out[301] < 0.5
    assert sum((out[i] >= 0.5) == bool(marks[i]) for i in held) >= 0.95 * len(held)
    assert toxicity.score(d.limit(0), net).count() == 0
    alone = toxicity.train(d, labels.limit(0))
    assert {x.score < 0.5 for x in toxicity.score(d, alone).collect()} == {True}


def test_gradients():
    data = b"alpha beta gamma delta alpha beta"
    w = toxicity.read_words(np.frombuffer(data, np.uint8), np.array([0, 16, len(data)]))
    start, n, _ = toxicity.windows(w.rows, 2)
    net = toxicity.Network(np.sort(w.hashes))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    target = np.array([1.0, 0.0])

    def loss():
        z = net.score_windows(w, start, n).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(z)) - target * z))

    g = net.gradient(w, start, n, target, np.random.default_rng(0), drop=0.0)
    for k, v in net.p.items():
        i = np.unravel_index(np.abs(g[k]).argmax(), v.shape)
        keep = v[i]
        v[i] = keep + 1e-4
        up = loss()
        v[i] = keep - 1e-4
        down = loss()
        v[i] = keep
        assert g[k][i] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=1e-6), k


# 6 byte-level BPE


def plain_bpe(text, ranks):
    out = []
    for m in regex.finditer(PATTERN, text):
        parts = [bytes([b]) for b in m[0].encode()]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 10**9))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        out += [ranks[p] for p in parts]
    return out


def test_bpe(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    texts = ["It's 12 o'clock…  über\n\n\tx", None, "", "<|endoftext|>", "日本語 🙂 é", " " * 50, words(300, 1)]
    enc = bpe.encode(docs(spark, texts, [1, None, 3, 4, 4, 6, 7]), PATH, PATTERN, with_decoded=True).collect()
    for t, r in zip(texts, enc, strict=True):
        assert np.frombuffer(r.ids, "<u4").tolist() == plain_bpe(t or "", ranks)
        assert bytes(r.decoded) == (t or "").encode()
    dec = bpe.decode(bpe.encode(docs(spark, texts), PATH, PATTERN), PATH, PATTERN)
    assert [bytes(r.decoded).decode() for r in dec.orderBy("doc_id").collect()] == [t or "" for t in texts]
    half = spark.createDataFrame([(1, np.array(plain_bpe("🙂", ranks)[:1], "<u4").tobytes()), (2, None)], "doc_id long, ids binary")
    assert "🙂".encode().startswith(bytes(bpe.decode(half, PATH, PATTERN).first().decoded))
    assert bpe.encode(docs(spark, texts).limit(0), PATH, PATTERN).count() == 0


@given(st.text(alphabet="aé1 \n'.s日", max_size=60))
@settings(max_examples=200, deadline=None)
def test_safe_pieces_change_nothing(text):
    enc = bpe.coder(PATH, PATTERN)
    assert [i for p in bpe.safe_pieces(text, 5) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_very_long_texts():
    enc = bpe.coder(PATH, PATTERN)
    for text in ("ab " * 200_000, "a" * 100_000, " " * 100_000 + "x", "1a" * 100_000):
        assert enc.decode_bytes(bpe.encode_text(text, enc)).decode() == text


@given(st.text(alphabet="aé1 \n\t\u3000\xa0'.s日", max_size=60))
@settings(max_examples=300, deadline=None)
def test_runs_of_white_space_are_one_match(text):
    enc = bpe.coder(PATH, PATTERN)
    got = [i for p, match in bpe.parts(text, 3) for i in (enc._encode_single_piece(p) if match else enc.encode_ordinary(p))]
    assert got == enc.encode_ordinary(text)


@pytest.mark.parametrize("run", [" " * 5_000_000, "\t" * 5_000_000, " \n\t\u3000" * 1_250_000, "\n" * 5_000_000])
def test_white_space_of_any_length(run):
    """By the pattern: all but the last character before a letter are a match, and all of them at the end."""
    enc = bpe.coder(PATH, PATTERN)
    for text in (run + "letter", "letter" + run, "a " + run + " b" + run + "1"):
        want = [t for m in regex.finditer(PATTERN, text) for t in enc._encode_single_piece(m[0])]
        assert bpe.encode_text(text, enc) == want
    short = run[:300_000] + "x y"
    assert bpe.encode_text(short, enc) == enc.encode_ordinary(short)


# 7 personal data

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(t):
    out = []
    for r, (k, p) in enumerate(BASE):
        for m in re.finditer(p, t):
            g = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(g[::-1])) % 10 == 0
            if (k == "ip" and max(map(int, m[0].split("."))) > 255) or (k == "card" and not (12 <= len(g) <= 19 and luhn)) or (k == "phone" and not 9 <= len(g) <= 15):
                continue
            out.append((m.start(), r, k, m.end()))
    return sorted(out)


def test_personal_data(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(["a", "1", "@", ".", "-", " ", "+", "b.c", "4111 1111 1111 1111", "10.0.0.256", "1.2.3.4", "+49 (30) 1234-567", "x@y.z", "é", "_", "00", "🙂"]) for _ in range(r.randrange(30))) for _ in range(400)]
    texts += [None, "", "a@b.co.x_y@c.d", "1.2.3.4.5.6.7.8", "9" * 5000, "a" * 20_000, "a." * 5000 + "@", "x@" + "a." * 6000 + "b", "4" * 19 + "-" + "4" * 19, "+1" + " 2" * 3000]
    got = {x.doc_id: [(s.start, s.rank, s.kind, s.end) for s in x.found if s.rank < 4] for x in pii.find_personal_data(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == base_spans(t or ""), t
    # Words before a span count if they stand within 40 characters of it, other spans between them included.
    near = ["call " + "+49 30 1234567 " * n + "+49 30 7654321" for n in (0, 1, 2, 3)] + ["x" * 50 + " fax" + " " * k + "+49 30 7654321" for k in (1, 36, 37, 60)]
    last = [x.found[-1].score for x in pii.find_personal_data(docs(spark, near)).orderBy("doc_id").collect()]
    words_ = re.compile(r"(?:^|[^a-z])(?:phone|tel|call|mobile|fax)")
    assert last == [0.9 if words_.search(t[max(0, len(t) - 14 - 40) : len(t) - 14].lower()) else 0.6 for t in near] and set(last) == {0.6, 0.9}
    more = pii.find_personal_data(docs(spark, ["IBAN DE89 3704 0044 0532 0130 00 ok", "DE88 3704 0044 0532 0130 00", "ssn 123-45-6789", "123-45-6789"])).orderBy("doc_id").collect()
    assert [[s.kind for s in x.found if s.rank >= 4] for x in more] == [["iban"], [], ["ssn"], []]
    assert more[0].found[0].score > 0.9 and more[0].found[0].found == "DE89 3704 0044 0532 0130 00"
    clean = pii.redact(docs(spark, ["mail x@y.zz or 1.2.3.4!", None, ""])).orderBy("doc_id").collect()
    assert [x.redacted for x in clean] == ["mail [email] or [ip]!", None, ""]
    assert pii.find_personal_data(docs(spark, texts).limit(0)).count() == 0


def test_personal_data_in_very_long_texts(spark):
    """Eight times the spans take about eight times as long; their places are right to the last."""
    import time

    def took(n):
        began = time.time()
        found = pii.find_personal_data(docs(spark, ["mail a@b.cc or call +49 30 1234567; " * n])).first().found
        assert len(found) == 2 * n and (found[-1].start, found[-2].start) == (36 * n - 16, 36 * n - 31)
        return time.time() - began

    took(10)
    assert took(16_000) < 20 * max(0.5, took(2000))


# 8 embeddings


@pytest.mark.parametrize("block", [1024, 7])
def test_embeddings(spark, block, monkeypatch):
    monkeypatch.setattr(embdup, "BLOCK", block)
    monkeypatch.setattr(embdup, "FIT_LENGTHS", 64 if block == 1024 else 0)
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 16))
    rows = [(i, [float(x) for x in v[i % 60] + (i >= 60) * rng.normal(size=16) * 0.1 * (i % 3)], i % 2) for i in range(240)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] + [1.0] * 15, 0), (903, [None] + [1.0] * 15, 0), (904, rows[0][1], None), (905, [1.0, 2.0], 0), (906, [2.0, 4.0], 0), (907, [], 1), (None, rows[0][1], 0), (908, rows[1][1], 1), (908, rows[1][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"u": F.lit(1), "key": F.lit("k"), "id": F.lit(0)})
    out = embdup.link_embeddings(df).collect()
    assert len(out) == len(rows)
    good = [(i, np.array(x), y) for i, x, y in rows if i is not None and y is not None and x and None not in x and np.isfinite(x).all() and np.any(x)]
    hit = [[a[2] == b[2] and len(a[1]) == len(b[1]) and float(a[1] @ b[1]) / math.sqrt(float(a[1] @ a[1]) * float(b[1] @ b[1])) >= 0.98 for b in good] for a in good]
    root = [g[0] for g in good]
    for _ in good:
        root = [min(root[j] for j in range(len(good)) if hit[i][j]) for i in range(len(good))]
    want = collections.Counter((g[0], sum(hit[i]) - 1, root[i], root[i] == g[0]) for i, g in enumerate(good))
    alone = collections.Counter((r[0], 0, r[0], True) for r in rows if r[0] not in {g[0] for g in good})
    assert collections.Counter(tuple(r) for r in out) == want + alone
    assert embdup.link_embeddings(df.limit(0)).count() == 0


def test_embeddings_with_a_common_direction(spark):
    """Half of a mean that all vectors share; links at the threshold are found all the same."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 32)) * 0.3 + 1
    near = base + rng.normal(size=base.shape) * 0.02
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(np.concatenate([base, near]))]
    v = np.concatenate([base, near])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = int(((v @ v.T) >= 0.98).sum() - len(v))
    got = embdup.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).agg(F.sum("n_links")).first()[0]
    assert want >= 800 and want >= got >= 0.99 * want


# 9 suffixes


@given(st.binary(max_size=80) | st.text(alphabet="ab", max_size=120).map(str.encode))
@settings(max_examples=200, deadline=None)
def test_suffix_order(data):
    order = sufarr.suffix_order(np.frombuffer(data, np.uint8), 200)
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def without_repeats(texts):
    seen, out = set(), []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - 99):
            if t[i : i + 100] in seen:
                gone[i : i + 100] = [True] * 100
            seen.add(t[i : i + 100])
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("hot", [4096, 2])
def test_repeats(spark, hot, monkeypatch):
    monkeypatch.setattr(sufarr, "HOT", hot)
    a, b = words(60, 1), words(60, 2)
    texts = [a, b, a, a[:150] + b[10:250], "é" * 120, None, "", b[:99], b[:100], "ab" * 300, words(30, 3) + a[40:160] + words(30, 4) + a[40:160], a + b, "é" * 120, "ab" * 60]
    texts += [words(8, 50 + i) + a[20:140] + words(8, 80 + i) for i in range(12)]
    out = sorted(sufarr.remove_repeats(docs(spark, texts)).collect())
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out] == without_repeats([(t or "").encode() for t in texts])
    odd = sufarr.remove_repeats(docs(spark, [a, a, a], [None, 4, 4])).collect()
    assert [r.n_removed for r in odd] == [0, 0, 0]
    assert sufarr.remove_repeats(docs(spark, texts).limit(0)).count() == 0


# 10 lines


def later(texts):
    sets = {(i, k): frozenset(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", x.lower())) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n"))}
    sets = {k: s for k, s in sets.items() if len(s) >= 5}
    return {b for b in sets for a in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}


@pytest.mark.parametrize("block", [1024, 3, 2])
def test_lines(spark, block, monkeypatch):
    monkeypatch.setattr(linedup, "BLOCK", block)
    if block == 2:  # nearly every word has too many lines for one task
        monkeypatch.setattr(linedup, "SPLIT", 4)
    if block == 3:  # every word is frequent, and no pairs are held
        monkeypatch.setattr(linedup, "HOT", 1)
        monkeypatch.setattr(linedup, "PAIRS", 10)
    r = random.Random(6)
    pool = [words(r.randrange(5, 40), i, 120) for i in range(25)]
    pool.append(words(3000, 99, 5000))

    def line():
        w = r.choice(pool).split()
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = f"n{r.randrange(50)}"
        return " ".join(w)

    texts = ["\n".join(line() for _ in range(r.randrange(6))) for _ in range(60)] + [None, "", "\n\n", "a b\na b", "Ä b c d e\nä B c d e"]
    d = docs(spark, texts)
    out = linedup.later_lines(d)
    assert {(x.doc, x.line) for x in out.collect()} == later(texts)
    kept = {x.doc_id: x.text for x in linedup.remove_lines(d, out).collect()}
    gone = later(texts)
    for i, t in enumerate(texts):
        assert kept[i] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone))
    assert linedup.later_lines(docs(spark, ["a b c d e f"] * 3, [None, 4, 4])).count() == 0
    assert linedup.later_lines(d.limit(0)).count() == 0


def test_pairs_across_blocks_are_all_that_the_filters_pass():
    rng = np.random.default_rng(2)
    n = rng.integers(5, 12, 300)
    place = rng.integers(0, 3, 300)
    low, high = rng.integers(0, 8, 300), rng.integers(0, 2, 300)
    left = rng.random(300) < 0.4
    a, b = linedup.similar_pairs(np.zeros(300, np.int64), n, place, low, high, 0.8)
    want = {frozenset(p) for p in zip(a.tolist(), b.tolist(), strict=True) if left[p[0]] != left[p[1]]}
    a, b = linedup.pairs_across(left, n, place, low, high, 0.8)
    got = [frozenset(p) for p in zip(a.tolist(), b.tolist(), strict=True)]
    # Of equally long lines either may be the one whose place counts.
    equal = {p for p in want ^ set(got) if len({n[x] for x in p}) == 1}
    assert len(got) == len(set(got)) and want ^ set(got) == equal and len(want) > 20


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_runs_are_bounded(size):
    key = np.sort(np.r_[np.arange(40), np.full(30, 7), np.full(11, 20), np.full(10, 39)])
    table = pa.table({"key": key, "row": np.arange(len(key))})
    got = list(linedup.bounded_runs(iter(table.to_batches(max_chunksize=size)), 5, 10))
    assert np.concatenate([t["row"].to_numpy() for _, t in got]).tolist() == list(range(len(key)))
    # A group that is over the bound by less than a batch may come whole.
    assert ({7} if size < 20 else set()) <= {k for large, t in got if large for k in t["key"].to_pylist()} <= {7, 20, 39}
    whole = [set(t["key"].to_pylist()) for large, t in got if not large]
    assert all(not a & b for a, b in itertools.combinations(whole, 2)) and max(t.num_rows for large, t in got) <= 100 + 40


def test_lines_of_one_word_go_to_many_tasks(spark, monkeypatch):
    """A word that every line has among its rarest: blocks of its lines are compared in pairs, in tasks of bounded work."""
    monkeypatch.setattr(linedup, "SPLIT", 200)
    r = random.Random(5)
    lines = [" ".join(["common", *(f"v{r.randrange(30)}" for _ in range(6))]) for _ in range(1500)]
    d = docs(spark, ["\n".join(lines[k : k + 50]) for k in range(0, 1500, 50)])
    assert {(x.doc, x.line) for x in linedup.later_lines(d).collect()} == later(["\n".join(lines[k : k + 50]) for k in range(0, 1500, 50)])


def test_query_removes_short_lines(spark, tmp_path):
    """Lines of one to four words repeat as any others do; lines without words stay."""
    texts = ["All rights reserved.\nyes\n\n--", "one two three four\nall RIGHTS reserved", "one two three four five\nYes!\n\n--\none two three", "日本語\n日本語。x", None, "yes yes\n日本語"]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    sets = {(i, k): set(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", x.lower())) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n"))}
    want = {i: [] for i in range(len(texts))}
    for b in sorted(sets):
        if sets[b] and any(a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for a in sets):
            want[b[0]].append(str(b[1]))
    out = {x.doc_id: x.removed_lines for x in queries.op10_line_dedup(spark, str(tmp_path)).collect()}
    assert out == {i: ",".join(v) for i, v in want.items()} and sum(map(len, want.values())) >= 5


# The pipeline


def test_stages_keep_rows_with_a_null_id(spark):
    d = docs(spark, ["a", "b", "c", "d"], [None, 1, 2, None])
    ids = spark.createDataFrame([(1,), (None,)], "doc_id long")
    for how, want in (("left_semi", ["a", "b", "d"]), ("left_anti", ["a", "c", "d"])):
        assert sorted(x.text for x in corpus_pipeline._only(d, ids, how).collect()) == want
