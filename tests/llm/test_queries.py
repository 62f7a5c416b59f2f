"""The registered queries opN_ and the stages of the pipeline over small tables, against SQL or brute force."""

import base64
import collections
import hashlib
import math
import os
import random
import re
import zlib

import __spark_entry__ as entry
import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quern.llm import quality, queries

from test_small import accepted, base_spans, cells, classes, kneser_ney, plain_bpe, without_repeats, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(r, n, lang):
    """Words of a language of its own, so that trusted text says something about others of it."""
    return " ".join("".join(r.choice(("ka", "mi", "so", "re") if lang == "a" else ("bu", "to", "nel", "dri")) for _ in range(r.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(17)
    items = [(i, words(30, 900 + i, 5000)) for i in range(8)] + [(8, None), (9, ""), (0, words(30, 900, 5000))]
    out = []
    for i in range(120):
        lang = "ab"[i % 2] if i % 10 else None
        lines = [sentence(r, r.randrange(4, 25), lang or "a") for _ in range(r.randrange(1, 6))]
        if i % 7 == 0:
            lines.insert(0, "all rights reserved by the same people as ever")
        if i % 11 == 0:
            lines.append(f"mail u{i}@x.org or 10.0.0.{i} today, {lines[0]}")
        out.append([i, "\n".join(lines), lang])
    for i, src in ((120, 3), (121, 3), (122, 40)):  # copies, one with a word changed
        out.append([i, out[src][1] + (" tail" if i == 121 else ""), out[src][2]])
    out[50][1] += " " + items[2][1] + " more"
    out[51][1] = items[5][1]
    out += [[123, "$%&/ 9#@! " * 30, "a"], [124, None, "a"], [125, "", "b"], [None, out[3][1], "a"], [126, "x" * 20_000 + " " + out[5][1] * 3, "b"], [127, out[60][1], out[60][2]], [127, out[60][1], out[60][2]]]
    labels = [(i, int(i % 3 != 0), int(i % 5 == 0)) for i in range(100)] + [(None, 1, 1), (7, 1, 0)]
    return {"documents": [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in out], "benchmark": items, "labels": labels}


@pytest.fixture(scope="module")
def small(spark, rows, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows["documents"], SCHEMA).coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(rows["benchmark"], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(rows["labels"], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 8))
    made = [(i, [float(x) for x in v[i % 40] + (i >= 40) * 0.05 * rng.normal(size=8)], i % 3) for i in range(150)] + [(200, None, 1), (201, [0.0] * 8, 1)]
    spark.createDataFrame(made, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return str(d)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        # Ids that are null or repeat are not what the SQL is about.
        con.sql(f"create table {t} as select * from '{small}/{t}.parquet/*.parquet'")
    if name == "op10_line_dedup":
        con.sql("delete from documents where doc_id is null or doc_id = 127")
    df = queries.queries()[name](spark, small)
    if name == "op10_line_dedup":
        df = df.where("doc_id <> 127")
    want = con.sql(queries.oracle_sql()[name])
    order = [df.columns.index(c) for c in want.columns]
    assert sorted(tuple(r[k] for k in order) for r in df.collect()) == sorted(want.fetchall()) if name != "op1_sharding" else collections.Counter(tuple(r[k] for k in order) for r in df.collect()) == collections.Counter(want.fetchall())


def leaks(rows):
    """(document, item) by an exhaustive search over the rule of acceptance, answer words included."""
    texts = [(i, t) for i, t, *_ in rows["documents"]]
    out = set()
    for k, item in {(k, x) for k, x in rows["benchmark"] if x}:
        for i, t in texts:
            w = set(re.findall(r"\w+", (t or "").lower()))
            if len(w & set(item.split())) >= 4 and accepted(t or "", item):
                out.add((i, k))
    return out


def test_op2(spark, small, rows):
    found = {(x.doc_id, x.item_id) for x in queries.op2_decontamination(spark, small).collect()}
    assert found == leaks(rows) and {(50, 2), (51, 5)} <= found


def near_links(texts):
    c = [cells(t) for t in texts]
    return [(i, j) for j in range(len(c)) for i in range(j) if c[i] and c[j] and 5 * (c[i] & c[j]).total() >= 4 * (c[i] | c[j]).total()]


def test_op3(spark, small, rows):
    docs = [x for x in rows["documents"] if x[0] is not None]
    want = classes([x[1] for x in docs], near_links([x[1] for x in docs]))
    want = collections.Counter((x[0], docs[w][0], x[0] == docs[w][0]) for x, w in zip(docs, want, strict=True)) + collections.Counter([(None, None, True)])
    assert collections.Counter(tuple(x) for x in queries.op3_minhash_near_dedup(spark, small).collect()) == want


def kept_by_quality(spark, rows):
    """Perplexities by the recursion over dictionaries, and quantiles by sorting."""
    ids = sorted({i for i, q, _ in rows["labels"] if q == 1 and i is not None})
    at = spark.createDataFrame([(i,) for i in ids], "i long").select("i", (F.pmod(F.xxhash64("i"), F.lit(quality.FOLDS)) == 0).alias("aside")).collect()
    aside = {x.i for x in at if x.aside}
    trusted = set(ids)
    p, cache = kneser_ney([t.encode() for i, t, *_ in rows["documents"] if i in trusted - aside and t], 5), {}

    def level(t):
        b = b"\0" * 4 + t.encode()
        for j in range(len(b) - 4):
            cache.setdefault(b[j : j + 5], None)
            if cache[b[j : j + 5]] is None:
                cache[b[j : j + 5]] = math.log(p(b[j : j + 5]))
        n = len(b) - 4
        return -sum(cache[b[j : j + 5]] for j in range(n)) / n, n

    levels = [(i, lang, *level(t)) if t else (i, lang, None, 0) for i, t, lang, *_ in rows["documents"]]
    marked = [x for x in levels if x[0] in aside and x[2] is not None] or [x for x in levels if x[0] in trusted and x[2] is not None]
    corrected = lambda x: x[2] - quality.SHORT / math.sqrt(max(1, x[3]))

    def quantile(values):
        values = sorted(values)
        return values[max(0, math.ceil(quality.QUANTILE * len(values)) - 1)]

    by = collections.defaultdict(list)
    for x in marked:
        by[x[1]].append(corrected(x))
    cuts = {k: quantile(v) for k, v in by.items()}
    overall = quantile([corrected(x) for x in marked])
    return [(i, x is not None and x <= cuts.get(lang, overall) + quality.MARGIN + quality.SHORT / math.sqrt(max(1, n))) for i, lang, x, n in levels]


def test_op4(spark, small, rows):
    got = collections.Counter((x.doc_id, x.keep) for x in queries.op4_quality(spark, small).collect())
    want = collections.Counter(kept_by_quality(spark, rows))
    assert got == want and 0 < sum(n for (_, keep), n in got.items() if not keep) < len(got) / 2


def test_op5(spark, small, rows):
    out = queries.op5_toxicity(spark, small).collect()
    assert sorted(str(x.doc_id) for x in out) == sorted(str(x[0]) for x in rows["documents"])
    for x in out:
        assert x.held_out == (zlib.crc32(("" if x.doc_id is None else str(x.doc_id)).encode()) % 5 == 0)
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5)


def tokens(rows):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(queries.RANKS), "rb"))}
    return collections.Counter((i, len(x := plain_bpe(t or "", ranks)), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows)


def test_op6(spark, small, rows):
    rows = [x for x in rows["documents"] if x[0] != 126]  # a run of one letter takes the plain version too long
    out = queries.op6_byte_bpe(spark, small).where("doc_id is null or doc_id <> 126").collect()
    assert collections.Counter((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in out) == tokens(rows)


def test_op7(spark, small, rows):
    want = collections.Counter()
    for i, t, *_ in rows["documents"]:
        spans = base_spans(t or "")
        n = collections.Counter(s[2] for s in spans)
        want[i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()] += 1
    out = queries.op7_pii(spark, small).collect()
    assert collections.Counter((x.doc_id, x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256) for x in out) == want
    assert any(x.spans for x in out) and "Python" not in queries.op7_pii(spark, small)._jdf.queryExecution().executedPlan().toString()


def test_op9(spark, small, rows):
    docs = sorted(x for x in rows["documents"] if x[0] not in (None, 127))
    want = [(x[0], n, gone, runs, hashlib.sha256(kept).hexdigest()) for x, (n, gone, runs, kept) in zip(docs, without_repeats([(x[1] or "").encode() for x in docs]), strict=True)]
    out = queries.op9_suffix_array_dedup(spark, small).where("doc_id < 127").collect()
    assert sorted(tuple(x) for x in out) == want


# The stages, each on its own input.


def as_rows(df):
    return collections.Counter(tuple(x) for x in df.select("doc_id", "text", "lang", "source", "n_chars").collect())


def of(spark, rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def together(rows, keep):
    """Rows whose id any row of `keep` has, and those with a null id."""
    ids = {i for i, k in keep if k}
    return collections.Counter(x for x in rows if x[0] is None or x[0] in ids)


def test_quality_stage(spark, small, rows):
    assert as_rows(corpus_pipeline.quality_stage(spark, of(spark, rows["documents"]), small)) == together(rows["documents"], kept_by_quality(spark, rows))


def without_later_lines(rows):
    sets = {}
    for i, t, *_ in rows:
        for k, line in enumerate((t or "").split("\n")):
            if i is not None and (s := frozenset(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", line.lower()))):
                sets[i, k] = s
    gone = {b for b in sets for a in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    out = collections.Counter()
    for i, t, lang, source, _ in rows:
        if t and (left := "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)):
            out[i, left, lang, source, len(left)] += 1
    return out


def test_line_stage(spark, small, rows):
    want = without_later_lines(rows["documents"])
    assert as_rows(corpus_pipeline.line_stage(spark, of(spark, rows["documents"]), small)) == want and sum(want.values()) < len(rows["documents"]) - 2


def test_near_stage(spark, small, rows):
    docs = [x for x in rows["documents"] if x[0] is not None]
    roots = classes([x[1] for x in docs], near_links([x[1] for x in docs]))
    want = together(rows["documents"], [(x[0], docs[w][0] == x[0]) for x, w in zip(docs, roots, strict=True)])
    assert as_rows(corpus_pipeline.near_stage(spark, of(spark, rows["documents"]), small)) == want


def test_leak_stage(spark, small, rows):
    bad = {i for i, _ in leaks(rows)}
    assert as_rows(corpus_pipeline.leak_stage(spark, of(spark, rows["documents"]), small)) == together(rows["documents"], [(x[0], x[0] not in bad) for x in rows["documents"]])


def test_token_stage(spark, small, rows):
    some = rows["documents"][:40] + rows["documents"][-6:-3]
    out = corpus_pipeline.token_stage(spark, of(spark, some), small).collect()
    assert collections.Counter((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in out) == tokens(some)


def test_stages_of_an_empty_table(spark, small):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, of(spark, []), small).count() == 0


def test_the_pipeline_chains_its_stages(spark, small, rows):
    out = entry.queries()["pipeline"](spark, small)
    docs = of(spark, rows["documents"])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    key = lambda df: collections.Counter((x.doc_id, x.ids_sha256) for x in df.collect())
    assert key(out) == key(docs) and 0 < out.count() < len(rows["documents"])
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert len([p for p in os.listdir(folder) if p.startswith("stage-")]) == 1


