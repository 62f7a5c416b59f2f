"""The versioned table of chunks: replacement by document, checks before writing, two writers, readers of one version, compaction."""

import threading

import pytest

from quern.sources import store

SCHEMA = "doc_id long, chunk_id string, content string, kb_id string, vector array<double>"


def chunks(spark, *rows):
    return spark.createDataFrame([(d, f"{d}-c{n}", text, kb, [1.0, 2.0]) for d, n, text, kb in rows], SCHEMA)


def content(df):
    return sorted((r.doc_id, r.content) for r in df.collect())


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/store with blanks"


def test_documents_are_replaced_not_tenants(spark, path):
    assert store.read(spark, path) is None
    assert store.commit(chunks(spark, (1, 0, "a", "k1"), (1, 1, "b", "k1"), (2, 0, "c", "k1"), (3, 0, "d", "k2")), path, dims=2) == 1
    fresh = chunks(spark, (1, 0, "z", "k1"))
    assert store.commit(fresh, path, dims=2) == 2
    want = [(1, "z"), (2, "c"), (3, "d")]
    assert content(store.read(spark, path)) == want
    store.commit(fresh, path, dims=2)  # twice is the same as once
    assert content(store.read(spark, path)) == want
    assert content(store.read(spark, path, 1)) == [(1, "a"), (1, "b"), (2, "c"), (3, "d")]
    # A document moves to another tenant; another one goes.
    store.commit(chunks(spark, (2, 0, "y", "k2")), path, deleted=spark.createDataFrame([(3,), (77,), (None,)], "doc_id int"))
    assert content(store.read(spark, path)) == [(1, "z"), (2, "y")]
    assert content(store.read(spark, path).where("kb_id = 'k1'")) == [(1, "z")]


def test_a_failed_check_changes_nothing(spark, path, tmp_path):
    store.commit(chunks(spark, (1, 0, "a", "k1")), path, dims=2)
    files = sorted(str(p) for p in tmp_path.rglob("*"))
    wrong = spark.createDataFrame([(1, "1-c0", "x", "k1", [1.0]), (2, "2-c0", "x", "k1", None), (3, "3-c0", "x", "k1", [1.0, 2.0])], SCHEMA)
    with pytest.raises(store.Rejected, match="2 documents: 1 DIMENSION_MISMATCH, 2 COUNT_MISMATCH"):
        store.commit(wrong, path, dims=2)
    with pytest.raises(store.Rejected, match="no doc_id"):
        store.commit(chunks(spark, (None, 0, "a", "k1")), path)
    assert sorted(str(p) for p in tmp_path.rglob("*")) == files
    with pytest.raises(store.Rejected, match="columns"):
        store.commit(chunks(spark, (1, 0, "a", "k1")).drop("vector"), path)
    assert store.versions(spark, path) == [1] and content(store.read(spark, path)) == [(1, "a")] and len(list((tmp_path / "store with blanks/data").iterdir())) == 1


def test_of_two_writers_one_wins(spark, path, tmp_path):
    store.commit(chunks(spark, (1, 0, "a", "k1"), (2, 0, "b", "k1")), path)
    out = {}

    def write(name):
        try:
            out[name] = store.commit(chunks(spark, (1, 0, name, "k1"), (1, 1, name, "k1")), path, base=1)
        except store.Conflict as e:
            out[name] = str(e)

    both = [threading.Thread(target=write, args=(n,)) for n in ("x", "y")]
    [t.start() for t in both]
    [t.join() for t in both]
    assert sorted(map(str, out.values())) == ["2", "version 2 settles the same documents"]
    winner = next(n for n, v in out.items() if v == 2)
    assert content(store.read(spark, path)) == [(1, winner), (1, winner), (2, "b")]
    assert len(list((tmp_path / "store with blanks/data").iterdir())) == 2  # the loser's rows went


def test_writers_of_other_documents_both_go_on(spark, path):
    store.commit(chunks(spark, (1, 0, "a", "k1"), (2, 0, "b", "k1")), path)
    assert store.commit(chunks(spark, (1, 0, "x", "k1")), path, base=1) == 2
    assert store.commit(chunks(spark, (3, 0, "z", "k1")), path, deleted=spark.createDataFrame([(2,)], "doc_id long"), base=1) == 3
    assert content(store.read(spark, path)) == [(1, "x"), (3, "z")]
    with pytest.raises(store.Conflict):
        store.commit(chunks(spark, (2, 0, "q", "k1")), path, base=2)


def test_readers_keep_their_version(spark, path):
    store.commit(chunks(spark, (1, 0, "a", "k1")), path)
    held = store.read(spark, path)
    store.commit(chunks(spark, (1, 0, "b", "k1")), path)
    store.compact(spark, path)
    assert content(held) == [(1, "a")] and content(store.read(spark, path)) == [(1, "b")]


def test_compaction_and_vacuum(spark, path):
    for k in range(4):
        store.commit(chunks(spark, (k, 0, f"t{k}", "k1"), (9, 0, f"t{k}", None)), path)
    want = content(store.read(spark, path))
    assert store.compact(spark, path) == 5 and store.compact(spark, path) == 5
    assert content(store.read(spark, path)) == want == [(0, "t0"), (1, "t1"), (2, "t2"), (3, "t3"), (9, "t3")]
    assert len(store.vacuum(spark, path, 1)) == 4 and store.versions(spark, path) == [5]
    assert content(store.read(spark, path)) == want
    assert store.commit(chunks(spark, (0, 0, "new", "k1")), path) == 6
    assert content(store.read(spark, path))[0] == (0, "new")


def test_a_tenants_folders_only(spark, path):
    store.commit(chunks(spark, (1, 0, "a", "k1"), (3, 0, "d", "k2")), path)
    plan = store.read(spark, path).where("kb_id = 'k1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kb_id" in plan and "k1" in plan


def test_an_empty_commit_only_deletes(spark, path):
    store.commit(chunks(spark, (1, 0, "a", "k1"), (2, 0, "b", "k1")), path)
    store.commit(chunks(spark, (1, 0, "a", "k1")).limit(0), path, deleted=spark.createDataFrame([(1,)], "doc_id long"))
    assert content(store.read(spark, path)) == [(2, "b")]


def test_chunks_are_computed_once(spark, path):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    once = chunks(spark, (1, 0, "a", "k1"), (1, 1, "b", "k1"), (2, 0, "c", "k2")).mapInArrow(run, SCHEMA)
    store.commit(once, path, dims=2)
    assert seen.value == 3 and content(store.read(spark, path)) == [(1, "a"), (1, "b"), (2, "c")]
