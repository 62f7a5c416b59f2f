"""Documents that hold a question's text, against plain comparison of all pairs."""

import duckdb
import pytest

from quern import plans
from quern.plans import search


def test_words_at_the_ends_may_go_on(spark, tmp_path):
    docs = ["The longestword here", "a longestword here", "alongestwordhere", "some inner word\nat ends", "awesome inner word\nat endings", "awesome inner word\nat\nendings", "foo bar", "xfoo bary", "foo  bar", "", None, " ", "a b", "aa bb cc", "a\tb c"]
    asked = ["longestword", "longestword here", "me inner word\nat end", "me inner word\nat\nend", "foo bar", "oo  b", "", None, " ", "foo ", "a bb c", "\tb", "\n", "b c"]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(asked)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.query_id, r.evidence_id) for r in search._evidence(spark, str(tmp_path)).collect())
    assert got == [(i, j) for i, a in enumerate(asked) for j, d in enumerate(docs) if a is not None and d is not None and a in d]


@pytest.fixture(scope="module")
def going_on(spark, tmp_path_factory):
    """Tables whose first question ends within a word of the one document that holds it."""
    at = str(tmp_path_factory.mktemp("going_on"))
    docs = ["grey stones lie here", "a red fox jumpedover", "the red foxes run jumpedoverall fences", "grey stones", "some grey stones lie still", "fox run", "fences all", "a hill"]
    asked = ["red foxes run jumpedover", "grey stones lie", "nothing of this", "e red fox"]
    spark.createDataFrame([(i, t, "en", "web") for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(enumerate(asked)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, [1.0, i / 4, i * i / 16]) for i in range(len(docs))], "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from '{at}/{t}.parquet/*.parquet'")
    return at, con


@pytest.mark.parametrize("name", ["evidence_mode_breakdown", "evidence_snapshot", "evidence_union", "rank_distribution", "rerank_effect"])
def test_words_that_go_on_in_a_document(spark, going_on, name):
    at, con = going_on
    got, want = plans.queries()[name](spark, at), con.sql(plans.oracle_sql()[name])
    plain = lambda rows, columns: sorted([str(r[i]) for i in sorted(range(len(columns)), key=columns.__getitem__)] for r in rows)
    want_rows = plain(want.fetchall(), want.columns)
    assert want_rows and plain(map(tuple, got.collect()), got.columns) == want_rows
