"""Columns with clashing names, nulls in every column and repeated rows: the operators' results stay those of the plain rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from compare import compare, connect
from strataloom.llm import conversations as C
from strataloom.llm import encoding as E
from strataloom.llm import mixing as M
from strataloom.llm import neardup as N
from strataloom.llm import quality as Q
from strataloom.llm import queries
from strataloom.llm import splitting as S
from strataloom.llm import vectors as V

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
RNG = random.Random(6)
TEXTS = [" ".join(f"w{RNG.randrange(60)}" for _ in range(40)) for _ in range(6)] + ["One sentence here. " * 400, "", None]
# Names the operators use inside, and their results.
CLASHING = "id t v n key ids rank leaf part word unit cid rows kind label lines words copies pieces mentions members similarity neighbour speaker at number turn_pos piece_index token_count language distance2 n_tokens bucket fingerprint".split()


def clashing(df):
    return df.select("*", *[F.lit(-1).alias(c) for c in CLASHING if c not in df.columns])


def rows_of(df):
    return sorted(map(str, df.collect()))


def _vectors(spark):
    rows = [(f"c{i}", [RNG.gauss(0, 1) for _ in range(64)]) for i in range(30)]
    return spark.createDataFrame([*rows, (None, None), ("null", None)], "id string, vector array<float>")


def _items(spark):
    rows = [("chunk", f"i{k}", t, None) for k, t in enumerate(TEXTS * 2)] + [(None, None, None, None)]
    return spark.createDataFrame(rows, "item_kind string, item_id string, text string, section_path array<string>").withColumn("arrived_at", F.lit("2024-01-01").cast("timestamp"))


def _documents(spark):
    return spark.createDataFrame([(k, t, None) for k, t in enumerate(TEXTS)] + [(None, None, None)], "doc_id long, text string, lang string")


def test_vectors(spark):
    df = _vectors(spark)
    got = rows_of(V.neighbours(df))
    assert len(got) == 300 and rows_of(V.neighbours(clashing(df))) == got


def test_splitting(spark):
    df = _items(spark)
    got = rows_of(S.split_oversized(df))
    assert got and rows_of(S.split_oversized(clashing(df))) == got


def test_conversations(spark):
    at = F.lit("2024-01-01").cast("timestamp").alias("arrived_at")
    schema = "conversation_id string, node_id string, parent string, role string, create_time double, content_type string, text string, recipient string, metadata string"
    rows = [("c", "u", None, "user", 1.0, None, "hello", None, None), ("c", "a", "u", "assistant", float("nan"), None, "hi", None, "{"), *[(None,) * 9] * 2, ("c", None, "u", "user", None, None, "x", None, None), ("n", "x", None, None, None, None, None, None, None)]
    turns = spark.createDataFrame(rows * 2, schema).select("*", at)
    heads = spark.createDataFrame([("c", None), (None, None), ("n", "x")], "conversation_id string, current_node string").select("*", at)
    want = [("c", 0, "u"), ("c", 1, "a")]
    for t, h in ((turns, heads), (clashing(turns), clashing(heads))):
        assert sorted((r.conversation_id, r.turn_pos, r.node_id) for r in C.rebuild(t, h).collect()) == want


def test_near_duplicates(spark):
    df, config = _items(spark), N.NearDupConfig(words=3, similarity=0.7, min_words=20)
    want = sorted(("chunk", *sorted((f"i{k}", f"i{k + len(TEXTS)}"))) for k in range(7))
    for d in (df, clashing(df), df.unionByName(df)):
        assert sorted(tuple(r) for r in N.pairs_of_ids(*N.near_duplicates(d, config), config).collect()) == want


@pytest.mark.skipif(not os.path.exists(E.DEFAULT_VOCABULARY), reason="no vocabulary file")
def test_encoding(spark):
    df = _documents(spark)
    got = rows_of(E.encode(df))
    assert len(got) == len(TEXTS) + 1 and rows_of(E.encode(clashing(df))) == got
    assert len(rows_of(E.encode(df.unionByName(df)))) == 2 * len(got)


def test_mixing(spark):
    docs = spark.createDataFrame([(k, s, n) for k, (s, n) in enumerate([("a", 10), ("A ", 20), ("b", 15), (None, 5), ("a", None), ("b", 0)] * 5)] + [(None, "a", 7), (None, None, None)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2), (None, None, None), ("c", None, 1)], "source string, target_share double, max_repeats int")
    got = [rows_of(x) for x in M.mix(docs, targets)]
    assert got[0] and [rows_of(x) for x in M.mix(clashing(docs), targets)] == got


def test_quality(spark):
    df = _documents(spark)
    labels = spark.createDataFrame([(0, "prose"), (None, None), (1, None), (0, "prose")], "doc_id long, label string")
    got = rows_of(Q.assess(df, labels))
    assert len(got) == len(TEXTS) + 1 and rows_of(Q.assess(clashing(df), clashing(labels))) == got


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert compare(spark, connect(SF), name, queries.queries()[name], queries.oracle_sql()[name], SF) == ""
