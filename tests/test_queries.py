"""Every query beside its SQL over whole tables, as the driver runs them."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from strataloom.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, con, name):
    assert compare(spark, con, name, registry.queries()[name], registry.oracle_sql()[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_every_chunk_is_cited(spark):
    got = registry.queries()["citation_audit_all"](spark, SF).collect()
    chunks = spark.read.parquet(f"{SF}/knowledge_chunks.parquet").select("chunk_id").distinct().count()
    assert sum(r.retrieved_chunks - r.ambiguous for r in got) == chunks
    assert all(sum(r[k] for r in got) > 0 for k in ("valid", "invalid", "ambiguous")) and {r.status for r in got} == {"valid_id_present", "invalid_or_ambiguous_citation", "missing_citation"}


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "score", "rank"]
