from pyspark.sql import functions as F

from strataloom.sources import documents, files


def test_document_rows(spark, tmp_path):
    (tmp_path / "a.md").write_text("intro\n\n#  \n## Sparse design ##\n\ntext")
    (tmp_path / "copy.md").write_text("intro\n\n#  \n## Sparse design ##\n\ntext")
    (tmp_path / "plain name.md").write_text("no heading")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    raw = files.read_binary(spark, str(tmp_path))
    got = documents.normalize_documents(files.read_documents(raw), raw).withColumn("f", F.get_json_object("metadata", "$.filename")).collect()
    by = {r.f: r for r in got}
    assert set(by) == {"a.md", "copy.md", "plain name.md"} and by["a.md"].title == "Sparse design"
    assert by["a.md"].document_id == by["copy.md"].document_id and by["a.md"].document_id.startswith("document:markdown:")
    assert by["a.md"].source.provider == "markdown" and by["plain name.md"].title in ("plain name", "plain%20name")
