"""The message graph of a chat export, with superseded, hidden and broken nodes."""

import json

from pyspark.sql import functions as F

from strataloom.operators import chat_export


def message(role, text, t, **more):
    return {"id": f"m{t}", "author": {"role": role}, "create_time": float(t), "content": {"content_type": more.pop("content_type", "text"), "parts": text if isinstance(text, list) else [text]}, **more}


def graph():
    nodes = {"root": (None, None), "sys": ("root", message("system", "internal instruction", 1)), "u1": ("sys", message("user", "Question", 2)), "old": ("u1", message("assistant", "Old superseded answer", 3)),
             "now": ("u1", message("assistant", "Answer", 4)), "hid": ("now", message("assistant", "hidden reasoning", 5, content_type="thoughts")), "u2": ("hid", message("user", ["Next", {"content_type": "image_asset_pointer", "asset_pointer": "file-1"}], 6))}
    return {k: {"id": k, "parent": p, "children": [c for c, (q, _) in nodes.items() if q == k], "message": m} for k, (p, m) in nodes.items()}


def test_normalize(spark):
    exports = [
        {"id": "a", "title": "T", "current_node": "u2", "update_time": 10.0, "mapping": graph()}, {"id": "a", "title": "older", "current_node": "u1", "update_time": 9.0, "mapping": graph()},
        {"id": "b", "current_node": "gone", "mapping": graph()}, {"id": "c", "messages": [message("user", "flat", 1), message("assistant", "reply", 2000000000000)]}, {"id": "e", "mapping": {}},
        {"id": "long", "current_node": "n2999", "is_starred": True, "voice": {"name": "v"}, "gizmo_id": None, "default_model_slug": "m",
         "mapping": {f"n{i}": {"id": f"n{i}", "parent": f"n{i - 1}" if i else "lost", "children": [], "message": message("user", f"t{i}", i)} for i in range(3000)}},
        {"title": "circle", "current_node": "x", "mapping": {"x": {"id": "x", "parent": "y", "children": ["y"], "message": message("user", "x", 1)}, "y": {"id": "y", "parent": "x", "children": ["x"], "message": message("assistant", "y", 2)}}},
    ]
    df = spark.createDataFrame([(json.dumps(e),) for e in exports], "conversation string")
    got = {r.document_id: r for r in chat_export.normalize(df).collect()}
    a = got["chatgpt:a"]
    assert [t.role for t in a.turns] == ["user", "assistant", "user"] and a.title == "T" and a.inactive_nodes == 1
    assert a.content == "## User\n\nQuestion\n\n## Assistant\n\nAnswer\n\n## User\n\nNext\n\n[Image: file-1]"
    assert [t.node_id for t in got["chatgpt:b"].turns] == ["u1", "now", "u2"]
    assert [t.node_id for t in got["chatgpt:c"].turns] == ["flat-0", "flat-1"] and got["chatgpt:c"].updated_at.year == 2033
    assert "chatgpt:e" not in got and len(got) == 5 and any(k.startswith("chatgpt:anonymous-") for k in got)
    long = got["chatgpt:long"]
    assert [t.node_id for t in long.turns] == [f"n{i}" for i in range(3000)] and long.diagnostics == ["missing_parent"] and a.fields == {}
    assert long.fields == {"is_starred": "true", "voice": '{"name":"v"}', "default_model_slug": "m"}
    circle = next(r for k, r in got.items() if k.startswith("chatgpt:anonymous-"))
    assert [t.node_id for t in circle.turns] == ["y", "x"] and circle.diagnostics == ["circle"] and circle.inactive_nodes == 0
    assert got["chatgpt:b"].diagnostics == ["no_current_node"] and got["chatgpt:c"].diagnostics == []
    assert chat_export.normalize(df.where(F.lit(False))).count() == 0


def test_assets_and_metadata(spark):
    parts = ["text", json.dumps({"content_type": "image_asset_pointer", "asset_pointer": "file-1", "width": 3, "size_bytes": "x"}), json.dumps({"content_type": "audio"}), json.dumps({"content_type": "file"}), json.dumps({"text": "own"}), json.dumps({"a": 1}), None]
    meta = json.dumps({"model_slug": "m", "citations": [{"a": 1}], "secret": "x"})
    df = spark.createDataFrame([(1, parts, meta), (2, None, None), (3, [], "[1")], "id int, parts array<string>, meta string")
    got = {r.id: r for r in df.select("id", F.transform("parts", chat_export.part_text).alias("t"), chat_export.part_assets(F.col("parts")).alias("a"), chat_export.kept_metadata(F.col("meta")).alias("m")).collect()}
    assert got[1].t[:6] == ["text", "[Image: file-1]", "[Audio]", "[File: file]", "own", "[Unsupported content: unknown]"]
    assert [tuple(x) for x in got[1].a] == [("image_asset_pointer", "file-1", None, 3, None), ("audio", None, None, None, None), ("file", None, None, None, None)]
    assert got[1].m == {"model_slug": "m", "citations": '[{"a":1}]'} and got[2].a == got[3].a == [] and got[2].m == got[3].m == {}
