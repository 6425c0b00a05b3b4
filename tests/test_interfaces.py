import io

from corvella.cli import main
from corvella.server import answer
from corvella.sources.store import Store


def test_command_line_and_server(spark, tmp_path):
    (tmp_path / "a.txt").write_text("insulin for diabetes")
    (tmp_path / "b.md").write_text("contract law")
    path = str(tmp_path / "v")
    out = io.StringIO()
    main([path, "ingest", str(tmp_path / "a.txt")], spark, out)
    main([path, "search", "insulin", "--top-k", "1"], spark, out)
    main([path, "stats"], spark, out)
    main([path, "export", str(tmp_path / "dump")], spark, out)
    said = out.getvalue()
    assert said.startswith("1 chunks\n1. ") and "insulin for diabetes" in said and '"documents": 1' in said
    assert spark.read.json(str(tmp_path / "dump")).first().text == "insulin for diabetes"

    s = Store(spark, path)
    assert answer(s, "GET", "/health", {})[0] == 200
    status, made = answer(s, "POST", "/api/v1/add", {"text": "contract law", "namespace": "law"})
    assert status == 200 and answer(s, "GET", "/api/v1/namespaces", {})[1] == {"namespaces": ["default", "law"]}
    assert answer(s, "POST", "/api/v1/search", {"query": "law", "namespace": "law"})[1]["count"] == 1
    assert answer(s, "POST", "/api/v1/search", {"query": "law", "namespace": "none"})[0] == 400
    assert answer(s, "POST", "/api/v1/search", {"query": "law", "top_k": 101})[0] == 400
    assert answer(s, "POST", "/api/v1/search", {})[0] == 400
    assert answer(s, "DELETE", f"/api/v1/docs/{made['doc_id']}", {})[0] == 200
    assert answer(s, "DELETE", "/api/v1/docs/none", {})[0] == 404
