"""The remote interface against a stub."""

import json

import pytest

from spindrift.sources.remote import RemoteArtifacts, RemoteError


class Stub:
    def __init__(self, runs, files, jobs=(), scheme="Bearer"):
        self.runs, self.files, self.jobs, self.scheme, self.calls = runs, files, jobs, scheme, []

    def __call__(self, method, url, headers):
        self.calls.append((method, url))
        if headers["Authorization"] != f"{self.scheme} t":
            return 401, b""
        path, _, query = url.partition("https://h.example/api/v2/accounts/7")[2].partition("?")
        if path == "/jobs/":
            return 200, json.dumps({"data": list(self.jobs)}).encode()
        if path == "/runs/":
            return 200, json.dumps({"data": [r for r in self.runs if "status=10" not in query or r["status"] == 10]}).encode()
        _, _, run, _, file = path.split("/")
        body = self.files.get((int(run), file))
        return (404, b"") if body is None else (200, b"" if method == "HEAD" else body)


def remote(stub):
    return RemoteArtifacts("https://h.example/", "7", "t", stub)


DOC = b'{"nodes": {}}'


def test_the_newest_run_with_both_files_is_taken(tmp_path):
    stub = Stub([{"id": 3, "status": 10}, {"id": 2, "status": 10}, {"id": 1, "status": 10}], {(3, "manifest.json"): DOC, (2, "manifest.json"): DOC, (2, "catalog.json"): DOC}, [{"id": 5, "name": "Nightly"}, {"id": 6, "name": "other"}])
    r = remote(stub)
    found = r.fetch(str(tmp_path), name="night")
    assert sorted(found) == ["catalog.json", "manifest.json"] and (tmp_path / "manifest.json").read_bytes() == DOC
    assert any("/runs/2/artifacts/manifest.json" in u for m, u in stub.calls if m == "GET") and r.scheme == "Bearer"
    assert any("job_definition_id=5" in u for _, u in stub.calls)


def test_fallbacks_and_errors(tmp_path):
    assert remote(Stub([{"id": 3, "status": 10}, {"id": 2, "status": 10}], {(2, "manifest.json"): DOC})).best_run("1") == 2
    assert remote(Stub([{"id": 9, "status": 20, "finished_at": None}, {"id": 8, "status": 20, "finished_at": "x"}], {})).best_run("1") == 8
    assert list(remote(Stub([], {(2, "manifest.json"): DOC})).download(2, str(tmp_path))) == ["manifest.json"]
    for call in (lambda: remote(Stub([], {})).best_run("1"), lambda: remote(Stub([{"id": 1, "status": 10}], {})).best_run("1"), lambda: remote(Stub([], {}, [{"id": 1}, {"id": 2}])).job(), lambda: remote(Stub([], {})).job(name="x"), lambda: remote(Stub([], {(2, "manifest.json"): b"<html>"})).download(2, str(tmp_path)), lambda: remote(Stub([], {(2, "manifest.json"): b"[]"})).download(2, str(tmp_path)), lambda: remote(Stub([], {}, scheme="None")).job(), lambda: RemoteArtifacts("", "7", "t")):
        with pytest.raises(RemoteError):
            call()
