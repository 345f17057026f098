"""Artifacts of a hosted scheduler over its REST interface (v2): find a job, choose a run, download and check its files.

All of it is driver work on a few small requests; send can be replaced, as in the tests.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from pathlib import Path
from urllib.error import HTTPError
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from spindrift.exceptions import LineageError

Send = Callable[[str, str, dict[str, str]], tuple[int, bytes]]
#: Status number of a run that succeeded.
SUCCESS = 10
SCHEMES = ("Token", "Bearer")
#: Successful runs that are looked through for one with both files.
RUNS = 10
FILES = ("manifest.json", "catalog.json")


class RemoteError(LineageError):
    """The interface refused a request, or holds nothing that fits."""


def send(method: str, url: str, headers: dict[str, str]) -> tuple[int, bytes]:
    """One request: status and body."""
    try:
        with urlopen(Request(url, headers=headers, method=method), timeout=60) as r:
            return r.status, r.read()
    except HTTPError as e:
        return e.code, e.read()


class RemoteArtifacts:
    """One account of the interface. The first scheme of authorisation that isn't refused is kept."""

    def __init__(self, host: str, account: str, token: str, send: Send = send) -> None:
        if not (host and account and token):
            raise RemoteError("host, account and token must all be given")
        host = host.removeprefix("https://").removeprefix("http://").rstrip("/")
        self.base, self.token, self.send, self.scheme = f"https://{host}/api/v2/accounts/{account}", token, send, None

    def request(self, path: str, params: dict | None = None, method: str = "GET") -> tuple[int, bytes]:
        url = self.base + path + (f"?{urlencode(params, doseq=True)}" if params else "")
        status, body = 401, b""
        for scheme in (self.scheme,) if self.scheme else SCHEMES:
            status, body = self.send(method, url, {"Authorization": f"{scheme} {self.token}", "Content-Type": "application/json"})
            if status != 401:
                self.scheme = scheme
                break
        return status, body

    def data(self, path: str, params: dict | None = None):
        """The data member of a JSON answer."""
        status, body = self.request(path, params)
        if status != 200:
            raise RemoteError(f"{status} for {self.base}{path}")
        return json.loads(body).get("data") or []

    def job(self, job_id: str | None = None, name: str | None = None) -> str:
        """A job's id: the given one, the only one whose name holds the given text, or the only one there is."""
        if job_id:
            return str(job_id)
        jobs = [j for j in self.data("/jobs/") if (name or "").lower() in (j.get("name") or "").lower()]
        if len(jobs) != 1:
            listed = ", ".join(f"{j['id']} {j.get('name') or ''}".strip() for j in jobs)
            raise RemoteError(f"{len(jobs)} jobs fit: {listed}" if jobs else "no job fits")
        return str(jobs[0]["id"])

    def has(self, run: int, file: str) -> bool:
        return self.request(f"/runs/{run}/artifacts/{file}", method="HEAD")[0] == 200

    def best_run(self, job: str, limit: int = RUNS) -> int:
        """The newest successful run with both files, else the newest with a manifest; without any success the last finished run."""
        newest = {"job_definition_id": job, "order_by": "-created_at"}
        runs = self.data("/runs/", newest | {"status": SUCCESS, "limit": limit})
        if not runs:
            finished = [r for r in self.data("/runs/", newest | {"limit": 5}) if r.get("finished_at")]
            if not finished:
                raise RemoteError(f"job {job} has no finished run")
            return finished[0]["id"]
        with_manifest = None
        for r in runs:
            if self.has(r["id"], FILES[0]):
                if self.has(r["id"], FILES[1]):
                    return r["id"]
                with_manifest = with_manifest or r["id"]
        if with_manifest is None:
            raise RemoteError(f"none of the last {len(runs)} successful runs of job {job} has a manifest")
        return with_manifest

    def download(self, run: int, folder: str) -> dict[str, str]:
        """Paths of the files of a run, by name. A file must be a JSON object; a catalog may be missing, a manifest may not."""
        out = {}
        os.makedirs(folder, exist_ok=True)
        for file in FILES:
            status, body = self.request(f"/runs/{run}/artifacts/{file}")
            if status == 404 and file != FILES[0]:
                continue
            if status != 200:
                raise RemoteError(f"{status} for {file} of run {run}")
            try:
                found = json.loads(body)
            except ValueError as e:
                raise RemoteError(f"{file} of run {run} is no JSON: {e}") from e
            if not isinstance(found, dict) or "nodes" not in found:
                raise RemoteError(f"{file} of run {run} has no nodes")
            path = Path(folder) / file
            path.write_bytes(body)
            out[file] = str(path)
        return out

    def fetch(self, folder: str, job_id: str | None = None, name: str | None = None) -> dict[str, str]:
        """Find the job, choose its best run and download the files."""
        return self.download(self.best_run(self.job(job_id, name)), folder)
