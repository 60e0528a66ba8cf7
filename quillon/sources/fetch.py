"""Fetching of inputs over HTTP by the driver: resumed downloads bound to one version of a file, JSON within a deadline, shards on demand."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

CHUNK = 1 << 16


def write_atomically(path: str, content: bytes) -> None:
    """The whole content under ``path``, or what was there before: written beside it and moved into place. Links are refused."""
    if os.path.islink(path):
        raise ValueError(f"{path} is a link")
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=f".{os.path.basename(path)}.")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def download(url: str, path: str, sha256: str | None = None, timeout: float = 60.0, tries: int = 5) -> dict:
    """Bring a file to ``path`` and return its receipt (url, bytes, sha256, etag), which is kept beside it.

    A broken download goes on where it stopped, but only while the server still has the same version (its entity tag, sent as If-Range);
    otherwise it begins again. The file appears under its name only when it is complete and has the expected checksum.
    """
    part, note = f"{path}.part", f"{path}.part.etag"
    error: Exception | None = None
    for attempt in range(tries):
        have = os.path.getsize(part) if os.path.exists(part) and os.path.exists(note) else 0
        request = urllib.request.Request(url)
        if have:
            with open(note) as f:
                request.add_header("If-Range", f.read())
            request.add_header("Range", f"bytes={have}-")
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                etag, resumed = answer.headers.get("ETag", ""), answer.status == 206
                if etag and not etag.startswith("W/"):
                    write_atomically(note, etag.encode())
                elif os.path.exists(note):
                    os.unlink(note)
                total = int(answer.headers["Content-Length"]) + (have if resumed else 0) if answer.headers.get("Content-Length") else None
                with open(part, "ab" if resumed else "wb") as f:
                    while chunk := answer.read(CHUNK):
                        f.write(chunk)
            if total is not None and os.path.getsize(part) != total:
                raise OSError(f"{os.path.getsize(part)} of {total} bytes came")
            break
        except (OSError, urllib.error.URLError) as e:
            error = e
            time.sleep(min(0.1 * 2**attempt, 10.0))
    else:
        raise OSError(f"{url} did not come whole") from error
    digest = hashlib.sha256()
    with open(part, "rb") as f:
        while chunk := f.read(1 << 20):
            digest.update(chunk)
    if sha256 and digest.hexdigest() != sha256:
        os.unlink(part)
        raise ValueError(f"{url} has another checksum")
    receipt = {"url": url, "bytes": os.path.getsize(part), "sha256": digest.hexdigest(), "etag": etag}
    os.replace(part, path)
    if os.path.exists(note):
        os.unlink(note)
    write_atomically(f"{path}.source.json", json.dumps(receipt, sort_keys=True).encode())
    return receipt


def fetch_json(url: str, seconds: float, most_bytes: int = 64 << 20) -> object:
    """A JSON document, whole within ``seconds`` of the call: the deadline holds while its body is read, too."""
    deadline = time.monotonic() + seconds
    body = bytearray()
    with urllib.request.urlopen(url, timeout=seconds) as answer:
        while chunk := answer.read1(CHUNK):
            body += chunk
            if time.monotonic() > deadline:
                raise TimeoutError(f"{url} took more than {seconds} s")
            if len(body) > most_bytes:
                raise ValueError(f"{url} is longer than {most_bytes} bytes")
    return json.loads(body)


class Shards:
    """Shards loaded when first asked for, at most ``most`` at a time; one that failed is tried again when asked for again."""

    def __init__(self, load: Callable[[str], object], most: int = 3):
        self._load, self._pool, self._lock = load, ThreadPoolExecutor(most), threading.Lock()
        self._held: dict[str, object] = {}
        self.failed: set[str] = set()

    def get(self, names: Iterable[str]) -> dict[str, object]:
        """What could be loaded of these; the others are in ``failed``."""
        wanted = list(dict.fromkeys(names))

        def one(name: str) -> None:
            try:
                value = self._load(name)
            except Exception:  # noqa: BLE001  whatever went wrong, the others go on
                with self._lock:
                    self.failed.add(name)
                return
            with self._lock:
                self._held[name] = value
                self.failed.discard(name)

        list(self._pool.map(one, [n for n in wanted if n not in self._held]))
        return {n: self._held[n] for n in wanted if n in self._held}
