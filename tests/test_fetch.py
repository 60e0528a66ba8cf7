"""Downloads that break off, change under way or dawdle, from a server on this machine."""

import hashlib
import http.server
import json
import os
import threading
import time

import pytest

from quillon.sources import fetch


@pytest.fixture
def server():
    state = {"body": os.urandom(300_000), "etag": '"one"', "cuts": 0, "asked": [], "pause": 0.0}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            body, start = state["body"], 0
            state["asked"].append(self.headers.get("Range"))
            if self.headers.get("Range") and self.headers.get("If-Range") == state["etag"]:
                start = int(self.headers["Range"][6:-1])
            self.send_response(206 if start else 200)
            self.send_header("ETag", state["etag"])
            self.send_header("Content-Length", str(len(body) - start))
            self.end_headers()
            part = body[start:]
            if state["cuts"]:
                state["cuts"] -= 1
                part = part[:100_000]
            for i in range(0, len(part), 50_000):
                self.wfile.write(part[i : i + 50_000])
                time.sleep(state["pause"])

        def log_message(self, *args):
            pass

    httpd = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{httpd.server_address[1]}/x"
    yield state
    httpd.shutdown()


def test_a_broken_download_goes_on(server, tmp_path):
    server["cuts"] = 2
    receipt = fetch.download(server["url"], str(tmp_path / "f"))
    assert (tmp_path / "f").read_bytes() == server["body"]
    assert server["asked"] == [None, "bytes=100000-", "bytes=200000-"]
    assert receipt["sha256"] == hashlib.sha256(server["body"]).hexdigest() and receipt["bytes"] == 300_000
    assert json.loads((tmp_path / "f.source.json").read_text()) == receipt and sorted(os.listdir(tmp_path)) == ["f", "f.source.json"]


def test_another_version_begins_again(server, tmp_path):
    (tmp_path / "f.part").write_bytes(b"old" * 100)
    (tmp_path / "f.part.etag").write_text('"zero"')
    fetch.download(server["url"], str(tmp_path / "f"))
    assert (tmp_path / "f").read_bytes() == server["body"] and server["asked"] == ["bytes=300-"]


def test_a_wrong_checksum_leaves_nothing(server, tmp_path):
    with pytest.raises(ValueError, match="checksum"):
        fetch.download(server["url"], str(tmp_path / "f"), "0" * 64)
    assert not os.path.exists(tmp_path / "f")


def test_json_within_a_deadline(server):
    server["body"] = json.dumps({"a": [1]}).encode()
    assert fetch.fetch_json(server["url"], 5.0) == {"a": [1]}
    server["body"], server["pause"] = b" " * 400_000 + b"1", 0.2
    with pytest.raises(TimeoutError):
        fetch.fetch_json(server["url"], 0.3)
    server["pause"] = 0.0
    with pytest.raises(ValueError, match="longer"):
        fetch.fetch_json(server["url"], 5.0, most_bytes=1000)


def test_shards_are_loaded_once_and_tried_again():
    running, most, calls, broken = set(), [0], [], {"b"}

    def load(name):
        running.add(name)
        most[0] = max(most[0], len(running))
        time.sleep(0.02)
        calls.append(name)
        running.discard(name)
        if name in broken:
            raise OSError(name)
        return name.upper()

    shards = fetch.Shards(load)
    assert shards.get("abcdefg") == {c: c.upper() for c in "acdefg"} and shards.failed == {"b"} and most[0] <= 3
    broken.clear()
    assert shards.get("ab") == {"a": "A", "b": "B"} and not shards.failed and len(calls) == 8


def test_atomic_write(tmp_path):
    path = tmp_path / "x.json"
    fetch.write_atomically(str(path), b"1")
    fetch.write_atomically(str(path), b"22")
    assert path.read_bytes() == b"22" and os.listdir(tmp_path) == ["x.json"]
    os.symlink(path, tmp_path / "link")
    with pytest.raises(ValueError, match="link"):
        fetch.write_atomically(str(tmp_path / "link"), b"3")
