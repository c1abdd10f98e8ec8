import json
import os
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from maskline.operators import extract
from maskline.operators.extract import ServerExtractor

TEMPLATE = "Find: {{CLINICAL_TEXT}}"


class Server:
    """Counts requests by their window, and how many are open at once; answers by what the window says."""

    def __init__(self):
        self.asked, self.open, self.most, self.fail, lock = Counter(), 0, 0, set(), threading.Lock()
        own = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                text = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][1]["content"].removeprefix("Find: ")
                with lock:
                    own.asked[text] += 1
                    own.open += 1
                    own.most = max(own.most, own.open)
                time.sleep(0.02)
                with lock:
                    own.open -= 1
                if text in own.fail or text == "cut":
                    # a body that is shorter than it says
                    self.send_response(200)
                    self.send_header("Content-Length", "500")
                    self.end_headers()
                    self.wfile.write(b"{")
                    return
                body = {"odd": b"[1]", "page": b"<html>", "list": b'{"choices": 3}'}.get(text) or json.dumps({"choices": [{"finish_reason": "stop", "message": {"content": f"<{text}>"}}], "usage": {"prompt_tokens": 3, "completion_tokens": "x"}}).encode()
                self.send_response(200)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.base = f"http://127.0.0.1:{self.http.server_address[1]}"


@pytest.fixture
def server():
    out = Server()
    yield out
    out.http.shutdown()


def _windows(spark, texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(2)


def _answers(done):
    return {r.doc_id: (r.finish_reason, r.content, r.prompt_tokens, r.completion_tokens, r.transport_error) for r in done.collect()}


def _want(text):
    return "stop", f"<{text}>", 3, None, None


@pytest.mark.parametrize("ledger", [False, True])
def test_every_window_has_an_answer(spark, server, tmp_path, ledger):
    texts = ["a", "b", "cut", "odd", "page", "list", ""]
    asked = ServerExtractor(server.base, "m", "s", TEMPLATE, 5, f"{tmp_path}/l" if ledger else None)
    got = _answers(asked.respond(_windows(spark, texts)))
    for i, t in enumerate(texts):
        if t in ("cut", "odd", "page", "list"):
            assert got[f"d{i}"][:4] == ("error", "", 0, 0) and got[f"d{i}"][4]
        else:
            assert got[f"d{i}"] == _want(t)
    assert set(server.asked.values()) == {1}


def test_a_stopped_run_asks_only_for_what_is_left(spark, server, tmp_path, monkeypatch):
    class Stops(ServerExtractor):
        """Dies at one window, as a job that is killed does."""

        def ask(self, text):
            if text == "w55":
                raise SystemError("stopped")
            return super().ask(text)

    monkeypatch.setattr(extract, "LEDGER_ROWS", 5)
    texts = [f"w{i}" for i in range(80)] + ["w1", "w2"]
    windows, ledger = _windows(spark, texts), f"{tmp_path}/l"
    with pytest.raises(Exception, match="stopped"):
        Stops(server.base, "m", "s", TEMPLATE, 5, ledger).respond(windows)
    first = dict(server.asked)
    assert 0 < len(first) < 80 and not [x for x in os.listdir(ledger) if x.startswith("_")]
    again = ServerExtractor(server.base, "m", "s", TEMPLATE, 5, ledger)
    assert _answers(again.respond(windows)) == {f"d{i}": _want(t) for i, t in enumerate(texts)}
    # what a task had open when it died may be asked for twice, nothing else
    assert set(server.asked) == {f"w{i}" for i in range(80)} and sum(n > 1 for n in server.asked.values()) <= 2 * 4
    before = sum(server.asked.values())
    assert _answers(again.respond(windows)) == {f"d{i}": _want(t) for i, t in enumerate(texts)}
    assert sum(server.asked.values()) == before
    # another model, prompt or template is another request
    ServerExtractor(server.base, "m2", "s", TEMPLATE, 5, ledger).respond(windows.limit(3)).collect()
    assert sum(server.asked.values()) == before + 3


def test_requests_that_are_open_at_once_are_bounded(spark, server, tmp_path):
    windows = _windows(spark, [f"w{i}" for i in range(40)])
    ServerExtractor(server.base, "m", "s", TEMPLATE, 5, f"{tmp_path}/l", at_once=3).respond(windows.coalesce(1)).count()
    assert 1 < server.most <= 3 * 4  # as many tasks as there are partitions after the digest's shuffle, at most 4


def test_errors_are_asked_for_again_where_that_is_wanted(spark, server, tmp_path):
    windows, ledger = _windows(spark, ["a", "b"]), f"{tmp_path}/l"
    server.fail.add("b")
    once = ServerExtractor(server.base, "m", "s", TEMPLATE, 5, ledger)
    assert _answers(once.respond(windows))["d1"][0] == "error"
    server.fail.clear()
    assert _answers(once.respond(windows))["d1"][0] == "error" and server.asked["b"] == 1
    again = ServerExtractor(server.base, "m", "s", TEMPLATE, 5, ledger, again=True)
    assert _answers(again.respond(windows)) == {"d0": _want("a"), "d1": _want("b")}
    assert server.asked == {"a": 1, "b": 2}
    assert _answers(once.respond(windows))["d1"] == _want("b")
