import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np

from pellucid.operators import agent, reasoner
from pellucid.operators.plugins import Tool
from pellucid.sources import images


def test_report_uses_system_prompt_and_tool_history():
    asked = []

    def chat(messages, image):
        asked.append(messages)
        return json.dumps({"is_success": True, "reasoning": "seen", "finally_result": 1})

    got, error, n = agent.report(chat, [("human", "", "?"), ("tool", "semantic_context_extraction", "{}")], 3)
    assert (got["finally_result"], error, n) == (1, None, 1)
    assert asked[0][0][0] == "system" and "semantic_context_extraction" in asked[0][1][2]


def test_failures_are_recorded():
    def broken(messages, image):
        raise OSError("down")

    r = agent.solve("a.png", None, broken, {})
    assert (r["is_success"], r["error"], r["llm_errors"]) == (False, "OSError: down", 1)
    tool = Tool("t", "", lambda p: {"p": p})
    r = agent.solve("a.png", None, lambda m, i: json.dumps({"tool": "t"}), {"t": tool}, cap=5)
    assert (r["error"], r["stage"]) == ("max_iterations", "MAX_ITERATIONS") and r["tool_calls"] < 6

    def never(messages, image):
        return "{}" if messages[0][0] == "system" else "update stage to: forensic_report_formulation"

    r = agent.solve("a.png", "data:", never, {}, cap=4)
    assert (r["error"], r["is_success"], r["finally_result"]) == ("max_iterations", False, None) and r["llm_errors"] >= 3
    r = agent.solve("a.png", "data:", lambda m, i: "update stage to: error", {})
    assert r["error"] == "error"


def test_http_sends_the_image_and_tries_again():
    seen = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(503 if len(seen) == 1 else 200)
            self.end_headers()
            if len(seen) > 1:
                self.wfile.write(json.dumps({"choices": [{"message": {"content": "fine"}}]}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask = reasoner.http(f"http://127.0.0.1:{server.server_port}", "m", system="be exact", pause=0.01, temperature=0.1)()
    assert ask("what?", "data:image/png;base64,AA==") == "fine" and len(seen) == 2
    assert seen[1]["messages"][0] == {"role": "system", "content": "be exact"} and seen[1]["temperature"] == 0.1
    assert seen[1]["messages"][1]["content"] == [{"type": "image_url", "image_url": {"url": "data:image/png;base64,AA=="}}, {"type": "text", "text": "what?"}]
    server.shutdown()


def test_png_filters():
    import struct
    import zlib

    r = np.random.default_rng(2)
    plane = r.integers(0, 256, (10, 13)).astype(np.uint8)
    rows, before = [], np.zeros(13, int)
    for y, line in enumerate(plane.astype(int)):
        left, corner = np.insert(line[:-1], 0, 0), np.insert(before[:-1], 0, 0)
        guess = left + before - corner
        d = np.abs(np.stack([guess - left, guess - before, guess - corner]))
        paeth = np.choose(d.argmin(0), [left, before, corner])
        rows.append(bytes([y % 5]) + ((line - (0, left, before, (left + before) // 2, paeth)[y % 5]) & 255).astype(np.uint8).tobytes())
        before = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 13, 10, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
    assert np.array_equal(images.read_png(data), plane)
