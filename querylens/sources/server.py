"""A page and a review form on the loopback address; the driver alone serves them, and nothing is read by the engine."""

from __future__ import annotations

import hmac
import html
import http.server
import json
import os
import pathlib
import secrets
import tempfile
from urllib.parse import parse_qs

from ..operators.sampling import AXES


class _Handler(http.server.BaseHTTPRequestHandler):
    def reply(self, body: str, status: int = 200) -> None:
        raw = body.encode()
        self.send_response(status)
        for name, value in (("Content-Type", "text/html; charset=utf-8"), ("Cache-Control", "no-store"), ("X-Content-Type-Options", "nosniff"), ("Content-Length", str(len(raw)))):
            self.send_header(name, value)
        self.end_headers()
        self.wfile.write(raw)

    def log_message(self, *_args) -> None:
        """Requests are not logged: they may hold what a reviewer reads."""


def page_server(page: str, port: int = 0) -> http.server.HTTPServer:
    """Serves one page from memory at / and /index.html, to this machine alone."""

    class Handler(_Handler):
        def do_GET(self) -> None:  # noqa: N802
            if self.path in ("/", "/index.html"):
                self.reply(page)
            else:
                self.reply("not found", 404)

    return http.server.HTTPServer(("127.0.0.1", port), Handler)


def label_problem(labels: dict[str, str]) -> str | None:
    """Why a set of labels is refused: each axis holds one of its values, and an actor other than unknown needs evidence."""
    for axis, values in AXES.items():
        if labels.get(axis) not in values:
            return f"unknown {axis}"
    if labels["actor"] != "unknown" and labels["evidence"] == "annotator_inference":
        return "actor without evidence"
    return None


def review_server(sample: list[dict], metadata: dict, output: str, port: int = 0) -> http.server.HTTPServer:
    """Shows the rows of a sample (position, text, population, sampled) one by one and keeps their labels in a file, replaced as a whole.

    A file of another review is refused; a post needs the token of the form.
    """
    path, token = pathlib.Path(output), secrets.token_urlsafe(32)
    saved = json.loads(path.read_text(encoding="utf-8")) if path.exists() else {"metadata": metadata, "annotations": {}}
    if saved["metadata"] != metadata:
        raise ValueError("the file belongs to another review")
    rows = {str(r["position"]): r for r in sample}

    class Handler(_Handler):
        def do_GET(self) -> None:  # noqa: N802
            left = [k for k in rows if k not in saved["annotations"]]
            if self.path != "/" or not left:
                self.reply("<h1>Review complete</h1>" if self.path == "/" else "not found", 200 if self.path == "/" else 404)
                return
            fields = "".join(f"<label>{a}<select name='{a}' required><option value=''></option>{''.join(f'<option>{v}</option>' for v in values)}</select></label>" for a, values in AXES.items())
            self.reply(f"<form method='post'><p>{html.escape(str(rows[left[0]]['text']))}</p><input type='hidden' name='token' value='{token}'><input type='hidden' name='position' value='{left[0]}'>{fields}<button>Save</button></form>")

        def do_POST(self) -> None:  # noqa: N802
            form = {k: v[0] for k, v in parse_qs(self.rfile.read(min(int(self.headers.get("Content-Length", 0)), 65_536)).decode()).items()}
            position, labels = form.get("position"), {a: form.get(a, "") for a in AXES}
            if not hmac.compare_digest(form.get("token", ""), token):
                self.reply("wrong token", 403)
            elif position not in rows or (problem := label_problem(labels)):
                self.reply(html.escape("unknown position" if position not in rows else problem), 400)
            else:
                r = rows[position]
                saved["annotations"][position] = {**labels, "population": r["population"], "sampled": r["sampled"]}
                with tempfile.NamedTemporaryFile("w", dir=path.parent, delete=False, encoding="utf-8") as f:
                    f.write(json.dumps(saved, indent=2, ensure_ascii=False) + "\n")
                os.replace(f.name, path)
                self.send_response(303)
                self.send_header("Location", "/")
                self.send_header("Content-Length", "0")
                self.end_headers()

    return http.server.HTTPServer(("127.0.0.1", port), Handler)
