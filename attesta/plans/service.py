"""A small HTTP service: ``GET /health``, ``POST /answer`` as server-sent events, ``GET /discrepancy/<trial>``.

Only the standard library is used. A request that finds no engine gets 503, an unknown trial 404, a bad body 422.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.trace import TraceStore
from .answering import answer, discrepancies, healthy, sse


@dataclass
class Tables:
    """What the service reads: tables of trials, outcomes and chunks, the chunks' index, and where it writes its trace."""

    spark: SparkSession
    trials: DataFrame
    outcomes: DataFrame
    chunks: DataFrame
    index: DataFrame
    store: TraceStore | None = None


def discrepancy_report(tables: Tables, nct_id: str) -> dict | None:
    """Verdicts of one trial by pair, null where a pair does not apply; None for an unknown trial."""
    of = lambda df: df.where(F.col("nct_id") == nct_id)
    if of(tables.trials).isEmpty():
        return None
    if tables.store:
        tables.store.log_query(f"discrepancy report for {nct_id}", "discrepancy")
    rows = discrepancies(of(tables.trials), of(tables.outcomes), of(tables.chunks)).collect()  # three rows
    shown = lambda r: {"verdict": r["verdict"], "retrieval_failed": r["retrieval_failed"], "method": r["method"], "citations": r["citations"], "verdict_text": r["text"]}
    return {"nct_id": nct_id, "pairs": {r["pair"]: None if r["state"] == "not_applicable" else shown(r) for r in rows}}


def handler(tables: Tables) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def _json(self, status: int, body: dict) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            if self.path == "/health":
                try:
                    ok = healthy(tables.spark)
                except Exception as e:
                    return self._json(503, {"status": "error", "detail": str(e)})
                return self._json(200 if ok else 503, {"status": "ok" if ok else "error"})
            if self.path.startswith("/discrepancy/"):
                nct_id = self.path.removeprefix("/discrepancy/")
                report = discrepancy_report(tables, nct_id)
                return self._json(404, {"detail": f"unknown nct_id: {nct_id}"}) if report is None else self._json(200, report)
            return self._json(404, {"detail": "Not Found"})

        def do_POST(self):
            if self.path != "/answer":
                return self._json(404, {"detail": "Not Found"})
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
                nct_id, question, tier = body["nct_id"], body["question"], body.get("tier")
                if not (isinstance(nct_id, str) and isinstance(question, str) and (tier is None or isinstance(tier, str))):
                    raise ValueError("nct_id, question and tier are texts")
            except (ValueError, KeyError, TypeError, AttributeError) as e:
                return self._json(422, {"detail": str(e)})
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream")
            self.end_headers()
            for event in answer(tables.spark, tables.chunks, tables.index, question, nct_id, tables.store, tier=tier, outcomes=tables.outcomes):
                self.wfile.write(sse(event).encode())
                self.wfile.flush()

    return Handler


def serve(tables: Tables, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server bound to the address; the caller runs ``serve_forever`` and ``shutdown``."""
    return ThreadingHTTPServer((host, port), handler(tables))
