"""A paginated JSON registry as a Spark data source.

Pages form a linked list (each holds the token of the next), so one partition reads a query; several queries, or ids to look up, are
partitions of their own. ``fetch`` is any callable from URL and parameters to a decoded page, so tests need no network.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from typing import Any
from urllib.error import HTTPError, URLError
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPACING_S, RETRIES, TIMEOUT_S = 0.5, 5, 10.0


class HistoryUnavailable(RuntimeError):
    """The registry's revision index could not be read."""


def get_json(url: str, params: dict | None = None, timeout: float = TIMEOUT_S) -> Any:
    with urlopen(f"{url}?{urlencode(params)}" if params else url, timeout=timeout) as r:
        return json.load(r)


class RegistryClient:
    """Records, pages of a search and revision histories, with spaced and repeated requests."""

    def __init__(self, base_url: str, internal_url: str | None = None, fetch: Callable[..., Any] = get_json, spacing_s: float = SPACING_S, retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep):
        self.base, self.internal, self.fetch, self.spacing, self.retries, self.sleep = base_url.rstrip("/"), (internal_url or base_url).rstrip("/"), fetch, spacing_s, retries, sleep
        self._last = 0.0

    def _get(self, url: str, params: dict | None = None) -> Any:
        for attempt in range(self.retries + 1):
            wait = self.spacing - (time.monotonic() - self._last)
            if wait > 0:
                self.sleep(wait)
            self._last = time.monotonic()
            try:
                return self.fetch(url, params)
            except (HTTPError, URLError, TimeoutError, ConnectionError):
                if attempt == self.retries:
                    raise
                self.sleep(2**attempt + random.random())

    def get_study(self, nct_id: str, fields: str | None = None) -> dict:
        return self._get(f"{self.base}/studies/{nct_id}", {"fields": fields} if fields else None)

    def search(self, page_size: int = 100, **params: str) -> Iterator[dict]:
        """All studies of a query, page after page until no token is left."""
        token = None
        while True:
            page = self._get(f"{self.base}/studies", {"pageSize": page_size, **params, **({"pageToken": token} if token else {})})
            yield from page.get("studies", [])
            token = page.get("nextPageToken")
            if not token:
                return

    def _internal(self, path: str) -> dict:
        try:
            return self._get(f"{self.internal}/{path}")
        except HTTPError as e:
            raise HistoryUnavailable(str(e)) from e

    def history(self, nct_id: str) -> dict:
        return self._internal(f"studies/{nct_id}?history=true")

    def history_version(self, nct_id: str, version: int) -> dict:
        return self._internal(f"studies/{nct_id}/history/{version}")


class _Part(InputPartition):
    def __init__(self, query: dict):
        super().__init__(query)
        self.query = query


class RegistryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self):
        ids = [x for x in self.options.get("ids", "").split(",") if x]
        return [_Part({"id": i}) for i in ids] or [_Part(json.loads(self.options.get("query", "{}")))]

    def read(self, partition):
        client = RegistryClient(self.options["url"], spacing_s=float(self.options.get("spacing", SPACING_S)))
        q = partition.query
        studies = [client.get_study(q["id"], self.options.get("fields"))] if "id" in q else client.search(**q)
        for s in studies:
            yield (s.get("protocolSection", {}).get("identificationModule", {}).get("nctId"), json.dumps(s))


class RegistrySource(DataSource):
    """``spark.dataSource.register(RegistrySource)``, then ``spark.read.format("registry").option("url", ...)``; options ``query`` (JSON), ``ids``, ``fields``, ``spacing``."""

    @classmethod
    def name(cls):
        return "registry"

    def schema(self):
        return "nct_id string, record string"

    def reader(self, schema):
        return RegistryReader(self.options)


class Downloader:
    """Resumable downloads: a file of the announced size is left alone, another is written anew and renamed when whole."""

    def __init__(self, head: Callable[[str], int | None], chunks: Callable[[str], Iterator[bytes]]):
        self.head, self.chunks = head, chunks

    def fetch(self, url: str, dest: str) -> dict:
        import hashlib
        import os

        size = self.head(url)
        status = "skipped"
        if not (os.path.exists(dest) and size is not None and os.path.getsize(dest) == size):
            os.makedirs(os.path.dirname(dest), exist_ok=True)
            with open(dest + ".part", "wb") as f:
                for c in self.chunks(url):
                    f.write(c)
            os.replace(dest + ".part", dest)
            status = "downloaded"
        with open(dest, "rb") as f:
            digest = hashlib.file_digest(f, "sha256").hexdigest()
        return {"url": url, "path": dest, "bytes": os.path.getsize(dest), "sha256": digest, "status": status}
