"""A batch DataSource that reads cached HTTP snapshots (url, status, body); fetching is a pluggable callable.

spark.dataSource.register(SnapshotSource); spark.read.format("snapshot").option("urls", ...).option("cache", folder)

Option "fetcher" names a callable as "module:function" (url -> (status, body as text or bytes)), "delay" the seconds between calls to one host.
"""

from __future__ import annotations

import codecs
import importlib
import json
import os
import re
import time
from hashlib import sha256

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRIES = 3
PERMANENT = (403, 404, 410)


_DECLARED = re.compile(rb"""^\s*<\?xml[^>]*?encoding\s*=\s*["']([A-Za-z0-9._:-]+)["']""")
_MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))


def decoded(body: bytes | str) -> str:
    """A body as text: bytes by their byte order mark, else by the encoding that an XML declaration names, else as UTF-8; bad bytes become U+FFFD."""
    if isinstance(body, str):
        return body
    declared = _DECLARED.match(body[:400])
    name = next((n for mark, n in _MARKS if body.startswith(mark)), declared.group(1).decode() if declared else "utf-8")
    try:
        return body.decode(name, "replace")
    except LookupError:  # an encoding that nobody knows
        return body.decode("utf-8", "replace")


def fetch_cached(url: str, cache: str, get=None, delay: float = 0.0, refresh: bool = False) -> tuple[int | None, str | None, str]:
    """(status, body, error) of url; results, failures too, are kept under the hash of the url."""
    base = os.path.join(cache, sha256(url.encode()).hexdigest()[:24])
    if os.path.exists(base + ".meta") and not (refresh and get):
        with open(base + ".meta") as f:
            meta = json.load(f)
        if os.path.exists(base + ".body"):
            with open(base + ".body", encoding="utf-8") as f:
                return meta["status"], f.read(), ""
        return meta["status"], None, meta.get("error", "")
    if get is None:  # nothing was tried, so nothing is kept
        return None, None, "not in the cache"
    status, body, error = None, None, ""
    for attempt in range(RETRIES):
        time.sleep(delay * 2**attempt)
        try:
            status, body = get(url)
            body = body if body is None else decoded(body)
            error = "" if status == 200 else f"HTTP {status}"
        except OSError as e:
            error = str(e)
            continue
        if status == 200 or status in PERMANENT:
            break
    os.makedirs(cache, exist_ok=True)
    if status == 200 and body is not None:
        with open(base + ".body", "w", encoding="utf-8") as f:
            f.write(body)
    with open(base + ".meta", "w") as f:
        json.dump({"url": url, "status": status, "error": error}, f)
    return status, body if status == 200 else None, error


class _Url(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class SnapshotReader(DataSourceReader):
    def __init__(self, options):
        self.urls = json.loads(options.get("urls", "[]"))
        self.cache = options["cache"]
        self.fetcher = options.get("fetcher", "")
        self.delay = float(options.get("delay", "0"))
        self.refresh = options.get("refresh", "false") == "true"

    def partitions(self):
        from urllib.parse import urlparse

        hosts: dict[str, list[str]] = {}
        for u in self.urls:  # one host, one partition: its delay is kept in one place
            hosts.setdefault(urlparse(u).netloc, []).append(u)
        return [_Url(v) for v in hosts.values()] or [_Url([])]

    def read(self, partition):
        module, _, name = self.fetcher.partition(":")
        get = getattr(importlib.import_module(module), name) if module else None
        for u in partition.urls:
            status, body, error = fetch_cached(u, self.cache, get, self.delay, self.refresh)
            yield u, status, body, error


class SnapshotSource(DataSource):
    @classmethod
    def name(cls):
        return "snapshot"

    def schema(self):
        return "url string, http_status int, body string, error string"

    def reader(self, schema):
        return SnapshotReader(self.options)
