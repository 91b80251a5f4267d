"""Files from addresses, by the executors."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def fetch(urls: DataFrame, tries: int = 3, wait_s: float = 1.0, timeout_s: float = 60.0, most_bytes: int = 2**30, headers: dict[str, str] | None = None) -> DataFrame:
    """path (the address), length, content, error: what is found at every ``url``, as ``audio_files`` gives files, so that decoding can follow.

    Each address is fetched once however often it is listed, by one task, in up to ``tries`` attempts; what fails, and what is larger than ``most_bytes``, has an
    error and no content. Null addresses take no part. Keys of services go in ``headers``.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for url in b.url:
                content, error = None, ""
                for i in range(tries):
                    try:
                        with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout_s) as r:
                            content, error = r.read(most_bytes + 1), None
                        if len(content) > most_bytes:
                            content, error = None, f"more than {most_bytes} bytes"
                        break
                    except (urllib.error.URLError, OSError, ValueError) as e:
                        error = str(e)[:300]
                        if isinstance(e, ValueError) or getattr(e, "code", 500) in (400, 401, 403, 404, 410):
                            break
                        if i + 1 < tries:
                            time.sleep(wait_s * 2**i)
                yield pd.DataFrame({"path": [url], "length": [None if content is None else len(content)], "content": [content], "error": [error]}).astype({"length": "Int64"})

    return urls.select("url").where("url is not null").distinct().mapInPandas(read, "path string, length long, content binary, error string")
