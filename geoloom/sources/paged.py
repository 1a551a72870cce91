"""Paged services as readers: `spark.read.format("offset_pages")`, and `spark.readStream` from offsets or cursors.

A service that answers by offset is counted once and read with one partition for each page, in tasks, so pages come in as
many at a time as there are cores (`at_once` bounds them). A service that answers with a cursor can only be walked page by
page: its stream fetches one page a step, and the cursor is the stream's offset, so a restart goes on where it stopped.
Answers that fail are asked for again, later each time, or when the service says (Retry-After); an error in the answer
fails the task after that, and no page is left out silently.

URLs are templates: {offset}, {page} (rows of a page) and {cursor} are filled in. Besides http and https, whatever the
Arrow file systems open may hold the answers: a file, or a folder with the parts of one answer.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

#: Rows of a page, attempts, seconds before the second attempt (twice and three times as much later).
PAGE, ATTEMPTS, PAUSE_S = 1000, 4, 1.5
#: The header that carries a cursor both ways, and the rows after which a walk of cursors ends.
CURSOR_HEADER, MOST_RECORDS = "CMR-Search-After", 2000

ROWS = "start long, place int, value string"


class ServiceError(RuntimeError):
    """What a service answered instead of a page."""


def fetched(url: str, headers: dict[str, str] | None = None, attempts: int = ATTEMPTS, pause: float = PAUSE_S, timeout: float = 60.0) -> tuple[bytes, dict[str, str]]:
    """The body and the headers (lower-case names) of an answer; asked for again when the service is busy or fails."""
    if urllib.parse.urlsplit(url).scheme not in ("http", "https"):
        return _opened(url), {}
    for attempt in range(1, attempts + 1):
        wait = pause * attempt
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as answer:
                return answer.read(), {k.lower(): v for k, v in answer.headers.items()}
        except urllib.error.HTTPError as e:
            if e.code not in (408, 425, 429, 500, 502, 503, 504) or attempt == attempts:
                raise ServiceError(f"HTTP {e.code} from {url}") from e
            asked = e.headers.get("Retry-After", "")
            wait = float(asked) if asked.isdigit() else wait
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            if attempt == attempts:
                raise ServiceError(f"no answer from {url}: {e}") from e
        time.sleep(wait)
    raise ServiceError(f"no answer from {url}")


def _opened(url: str) -> bytes:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(url)
    if system.get_file_info(path).type == fs.FileType.Directory:
        files = sorted(x.path for x in system.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))
    else:
        files = [path]
    out = []
    for f in files:
        with system.open_input_stream(f) as stream:
            out.append(stream.read())
    return b"".join(out)


def picked(answer, path: str):
    """The part of an answer that a dotted path names; None where it leads nowhere."""
    for name in filter(None, path.split(".")):
        answer = answer.get(name) if isinstance(answer, dict) else None
    return answer


def _answer(url: str, o: dict, headers: dict[str, str] | None = None) -> tuple[dict, dict[str, str]]:
    body, got = fetched(url, headers, int(o.get("attempts", ATTEMPTS)), float(o.get("pause", PAUSE_S)))
    try:
        found = json.loads(body)
    except ValueError as e:
        raise ServiceError(f"no JSON from {url}") from e
    error = picked(found, "error")
    if error:
        raise ServiceError(f"{picked(error, 'message') or error} from {url}")
    return found, got


def _rows(answer, o: dict) -> list:
    rows = picked(answer, o.get("rows", "features")) or []
    inner = o.get("row", "attributes")
    return [picked(r, inner) if inner and isinstance(r, dict) and inner in r else r for r in rows]


def _filled(o: dict, **values) -> str:
    url = o["url"]
    for name, value in values.items():
        url = url.replace("{" + name + "}", urllib.parse.quote(str(value), safe=""))
    return url


def _count(o: dict) -> int:
    if "count" in o:
        return int(o["count"])
    found, _ = _answer(o["count_url"], o)
    n = picked(found, o.get("count_at", "count"))
    if not isinstance(n, int):
        raise ServiceError(f"no count from {o['count_url']}")
    return n


@dataclass
class Span(InputPartition):
    """Rows of the service: from a first one to before an end."""

    first: int
    end: int


def _spans(first: int, end: int, o: dict) -> list[Span]:
    """One span a page, or `at_once` longer ones; an empty one where there is nothing."""
    page = int(o.get("page", PAGE))
    pages = max(0, -(-(end - first) // page))
    each = -(-pages // int(o["at_once"])) if pages and int(o.get("at_once", 0)) else 1
    step = page * max(1, each)
    return [Span(k, min(end, k + step)) for k in range(first, end, step)] or [Span(first, first)]


def _read(span: Span, o: dict) -> Iterator[tuple]:
    """All rows of a span: a service that gives fewer than a page at a time is asked on from where it stopped."""
    page, at = int(o.get("page", PAGE)), span.first
    while at < span.end:
        found, _ = _answer(_filled(o, offset=at, page=min(page, span.end - at)), o)
        rows = _rows(found, o)[: span.end - at]
        if not rows:
            return  # rows went away since they were counted
        for place, row in enumerate(rows):
            yield at + place, place, json.dumps(row, ensure_ascii=False, sort_keys=True)
        at += len(rows)


class _OffsetReader(DataSourceReader):
    def __init__(self, o: dict):
        self.o = o

    def partitions(self) -> list[Span]:
        return _spans(0, _count(self.o), self.o)

    def read(self, partition: Span) -> Iterator[tuple]:
        return _read(partition, self.o)


class _OffsetStream(DataSourceStreamReader):
    """Rows that a service appends: the offset is how many were there, and each step reads the new ones in tasks."""

    def __init__(self, o: dict):
        self.o = o

    def initialOffset(self) -> dict:  # noqa: N802
        return {"rows": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"rows": _count(self.o)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return _spans(start["rows"], end["rows"], self.o)

    def read(self, partition: Span) -> Iterator[tuple]:
        return _read(partition, self.o)


class OffsetPages(DataSource):
    """Options: url; count_url and count_at, or count; page, at_once, rows, row, attempts, pause."""

    @classmethod
    def name(cls) -> str:
        return "offset_pages"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return _OffsetReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _OffsetStream(dict(self.options))


class _CursorStream(SimpleDataSourceStreamReader):
    """One page a step. The offset holds the cursor, the rows read so far, and whether the walk has ended."""

    def __init__(self, o: dict):
        self.o = o

    def initialOffset(self) -> dict:  # noqa: N802
        return {"cursor": None, "read": 0, "done": False}

    def _page(self, start: dict) -> tuple[list[tuple], dict]:
        header = self.o.get("header", CURSOR_HEADER)
        cursor = start["cursor"]
        found, got = _answer(_filled(self.o, cursor=cursor or "", page=self.o.get("page", PAGE)), self.o, {header: cursor} if cursor else None)
        raw = _rows(found, self.o)
        most = int(self.o.get("most", MOST_RECORDS))
        rows = raw if most < 0 else raw[: max(0, most - start["read"])]
        read = start["read"] + len(raw)
        after = got.get(header.lower()) or picked(found, self.o.get("cursor_at", "cursor"))
        hits = picked(found, self.o.get("hits_at", "hits"))
        # a short page, the last hit or the most rows end the walk, as does an answer without a cursor
        done = not after or len(raw) < int(self.o.get("page", PAGE)) or 0 <= most <= read or isinstance(hits, int) and read >= hits
        out = [(start["read"] + k, k, json.dumps(r, ensure_ascii=False, sort_keys=True)) for k, r in enumerate(rows)]
        return out, {"cursor": after if not done else cursor, "read": read, "done": done}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["done"]:
            return iter([]), start
        rows, end = self._page(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        """The rows between two offsets once more, after a failure: the walk is repeated from the first one's cursor."""
        while start["read"] < end["read"] and not start["done"]:
            rows, start = self._page(start)
            yield from rows


class CursorPages(DataSource):
    """Options: url; page, most (-1: all), header or cursor_at, hits_at, rows, row, attempts, pause."""

    @classmethod
    def name(cls) -> str:
        return "cursor_pages"

    def schema(self) -> str:
        return ROWS

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _CursorStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make both formats known to a session."""
    spark.dataSource.register(OffsetPages)
    spark.dataSource.register(CursorPages)


def objects(spark: SparkSession, url: str, schema: str, key: str, **options) -> DataFrame:
    """The objects of a service that answers by offset, one for each key (the first one that it gives)."""
    register(spark)
    rows = spark.read.format("offset_pages").options(url=url, **{k: str(v) for k, v in options.items()}).load()
    row = rows.select("start", F.from_json("value", schema).alias("r"))
    return row.groupBy(F.col(f"r.{key}").alias("_k")).agg(F.min_by("r", "start").alias("r")).select("r.*")
