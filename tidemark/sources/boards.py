"""A Data Source that asks boards for their postings, page by page.

    read(spark, boards).where("ats = 'workday'")

or, without filters pushed down, as the data source itself:

    spark.dataSource.register(BoardSource)
    spark.read.format("boards").option("boards", json).load()

``boards`` is a JSON array of {ats, token, company, country, url, body, root}. A board with a url is
one request; one without, of a platform in ``paging.PAGED``, is as many pages and searches as its
listing has, asked for inside its task. Boards of one host are one task's, which keeps a pause
between requests, and hosts are dealt over at most ``tasks`` tasks. With option ``push``, filters on ats,
token, company and country are pushed down: boards that they rule out are never asked, nor are tasks
made for them.

A board that fails becomes a row with an error and no raw text; it never fails the job. Transport
errors are tried again with a growing pause; a page that is gone is not. Responses are
kept whole as text, and parsed by DataFrame code in ``parse``. A JSON or XML response that
does not parse, or one that breaks off, is an error too: its board has not answered.
"""

from __future__ import annotations

import http.client
import json
import time
import urllib.error
import urllib.parse
import urllib.request
import xml.parsers.expat
from collections import defaultdict
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition

from tidemark.schema import RAW_BOARD
from tidemark.sources import paging
from tidemark.sources.parse import ARRAYS

TRIES, TIMEOUT_S = 3, 25
GONE = (404, 410)
#: Platforms that answer in JSON, and in XML.
JSON, XML = frozenset(ARRAYS) | {"apiprobe"}, frozenset({"personio", "rssfeed"})


class FetchError(RuntimeError):
    """A board that could not be read."""


def fetch(url: str, body: dict | None = None, pause_s: float = 0.5) -> str:
    """The text behind an address, by GET or, with a body, by POST of JSON."""
    data = None if body is None else json.dumps(body).encode()
    headers = {"Accept": "application/json, application/xml, text/html", "Content-Type": "application/json"}
    last: Exception | None = None
    for attempt in range(TRIES):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data=data, headers=headers), timeout=TIMEOUT_S) as response:
                return response.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            if e.code in GONE:
                raise FetchError(f"gone: {e.code}") from e
            last = e
        except (urllib.error.URLError, http.client.HTTPException, OSError, ValueError) as e:
            last = e
        if attempt + 1 < TRIES:
            time.sleep(pause_s * 2**attempt)
    raise FetchError(str(last))


def check_whole(ats: str | None, raw: str) -> None:
    """Raises for a response that should be JSON or XML and does not parse."""
    try:
        if ats in JSON:
            json.loads(raw)
        elif ats in XML or (ats == "successfactors" and raw.lstrip()[:5].lower() in ("<?xml", "<rss ", "<feed")):
            xml.parsers.expat.ParserCreate().Parse(raw.strip(), True)
    except (ValueError, RecursionError, xml.parsers.expat.ExpatError) as e:
        raise FetchError(f"does not parse: {e}") from e


#: What filters may name, and how many tasks hosts are dealt over unless an option says otherwise.
PUSHED, TASKS = ("ats", "token", "company", "country"), 200
#: Boards are so far apart in ordinal: the pages of one stand between. The largest listing has 900.
PAGES_BITS = 10


class BoardPartition(InputPartition):
    def __init__(self, boards: list[tuple[int, dict]]):
        self.boards = boards


def host_of(board: dict) -> str:
    """Where a board is asked."""
    if address := board.get("url") or board.get("root"):
        return urllib.parse.urlsplit(address).netloc
    try:
        return urllib.parse.urlsplit(paging.PAGED[board["ats"]].urls[0].format(**paging.parts_of(board["ats"], board["token"]), at=0)).netloc
    except (KeyError, ValueError):
        return ""


def country_of(board: dict) -> str | None:
    return board.get("country") or ((board.get("token") or paging.DEFAULTS["country"]).strip().upper() if board.get("ats") == "amazonjobs" else None)


class BoardReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.boards = list(enumerate(json.loads(options.get("boards", "[]"))))
        self.pause_s = float(options.get("pause_s", "0.5"))
        self.between_s = float(options.get("between_s", "0"))
        self.tasks = int(options.get("tasks", str(TASKS)))

    def partitions(self) -> list[BoardPartition]:
        by_host: dict[str, list[tuple[int, dict]]] = defaultdict(list)
        for i, board in self.boards:
            by_host[host_of(board)].append((i, board))
        dealt: list[list] = [[] for _ in range(max(1, min(self.tasks, len(by_host))))]
        # The largest hosts first, each to the task that has least.
        for boards in sorted(by_host.values(), key=len, reverse=True):
            min(dealt, key=len).extend(boards)
        return [BoardPartition(boards) for boards in dealt]

    def read(self, partition: BoardPartition) -> Iterator[tuple]:
        for i, board in partition.boards:
            ats = board.get("ats")

            def ask(url: str, body: dict | None, ats=ats) -> str:
                raw = fetch(url, body, self.pause_s)
                check_whole(ats, raw)
                if self.between_s:
                    time.sleep(self.between_s)
                return raw

            try:
                if board.get("url") or ats not in paging.PAGED:
                    told: Iterable = [("", 0, ask(board["url"], board.get("body")), None)]
                else:
                    told = paging.pages(board, ask)
                for n, (search, page, raw, error) in enumerate(told):
                    yield self._row(i, n, board, raw, error, search, page)
            except (RuntimeError, KeyError, ValueError) as e:
                yield self._row(i, 0, board, None, f"{type(e).__name__}: {e}"[:300], "", 0)

    @staticmethod
    def _row(i: int, n: int, board: dict, raw: str | None, error: str | None, search: str, page: int) -> tuple:
        where = board.get("ats"), board.get("token"), board.get("company")
        return *where, raw, (i << PAGES_BITS) + n, datetime.now(timezone.utc), error, search, page, country_of(board)


class PushingReader(BoardReader):
    """Leaves out boards that filters rule out."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe, In)) and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                if isinstance(f, (EqualTo, In)):
                    wanted.discard(None)  # equals nothing
                name = f.attribute[0]
                self.boards = [(i, b) for i, b in self.boards if (country_of(b) if name == "country" else b.get(name)) in wanted]
            else:
                yield f


class BoardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "boards"

    def schema(self) -> str:
        return RAW_BOARD

    def reader(self, schema) -> BoardReader:
        return (PushingReader if self.options.get("push", "false").lower() == "true" else BoardReader)(self.options)


def read(spark: SparkSession, boards: list[dict], **options: str) -> DataFrame:
    """Responses of boards; filters on what PUSHED names are pushed down, for which the session must allow it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BoardSource)
    return spark.read.format("boards").options(boards=json.dumps(boards), push="true", **options).load()
