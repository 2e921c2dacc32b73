"""Tiles by HTTP: a client with bounded retries, run inside tasks over a table of wanted tiles.

A worker keeps its connection to a host from one tile to the next and follows redirects;
all tasks together ask for up to ``workers`` tiles at once. Errors are rows, not
exceptions, so a lost tile doesn't fail a task; a server that refuses marks its rows
fatal. Tokens never reach a message. PNG is decoded where it arrives; other forms are
written to the shared folder and read by Spark's image reader.
"""

from __future__ import annotations

import http.client
import struct
import threading
import time
import urllib.parse
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.functions import labels
from tilespark.plans import store
from tilespark.sources import images

FETCHED = "z int, x long, y long, status string, error string, fatal boolean, width int, height int, data binary, requests int, bytes long"
#: Forms that can be decoded here; see images.stored for those that aren't PNG.
ACCEPT = "image/png,image/jpeg;q=0.9,image/*;q=0.1"
REDIRECTS = 10
#: A task of its own is worth so many tiles.
TILES_A_TASK = 64


class CutOff(http.client.HTTPException):
    """A body that ended before its announced length."""

    def __init__(self, got: int) -> None:
        super().__init__(f"body cut off after {got} bytes")
        self.got = got


class Connections:
    """One kept connection for each thread and host."""

    def __init__(self, agent: str) -> None:
        self.agent, self.held = agent, threading.local()

    def __call__(self, url: str) -> tuple[int, dict, bytes]:
        for _ in range(REDIRECTS):
            status, headers, body = self.once(url)
            if status not in (301, 302, 303, 307, 308) or "location" not in headers:
                return status, headers, body
            url = urllib.parse.urljoin(url, headers["location"])
        raise http.client.HTTPException(f"stopped after {REDIRECTS} redirects")

    def once(self, url: str) -> tuple[int, dict, bytes]:
        parts = urllib.parse.urlsplit(url)
        known, host = self.held.__dict__.setdefault("hosts", {}), (parts.scheme, parts.netloc)
        for kept in (True, False):
            connection = known.pop(host, None) if kept else None
            if kept and connection is None:
                continue
            if connection is None:
                kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
                connection = kind(parts.netloc, timeout=labels.TIMEOUT_S)
            try:
                connection.request("GET", urllib.parse.urlunsplit(("", "", parts.path or "/", parts.query, "")), headers={"User-Agent": self.agent, "Accept": ACCEPT})
                answer = connection.getresponse()
            except (http.client.RemoteDisconnected, ConnectionError):
                connection.close()
                if kept:
                    continue  # the server closed it in between: a fresh one says more
                raise
            except BaseException:
                connection.close()
                raise
            return self.read(connection, answer, known, host)
        raise AssertionError

    def read(self, connection: http.client.HTTPConnection, answer: http.client.HTTPResponse, known: dict, host: tuple) -> tuple[int, dict, bytes]:
        try:
            body = answer.read(labels.MOST_BYTES)
            missing = answer.length or 0
        except http.client.IncompleteRead as e:
            body, missing = e.partial, 1
        except BaseException:
            connection.close()
            raise
        if missing or answer.will_close:
            connection.close()
        else:
            known[host] = connection
        if missing and len(body) < labels.MOST_BYTES and answer.status == 200:
            raise CutOff(len(body))
        return answer.status, {k.lower(): v for k, v in answer.getheaders()}, body


@dataclass
class Answer:
    status: str = "missing"
    body: bytes = b""
    error: str | None = None
    fatal: bool = False
    requests: int = 0
    size: int = 0


def address(template: str, z: int, x: int, y: int, token: str = "") -> str:
    url = template.replace("{z}", str(z)).replace("{x}", str(x)).replace("{y}", str(y))
    return url + ("&" if "?" in url else "?") + "token=" + urllib.parse.quote_plus(token) if token else url


class Client:
    """Asks one server, again where that can help. ``transport`` maps a URL to (status, headers, body) or raises OSError."""

    def __init__(self, transport: Callable[[str], tuple[int, dict, bytes]] | None = None, agent: str = "tilespark", retries: int = labels.RETRIES, sleep: Callable[[float], None] = time.sleep, wait: Callable[[int, float, bool], float] = labels.wait_before) -> None:
        self.transport, self.retries, self.sleep, self.wait = transport or Connections(agent), retries, sleep, wait
        self.answered = False

    def get(self, url: str) -> Answer:
        out = Answer()
        asked, timed_out, last = 0.0, False, ""
        for attempt in range(self.retries + 1):
            if attempt:
                self.sleep(self.wait(attempt, asked, timed_out))
            asked, timed_out = 0.0, False
            out.requests += 1
            try:
                status, headers, body = self.transport(url)
            except (OSError, http.client.HTTPException) as e:
                last, timed_out = labels.redact(str(e)), isinstance(e, TimeoutError)
                if isinstance(e, CutOff):
                    self.answered, out.size = True, out.size + e.got
                if not self.answered and attempt:
                    out.error, out.fatal = f"tile server refused request: {last}", True
                    return out
                continue
            self.answered = True
            out.size += len(body)
            if status == 200:
                out.status, out.body = ("ok", body) if body else ("missing", b"")
                return out
            if status in (404, 204):
                return out
            if status != 429 and status < 500:
                out.error, out.fatal = f"tile server refused request: HTTP {status} for {labels.redact(url)}", True
                return out
            asked, last = labels.asked_wait(headers.get("retry-after")), f"HTTP {status}"
        out.error = f"giving up on {labels.redact(url)} after {self.retries + 1} attempts: {last}"
        return out


def outcomes(answers: DataFrame, wait: Callable[[int, float, bool], float] = labels.wait_before) -> DataFrame:
    """id, requests, outcome, waited, from (id, codes, asked): what the client makes of a list of answers, code by code, with a Retry-After header each."""

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                left, waits = list(zip(r["codes"], r["asked"], strict=True)), []

                def answer(url: str, left: list = left) -> tuple[int, dict, bytes]:
                    code, asked = left.pop(0)
                    return code, {"retry-after": asked} if asked is not None else {}, b"x"

                got = Client(answer, sleep=waits.append, wait=wait).get("")
                rows.append((r["id"], got.requests, "fatal" if got.fatal else "failed" if got.error else got.status, float(sum(waits))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.string(), pa.float64()), strict=True)], names=["id", "requests", "outcome", "waited"])

    return answers.select("id", "codes", "asked").mapInArrow(play, "id long, requests int, outcome string, waited double")


def decoded(body: bytes) -> np.ndarray | None:
    """RGBA of a plain PNG; None for other forms."""
    if body[:8] != images.SIGNATURE:
        return None
    try:
        return images.from_png(body)
    except images.Unsupported:
        return None


def fetched(wanted: DataFrame, template: str, token: str = "", workers: int = 16, agent: str = "tilespark", stop: bool = False) -> DataFrame:
    """One row for each distinct wanted tile. Status is ok or missing; a decoding error is not fatal.

    The tiles are dealt out by their number to up to ``workers`` tasks, which share the ``workers``
    requests at once. With ``stop`` a task asks for nothing more after a refusal: the rest is refused too.
    """
    keys = store.keep(wanted.select(F.col("z").cast("int"), F.col("x").cast("long"), F.col("y").cast("long")).dropDuplicates(), "fetch")
    tasks = max(1, min(workers, -(-keys.count() // TILES_A_TASK)))
    threads = max(1, workers // tasks)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = Client(agent=agent)
        refused: list[str] = []

        def one(r: dict) -> tuple:
            image = body = None
            got = Answer(error=f"not asked for: {refused[0]}", fatal=True) if refused else client.get(address(template, r["z"], r["x"], r["y"], token))
            if got.fatal and stop and not refused:
                refused.append(got.error or "")
            if got.status == "ok":
                try:
                    image = decoded(got.body)
                    body = got.body if image is None else None
                except (ValueError, OSError, IndexError, zlib.error, struct.error) as e:
                    got.status, got.error = "missing", f"tile {r['z']}/{r['x']}/{r['y']}: decode: {e}"
            size = image.shape if image is not None else (None, None)
            return (r["z"], r["x"], r["y"], got.status, got.error, got.fatal, size[1], size[0], image.tobytes() if image is not None else None, got.requests, got.size, body)

        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.binary()]
        names = [c.split()[0] for c in FETCHED.split(", ")] + ["body"]
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                for at in range(0, len(batch), 64):
                    rows = list(pool.map(one, batch.slice(at, 64).to_pylist()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    raw = store.keep(keys.repartition(tasks, "z", "x", "y").mapInArrow(ask, FETCHED + ", body binary"), "fetched")
    return with_other_forms(raw)


def with_other_forms(raw: DataFrame) -> DataFrame:
    """The rows with what Spark's image reader makes of the bodies that aren't decoded yet."""
    rest = raw.where("body IS NOT NULL")
    if not rest.limit(1).count():
        return raw.drop("body")
    spark, folder = raw.sparkSession, store.new_path(raw.sparkSession, "bodies")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for z, x, y, body in zip(*(batch.column(c) for c in ("z", "x", "y", "body")), strict=True):
                files.create_dir(f"{root}/{z}/{x}")
                with files.open_output_stream(f"{root}/{z}/{x}/{y}.img") as out:
                    out.write(body.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

    rest.select("z", "x", "y", "body").mapInArrow(put, "n long").agg(F.sum("n")).collect()
    found = images.stored(spark, folder).select("z", "x", "y", *[F.col(c).alias(f"{c}_") for c in ("width", "height", "data")])
    read = rest.drop("width", "height", "data", "body").join(found, ["z", "x", "y"], "left")
    said = F.when(F.col("data_").isNull(), F.format_string("tile %d/%d/%d: decode: unknown image form", "z", "x", "y")).otherwise(F.col("error"))
    read = read.withColumns({"status": F.when(F.col("data_").isNull(), "missing").otherwise(F.col("status")), "error": said}).withColumnsRenamed({f"{c}_": c for c in ("width", "height", "data")})
    return raw.where("body IS NULL").drop("body").unionByName(read)


class TileSource:
    """A source for ``run.execute``. ``strict`` reads tiles of a run of one area: the first refusal ends it."""

    def __init__(self, template: str, token: str = "", workers: int = 16) -> None:
        self.template, self.token, self.workers = template, token, workers

    def __call__(self, wanted: DataFrame) -> DataFrame:
        return fetched(wanted, self.template, self.token, self.workers)

    def strict(self, wanted: DataFrame) -> DataFrame:
        return fetched(wanted, self.template, self.token, self.workers, stop=True)
