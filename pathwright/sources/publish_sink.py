"""The sink of Markdown documents as a writer of Spark: `requests.write.format("pathwright_publish")`, which sends every block once.

Rows are those of `requests` (below): one request of at most ten blocks, with its document, its number in the document and the place of its
first block. Each request has a key made of its document, number and content. A task notes a key in the journal, a folder that all workers
reach, when the request is through; a task that runs again, or a later write with the same journal, sends only what is not noted. A request
whose note was lost with its task is sent again under the same key, by which the endpoint knows it (header Idempotency-Key).

Options: journal; url, or endpoint (`module:function`, called with key, document, first block and the blocks' JSON); pace, the least
seconds between two requests of a task; retries and backoff of a request."""

from __future__ import annotations

import hashlib
import importlib
import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from ..functions import documents as D
from . import extension, publish

NAME = "pathwright_publish"
SCHEMA = "document string, request int, first_block int, blocks string"


def requests(docs: DataFrame) -> DataFrame:
    """document, request (from 0), first_block (the running place of the request's first block), blocks (JSON) of documents (doc_id, text)."""
    blocks = F.transform(D.markdown_nodes(F.col("text")), D.block)
    rows = docs.select(F.col("doc_id").cast("string").alias("document"), blocks.alias("all")).where(F.size("all") > 0)
    numbers = F.sequence(F.lit(0), F.ceil(F.size("all") / publish.REQUEST).cast("int") - 1)
    one = lambda k: F.struct(k.alias("request"), (k * publish.REQUEST).alias("first_block"), F.to_json(F.slice("all", k * publish.REQUEST + 1, F.lit(publish.REQUEST))).alias("blocks"))
    return rows.select("document", F.inline(F.transform(numbers, one)))


class Journal:
    """Keys of requests that are through, one empty file each."""

    def __init__(self, uri: str):
        self.fs, self.path = pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri.removeprefix("file:"))

    def has(self, key: str) -> bool:
        return self.fs.get_file_info(f"{self.path}/{key[:2]}/{key}").type == pafs.FileType.File

    def note(self, key: str, content: bytes = b"") -> None:
        self.fs.create_dir(f"{self.path}/{key[:2]}", recursive=True)
        with self.fs.open_output_stream(f"{self.path}/{key[:2]}/{key}") as f:
            f.write(content)


@dataclass
class Sent(ds.WriterCommitMessage):
    requests: int
    blocks: int
    skipped: int


def key_of(row: Row) -> str:
    return hashlib.sha256(json.dumps([row.document, row.request, row.blocks]).encode()).hexdigest()


class Writer(ds.DataSourceWriter):
    def __init__(self, options: dict):
        self.journal, self.url, self.endpoint = options["journal"], options.get("url"), options.get("endpoint")
        self.pace, self.retries, self.backoff = float(options.get("pace", 0)), int(options.get("retries", 2)), float(options.get("backoff", 1.5))
        if bool(self.url) == bool(self.endpoint):
            raise ValueError("give either url or endpoint")

    def _sender(self) -> Callable[[str, str, int, str], None]:
        if self.endpoint:
            module, name = self.endpoint.split(":")
            return getattr(importlib.import_module(module), name)

        def post(key: str, document: str, first: int, blocks: str) -> None:
            body = json.dumps({"document": document, "index": first, "children": json.loads(blocks)}).encode()
            with urllib.request.urlopen(urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Idempotency-Key": key}), timeout=60) as got:  # noqa: S310 - the caller's address
                got.read()

        return post

    def write(self, rows: Iterator[Row]) -> Sent:
        journal, send, last = Journal(self.journal), self._sender(), 0.0
        done = Sent(0, 0, 0)
        for row in rows:
            key = key_of(row)
            if journal.has(key):
                done.skipped += 1
                continue
            time.sleep(max(0.0, last + self.pace - time.monotonic()))
            for attempt in range(self.retries + 1):
                try:
                    send(key, row.document, row.first_block, row.blocks)
                    break
                except OSError:
                    if attempt == self.retries:
                        raise
                    time.sleep(self.backoff * (attempt + 1))
            last = time.monotonic()
            journal.note(key)
            done.requests, done.blocks = done.requests + 1, done.blocks + len(json.loads(row.blocks))
        return done

    def commit(self, messages: list[Sent | None]) -> None:
        """What the write sent and skipped, summed over its tasks, in the journal's `committed`."""
        got = [m for m in messages if m is not None]
        Journal(self.journal).note("committed", json.dumps({k: sum(getattr(m, k) for m in got) for k in ("requests", "blocks", "skipped")}).encode())

    def abort(self, messages: list[Sent | None]) -> None:
        """Nothing is taken back: the journal knows what was sent, and the next write goes on from there."""


class Publish(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def register(spark: SparkSession) -> None:
    extension.register(spark, Publish)


def publish_once(docs: DataFrame, journal: str, **options: str) -> dict[str, int]:
    """Sends the documents' requests, a document's own in order within one task, and says how many requests and blocks this write sent and how many it skipped."""
    register(docs.sparkSession)
    rows = requests(docs).repartition("document").sortWithinPartitions("document", "request")
    rows.write.format(NAME).options(journal=journal, **options).mode("append").save()
    own = Journal(journal)
    with own.fs.open_input_stream(f"{own.path}/co/committed") as f:
        return json.loads(f.read())
