"""A sink of Markdown documents: each becomes a title and blocks, which go out in requests of ten, in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import documents as D

REQUEST = 10


def title(text: Column, name: Column) -> Column:
    """The document's own title, else one from its name."""
    return F.coalesce(F.nullif(D.markdown_title(text), F.lit("")), F.concat(name.cast("string"), F.lit(" Upload")))


def requests(docs: DataFrame) -> DataFrame:
    """doc_id, chunk, blocks of documents (doc_id, text)."""
    nodes = docs.select("doc_id", F.posexplode(D.markdown_nodes(F.col("text"))).alias("node_no", "node"))
    return D.chunks(nodes.select("doc_id", "node_no", D.block(F.col("node")).alias("block")), REQUEST)


def publish(docs: DataFrame, send: Callable[[str, list[list]], str], dry_run: bool = False) -> DataFrame:
    """doc_id, title, block_count, dry_run, document_id of documents (doc_id, text). send(title, requests) publishes one document, on the workers, and gives its id; a dry run sends nothing."""
    blocks = F.transform(D.markdown_nodes(F.col("text")), D.block)
    rows = docs.select("doc_id", title(F.col("text"), F.col("doc_id")).alias("title"), blocks.alias("blocks")).select("*", F.size("blocks").alias("block_count"))
    if dry_run:
        return rows.select("doc_id", "title", "block_count", F.lit(True).alias("dry_run"), F.lit(None).cast("string").alias("document_id"))
    def sent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = [send(t, [list(b[k : k + REQUEST]) for k in range(0, len(b), REQUEST)]) for t, b in zip(frame["title"], frame["blocks"], strict=True)]
            yield frame.assign(document_id=ids, dry_run=False)[["doc_id", "title", "block_count", "dry_run", "document_id"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "title", "block_count", "blocks").mapInPandas(sent, f"doc_id {kind}, title string, block_count int, dry_run boolean, document_id string")
