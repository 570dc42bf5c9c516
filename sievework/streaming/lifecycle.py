"""The life of an uploaded document as a stateful stream: announced, parsed, stored; failed, timed out or sent twice.

Uploads are events of a document: its announcement (null text) and later its content. State is kept by document: the hash of the
content stored last, and since when it is being parsed. Statuses come out as they arise: ``parsing`` at the announcement,
``completed`` or ``failed`` (a blank content) at the content, ``duplicate`` for content equal to what is stored already, and
``timed_out`` if no content follows within a limit of event time. Content without an announcement is taken as it is.

``follow`` writes statuses and the completed documents' chunks to versioned stores. Each batch commits under its number and a
number is committed once, so a batch that runs again after a failure adds nothing; a document's earlier chunks are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.relations import chunks
from ..sources.versions import ChunkStore, Versions

UPLOADS = "doc_id long, at timestamp, text string, source string"
STATUS = "doc_id long, at timestamp, status string, digest string, text string, source string"
STATE = "digest string, since long"


def _step(limit_ms: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        digest, since = state.get if state.exists else (None, None)
        out: list[tuple] = []
        if state.hasTimedOut:
            out.append((key[0], pd.Timestamp(since + limit_ms, unit="ms"), "timed_out", None, None, None))
            since = None
        rows = sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: (r.at, isinstance(r.text, str), r.text or "")) if not state.hasTimedOut else []
        for r in rows:
            if not isinstance(r.text, str):
                if since is None:
                    since = int(r.at.timestamp() * 1000)
                    out.append((r.doc_id, r.at, "parsing", None, None, r.source))
                continue
            own = hashlib.md5(r.text.encode()).hexdigest()
            status = "failed" if not r.text.strip() else "duplicate" if own == digest else "completed"
            out.append((r.doc_id, r.at, status, own, r.text if status == "completed" else None, r.source))
            digest, since = (own if status == "completed" else digest), None
        state.update((digest, since))
        if since is not None:
            state.setTimeoutTimestamp(max(since + limit_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["doc_id", "at", "status", "digest", "text", "source"])

    return step


def statuses(uploads: DataFrame, limit: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """The statuses of a stream of uploads (UPLOADS). Rows without a doc_id have no life of their own and are left out."""
    limit_ms = int(pd.Timedelta(limit).total_seconds() * 1000)
    marked = uploads.where("doc_id is not null").withWatermark("at", late)
    return marked.groupBy("doc_id").applyInPandasWithState(_step(limit_ms), STATUS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def follow(spark: SparkSession, incoming: str, store: str, status: str, checkpoint: str, limit: str = "30 minutes", late: str = "10 minutes", files: int = 100) -> StreamingQuery:
    """Follows upload files until all that are there are done: statuses go to the versioned table ``statuses`` at status, chunks to a ChunkStore at store.

    A batch's announcements, failures and duplicates are committed before its documents are cut and stored, its completed ones
    after that, so a reader sees ``completed`` only for documents whose chunks it can read.
    """
    uploads = spark.readStream.schema(UPLOADS).option("maxFilesPerTrigger", files).parquet(incoming)

    def once(log: Versions, name: str, rows: DataFrame, batch_id: int) -> None:
        base = log.snapshot()
        if base.facts.get(name, -1) < batch_id:
            log.commit({"statuses": rows}, base, facts={name: batch_id})

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # the state's output is read three times; losing it recomputes from the checkpointed state
        try:
            told = batch.select("doc_id", "at", "status", "digest", F.lit(batch_id).cast("long").alias("batch"))
            once(Versions(spark, status), "begun", told.where("status <> 'completed'"), batch_id)
            held = ChunkStore(spark, store)
            base = held.log.snapshot()
            if base.facts.get("batch", -1) < batch_id:
                last = batch.where("status = 'completed'").groupBy("doc_id").agg(F.max_by(F.struct("text", "source"), "at").alias("l"))
                rows = chunks(last.select("doc_id", "l.text", "l.source")).select("doc_id", "ord", "chunk_id", "kb_id", "text")
                held.replace_documents(rows, facts={"batch": batch_id})
            once(Versions(spark, status), "done", told.where("status = 'completed'"), batch_id)
        finally:
            batch.unpersist()

    return statuses(uploads, limit, late).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
