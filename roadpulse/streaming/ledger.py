"""The effect of exactly once for batches that write several tables: a ledger of (query, batch) and files that are staged first.

A batch writes its tables below `_staged`, where readers don't look. A mark says that they are whole; then each file moves to its table
under a name of its own, made of query, batch and file; at last the ledger takes the batch. A job may end
between any two of these steps: the repeated batch writes anew what isn't whole, goes on with moves that are left, or finds itself
in the ledger and does nothing. So no row is ever stored twice, and none is lost, in however many tables. Queries are
told apart by the id in their checkpoint, so a job with a new checkpoint starts a new account.

Files are handled by Hadoop's file systems, so any place that Spark writes to will do; a move is a rename of one file.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery


class Ledger:
    def __init__(self, spark: SparkSession, root: str, query: str):
        self.jvm, self.root, self.query = spark._jvm, root.rstrip("/"), query
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def of_checkpoint(cls, spark: SparkSession, root: str, checkpoint: str) -> Ledger:
        """The account of the query that the checkpoint belongs to."""
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/metadata")
        stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return cls(spark, root, json.loads(text.strip().splitlines()[-1])["id"])

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join(parts))

    def _entry(self, batch: int):
        return self.path(self.root, "_ledger", self.query, str(batch))

    def _staged(self, batch: int) -> str:
        return f"{self.root}/_staged/{self.query}/{batch}"

    def has(self, batch: int) -> bool:
        return self.fs.exists(self._entry(batch))

    def commit(self, batch: int, write: Callable[[str], None]) -> bool:
        """Stores a batch, whose tables `write` puts below the folder that it is given. False if the ledger has it already."""
        staged = self._staged(batch)
        if self.has(batch):
            self._drop(staged)
            return False
        whole = self.path(f"{staged}.whole")
        if not self.fs.exists(whole):
            self._drop(staged)
            write(staged)
            self.fs.create(whole, False).close()
        self._publish(batch, staged)
        self.fs.create(self._entry(batch), True).close()
        self._drop(staged)
        self._drop(f"{staged}.whole")
        return True

    def _drop(self, place: str) -> None:
        self.fs.delete(self.path(place), True)

    def _publish(self, batch: int, staged: str) -> None:
        if not self.fs.exists(self.path(staged)):
            return
        start = len(self.path(staged).toUri().getPath()) + 1
        files = self.fs.listFiles(self.path(staged), True)
        found = []
        while files.hasNext():
            found.append(files.next().getPath())
        for at in found:
            inside = at.toUri().getPath()[start:]
            if at.getName().startswith(("_", ".")):
                continue
            folder, name = inside.rsplit("/", 1)
            self._move(at, self.path(self.root, folder, f"{self.query}-{batch}-{name}"))

    def _move(self, at, to) -> None:
        self.fs.mkdirs(to.getParent())
        if not self.fs.rename(at, to) and not self.fs.exists(to):
            raise OSError(f"{at} was not moved to {to}")


def supervised(start: Callable[[], StreamingQuery], tolerated: int = 3, pause_s: float = 1.0, on_failure: Callable[[Exception], None] | None = None) -> int:
    """Runs a query to its end and starts it again from its checkpoint when it fails, `tolerated` times at most; gives the number of failures.

    A failure after a batch has been stored opens the account anew, so that a job that goes on never uses it up. What arrives meanwhile waits at the source, whose limit
    a trigger bounds the batches that follow.
    """
    failures = in_a_row = 0
    while True:
        query, before = None, 0
        try:
            query = start()
            query.awaitTermination()
            return failures
        except StreamingQueryException as e:
            failures += 1
            before = sum(p["numInputRows"] > 0 for p in (query.recentProgress if query is not None else []))
            in_a_row = 1 if before else in_a_row + 1
            if on_failure is not None:
                on_failure(e)
            if in_a_row > tolerated:
                raise
            time.sleep(pause_s)
