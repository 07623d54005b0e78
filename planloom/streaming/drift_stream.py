"""Board checks as a stream of snapshots: report a difference once, settle it, report it again.

Three tables in the cluster's shared folder hold the state, one version per micro-batch, of which two are kept: open
differences, the differences a batch settled (appended once, never rewritten), and when each board
was last read. A batch reads the versions before it and writes its own. A batch that is run again
after a failure overwrites its own versions with the same rows, so the state is exact whatever is
lost on the way, and however checks are dealt to batches: those of one batch are replayed at once.

The state is a table and not Spark's keyed state, which from Python means a call for each board and
batch, and a board's cards in one task: joins take all boards at once and split a large one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from planloom.operators import board
from planloom.session import discard, stored

STATE_SCHEMA = (
    "project_id bigint, task_id bigint, kind string, detail string, first_seen_at bigint, notified_at bigint, "
    "resolved_at bigint, fresh boolean"
)
SNAPSHOT_SCHEMA = (
    "check_no bigint, board_id string, card_id string, list_name string, title string, body string, archived boolean, "
    "members array<string>"
)
BOARD_SCHEMA = "board_id string, board_checked_at bigint"
CHECK_SECONDS = 900


class DriftWatch:
    """One watcher: snapshots arrive as files under `inbox`, state versions go under `home`."""

    def __init__(self, spark: SparkSession, home: str, planned: DataFrame):
        self.spark, self.home, self.planned = spark, home, planned
        self.inbox = f"{home}/inbox"

    def _start(self):
        snapshots = self.spark.readStream.schema(SNAPSHOT_SCHEMA).parquet(self.inbox)
        return (
            snapshots.writeStream.foreachBatch(self.check)
            .option("checkpointLocation", f"{self.home}/progress").outputMode("append")
        )

    def watch(self, seconds: int = CHECK_SECONDS) -> StreamingQuery:
        """The standing watcher."""
        return self._start().trigger(processingTime=f"{seconds} seconds").start()

    def rescan(self) -> None:
        """The same checks run by hand: whatever has arrived since the last one."""
        query = self._start().trigger(availableNow=True).start()
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()

    def _version(self, table: str, schema: str, batch_id: int) -> DataFrame:
        if batch_id < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.home}/{table}/batch={batch_id}")

    def last_batch(self) -> int:
        """The newest batch that has written its versions; -1 before the first. A check in which no
        board could be read makes no batch."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/boards")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return -1
        done = [f.getPath() for f in files.listStatus(folder) if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        return max((int(p.getName().split("=")[1]) for p in done), default=-1)

    def open(self, batch_id: int) -> DataFrame:
        """Open differences as a batch left them."""
        return self._version("open", STATE_SCHEMA, batch_id)

    def state(self, batch_id: int) -> DataFrame:
        """Open and settled differences as a batch left them; empty before the first."""
        if batch_id < 0:
            return self.spark.createDataFrame([], STATE_SCHEMA)
        settled = self.spark.read.schema(f"{STATE_SCHEMA}, batch bigint").parquet(f"{self.home}/settled")
        return self.open(batch_id).unionByName(settled.filter(F.col("batch") <= batch_id).drop("batch"))

    def boards(self, batch_id: int) -> DataFrame:
        """When each board was last read: it stays as it was where reading failed."""
        return self._version("boards", BOARD_SCHEMA, batch_id)

    def check(self, snapshots: DataFrame, batch_id: int) -> None:
        """Reconcile the state with every check of the batch, in order, each at its own time.

        Boards with no card in a check could not be read: their rows stay as they are. A check of a
        board that is not newer than the last one of that board is passed over.
        """
        seen = self.boards(batch_id - 1)
        fresh_cards = stored(
            snapshots.join(seen, "board_id", "left").filter(F.col("check_no") > F.coalesce("board_checked_at", F.lit(-1))).drop("board_checked_at")
        )
        merged = stored(board.replay(self.open(batch_id - 1), self.planned, fresh_cards).select(*[f.name for f in self.state(-1).schema]))
        newest = fresh_cards.groupBy("board_id").agg(F.max("check_no").alias("board_checked_at"))
        boards = seen.unionByName(newest).groupBy("board_id").agg(F.max("board_checked_at").alias("board_checked_at"))
        tables = {"open": merged.filter("resolved_at IS NULL"), "settled": merged.filter("resolved_at IS NOT NULL"), "boards": boards}
        for table, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.home}/{table}/batch={batch_id}")
        discard(merged)
        discard(fresh_cards)
        # A batch that is run again reads the versions before its own; older ones are done with.
        for table in ("open", "boards"):
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{table}/batch={batch_id - 2}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
