"""A buffer between micro-batches: accepted rows are inserted in full batches, the rest waits.

Each accepted row gets a sequence number: the rows accepted before its
micro-batch, and its place in the files that the micro-batch wrote.  So the
state between micro-batches is three numbers (rows accepted, rows inserted,
inserts made), kept in a ledger with one row for each micro-batch, and the
buffer's rows, fewer than one batch.

    parts/is_inserted=true/batch_id=N     rows that micro-batch N inserted, with their insert's number
    parts/is_inserted=false/batch_id=N    the buffer after micro-batch N
    ledger/batch_id=N                     the state after it, written last
    drains/batch_id=N, drained/batch_id=N a drain after micro-batch N: its intent, then the rows it inserted

A micro-batch is a function of its rows and the state after the one before, and
writes only its own folders, so one that is run again changes nothing.  A drain
states its intent first; if it dies in between, the next call completes it.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpulse.operators.positions import with_file_position
from fieldpulse.schema import STORAGE_BATCH_SIZE
from fieldpulse.session import remove_path

_MISSING = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet folder, or None if there is none (or it holds no file)."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in _MISSING:
            raise
        return None


@dataclass(frozen=True)
class State:
    """After a micro-batch, over all before it too."""

    received: int = 0
    errors: int = 0
    accepted: int = 0
    inserted: int = 0
    inserts: int = 0


class BufferedTable:
    """Rows inserted ``batch_size`` at a time under ``path``."""

    def __init__(self, spark: SparkSession, path: str, batch_size: int = STORAGE_BATCH_SIZE):
        if batch_size < 1:
            raise ValueError("a batch holds one row at least")
        self.spark, self.path, self.batch_size = spark, path, int(batch_size)
        self._one_at_a_time = threading.Lock()                   # a micro-batch and a drain

    # ---- state
    def _ledger_row(self, batch_id: int) -> State | None:
        row = read_if_there(self.spark, f"{self.path}/ledger/batch_id={batch_id}")
        return None if row is None else State(**row.first().asDict())

    def last_batch(self) -> int:
        """The newest micro-batch of the ledger, or -1."""
        ledger = read_if_there(self.spark, f"{self.path}/ledger")
        return -1 if ledger is None else int(ledger.agg(F.max("batch_id")).first()[0])

    def _before(self, batch_id: int) -> tuple[int, State, bool]:
        """The micro-batch before, the state after it (drains included), and whether its buffer was drained."""
        prior, state = batch_id - 1, self._ledger_row(batch_id - 1) if batch_id else None
        if state is None:
            ledger = read_if_there(self.spark, f"{self.path}/ledger") if batch_id else None
            found = ledger and ledger.where(F.col("batch_id") < batch_id).agg(F.max("batch_id")).first()[0]
            if found is None:
                return -1, State(), True
            prior, state = int(found), self._ledger_row(int(found))
        return prior, *self._drained(prior, state)

    def _drained(self, batch_id: int, state: State) -> tuple[State, bool]:
        if read_if_there(self.spark, f"{self.path}/drains/batch_id={batch_id}") is None:
            return state, False
        self._insert_drained(batch_id)
        return State(state.received, state.errors, state.accepted, state.accepted,
                     state.inserts + (state.accepted > state.inserted)), True

    def state(self) -> State:
        """The state now, drains included."""
        return self._before(self.last_batch() + 1)[1]

    def _buffer(self, batch_id: int) -> DataFrame | None:
        return read_if_there(self.spark, f"{self.path}/parts/is_inserted=false/batch_id={batch_id}")

    # ---- writing
    def accept(self, rows: DataFrame | None, batch_id: int, received: int, accepted: int, errors: int) -> None:
        """Take a micro-batch's accepted rows: a frame as read from the files they were written to."""
        with self._one_at_a_time:
            prior, s, drained = self._before(batch_id)
            total = s.accepted + accepted
            inserts = (total - s.inserted) // self.batch_size
            upto = s.inserted + inserts * self.batch_size
            both = None if drained else self._buffer(prior)
            both = None if both is None else both.drop("insert_no")
            if accepted:
                new = with_file_position(rows, "seq").withColumn("seq", F.col("seq") + F.lit(s.accepted - 1)).drop("_metadata")
                both = new if both is None else both.unionByName(new)
            if both is not None:
                number = F.lit(s.inserts) + F.floor((F.col("seq") - s.inserted) / self.batch_size)
                (both.withColumn("insert_no", number.cast("long"))
                 .withColumn("is_inserted", F.col("seq") < upto).withColumn("batch_id", F.lit(batch_id).cast("long"))
                 .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                 .partitionBy("is_inserted", "batch_id").parquet(f"{self.path}/parts"))
            after = State(s.received + received, s.errors + errors, total, upto, s.inserts + inserts)
            self._write_row(f"{self.path}/ledger/batch_id={batch_id}", after.__dict__)
            if prior > 0:                     # the buffer before the last is of no use any more, even to a re-run
                remove_path(self.spark, f"{self.path}/parts/is_inserted=false/batch_id={prior - 1}")

    def _write_row(self, path: str, values: dict[str, int]) -> None:
        schema = ", ".join(f"{k} long" for k in values)
        self.spark.createDataFrame([tuple(values.values())], schema).coalesce(1).write.mode("overwrite").parquet(path)

    def _insert_drained(self, batch_id: int) -> None:
        out = f"{self.path}/drained/batch_id={batch_id}"
        if read_if_there(self.spark, out) is None:
            waiting = self._buffer(batch_id)
            if waiting is not None:
                waiting.write.mode("overwrite").parquet(out)

    def drain(self) -> int:
        """Insert what waits in the buffer now; returns how many rows (none right after another drain)."""
        with self._one_at_a_time:
            last = self.last_batch()
            if last < 0:
                return 0
            state, done = self._drained(last, self._ledger_row(last))
            waiting = state.accepted - state.inserted
            if done or not waiting:
                return 0
            self._write_row(f"{self.path}/drains/batch_id={last}", {"rows": waiting})
            self._insert_drained(last)
            return waiting

    # ---- reading
    def table(self) -> DataFrame | None:
        """All inserted rows with ``seq``, their place in the order of acceptance, and ``insert_no``; None before the first."""
        full = read_if_there(self.spark, f"{self.path}/parts")
        full = None if full is None else full.where(F.col("is_inserted").cast("boolean")).drop("is_inserted", "batch_id")
        drained = read_if_there(self.spark, f"{self.path}/drained")
        if drained is None or full is None:
            return full
        return full.unionByName(drained.drop("batch_id"))

    def waiting(self) -> DataFrame | None:
        """The buffer's rows; None if there are none."""
        last = self.last_batch()
        if last < 0 or self._drained(last, self._ledger_row(last))[1]:
            return None
        return self._buffer(last)

    def counters(self) -> DataFrame:
        """received, stored (inserted rows), errors, buffered, batches_flushed, as one row."""
        s = self.state()
        return self.spark.createDataFrame(
            [(s.received, s.inserted, s.errors, s.accepted - s.inserted, s.inserts)],
            "received long, stored long, errors long, buffered long, batches_flushed long")
