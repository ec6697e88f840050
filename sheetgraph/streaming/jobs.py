"""Streams of requests, lifecycle actions, ledger entries and extraction batches."""

from __future__ import annotations

import time
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sheetgraph.operators.netlist import batch_named_nets
from sheetgraph.operators.review import Wallet, lifecycle_step, scope_key


def replay(spark: SparkSession, df: DataFrame, folder: str, parts: int = 4) -> DataFrame:
    """A stream of a table's rows, in order of ts, null ones first. They are written part after part, each by as many tasks
    as it needs, which deal out ranges of ts, and of event_id (or else of the other columns) where many rows have one ts; a
    stream takes files by their times, so the files get times in order of what they hold."""
    path = f"{folder}/{uuid.uuid4().hex}"
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.coalesce(F.unix_micros("ts"), F.lit(-(1 << 62)))
    cuts = df.agg(F.percentile_approx(at, [k / parts for k in range(1, parts)]).alias("c")).first()["c"] or []
    edges = [None, *sorted(set(cuts)), None]
    ties = ["event_id"] if "event_id" in df.columns else [c for c in df.columns if c != "ts"]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs, files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()), []
    for k, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        part = df if low is None else df.where(at >= low)
        part = part if high is None else part.where(at < high)
        part.repartitionByRange(at, *ties).write.parquet(f"{path}/part={k:04d}")
        files += sorted(f.getPath().toString() for f in fs.listStatus(hadoop(f"{path}/part={k:04d}")) if f.getPath().getName().startswith("part-"))
    began = int(time.time() * 1000) - 2000 * len(files)
    for k, f in enumerate(files):
        fs.setTimes(hadoop(f), began + 2000 * k, -1)
    schema = spark.read.parquet(f"{path}/part=0000").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(f"{path}/part=*")


def stream_idempotent_jobs(requests: DataFrame, within: str = "24 hours") -> DataFrame:
    """The first request of each scope within the time becomes a job, as does each request without a key."""
    keyed = requests.withColumn("scope", F.coalesce(scope_key(), F.concat(F.lit("event:"), F.col("event_id").cast("string")))).withWatermark("ts", within)
    return keyed.dropDuplicatesWithinWatermark(["scope"]).select("scope", "ts", "tenant", "owner", "operation")


def stream_lifecycle(events: DataFrame, ttl_hours: int | None = None) -> DataFrame:
    """(job_id, event_id, action, accepted, state, applied, rejected): a row for each action as it arrives, with what the job
    is after it; state is kept per job. Rows that are not accepted are the side output (`lifecycle_rejected`).

    With ttl_hours a job without actions for so long (in event time) expires: its state goes, and a row says `expired`.
    """

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            _, applied, rejected = state.get
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "event_id": [None], "action": ["expire"], "accepted": [True], "state": ["expired"], "applied": [applied], "rejected": [rejected]}).astype({"event_id": "Int64"})
            return
        name, applied, rejected = state.get if state.exists else ("extracted", 0, 0)
        frames = list(frames)
        rows = frames[0] if len(frames) == 1 else pd.concat(frames)
        at, ids = rows["at"].to_numpy(), rows["event_id"].to_numpy()
        order = np.lexsort((ids, at))  # arrays: a sort of a frame, and its rows as tuples, cost more than the steps
        actions, gone = rows["action"].to_numpy()[order], []
        for action in actions:
            to = lifecycle_step(name, action)
            name, applied, rejected = (to, applied + 1, rejected) if to else (name, applied, rejected + 1)
            gone.append((to is not None, name, applied, rejected))
        state.update((name, applied, rejected))
        last = at[order[-1]]
        if ttl_hours is not None and last == last:
            state.setTimeoutTimestamp(max(int(last) // 1000 + ttl_hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        accepted, names, applies, rejects = zip(*gone, strict=True)
        yield pd.DataFrame({"job_id": [key[0]] * len(gone), "event_id": ids[order], "action": actions, "accepted": accepted, "state": names, "applied": applies, "rejected": rejects})

    out = "job_id long, event_id long, action string, accepted boolean, state string, applied long, rejected long"
    cols = ["job_id", F.unix_micros("ts").alias("at"), "event_id", "action"]  # each column, a time above all, costs every group
    if ttl_hours is not None:
        events, cols = events.withWatermark("ts", "0 seconds"), [*cols, "ts"]
    timeout = GroupStateTimeout.NoTimeout if ttl_hours is None else GroupStateTimeout.EventTimeTimeout
    return events.select(*cols).groupBy("job_id").applyInPandasWithState(step, out, "state string, applied long, rejected long", "append", timeout)


def lifecycle_current(rows: DataFrame) -> DataFrame:
    """(job_id, state, applied, rejected): where each job is after all rows of stream_lifecycle. Each row counts one more
    action, and an expiry comes last."""
    order = F.struct((F.col("action") == "expire"), F.col("applied") + F.col("rejected"))
    return rows.groupBy("job_id").agg(F.max_by(F.struct("state", "applied", "rejected"), order).alias("r")).select("job_id", "r.*")


def lifecycle_rejected(rows: DataFrame) -> DataFrame:
    """Actions that were not allowed."""
    return rows.where("not accepted").select("job_id", "event_id", "action", "state")


def stream_ledger(entries: DataFrame, remember: str | None = None) -> DataFrame:
    """(principal, balance, spent, open, refused) whenever entries of a principal arrive.

    The state of a principal is one row of sums and one small row a reservation, known by its id, so a repeated or late commit
    or refund changes nothing. With `remember` (a time such as "30 days") a reservation is forgotten so long after its last
    change: later entries on it find none. The state lives in RocksDB.
    """
    conf = entries.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ms = None if remember is None else int(pd.Timedelta(remember).total_seconds() * 1000)
    out = "principal long, balance long, spent long, open long, refused long"
    return entries.groupBy("principal").transformWithStateInPandas(Wallets(ms), out, "update", "none" if ms is None else "processingTime")


class Wallets(StatefulProcessor):
    """Folds the entries of a principal as they arrive."""

    def __init__(self, forget_ms: int | None = None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.wallet = handle.getValueState("wallet", "balance long, spent long, open long, refused long")
        self.reservations = handle.getMapState("reservations", "id long", "cost long, state string", self.forget_ms)

    def handleInputRows(self, key, rows, timerValues):
        before = self.wallet.get()
        wallet = Wallet(*map(int, before)) if before is not None else Wallet()
        entries = pd.concat(rows).sort_values(["ts", "event_id"])
        known, changed = {}, set()  # every look into the state is a message to the JVM: one a reservation, none of a new principal
        for op, amount, r in zip(entries["op"], entries["amount"].astype("int64").tolist(), entries["reservation"], strict=True):
            if pd.isna(r) or op == "topup":
                wallet.step(op, amount, None)
                continue
            r = int(r)
            if r not in known:
                value = None if before is None else self.reservations.getValue((r,))
                known[r] = None if value is None else (int(value[0]), value[1])
            after = wallet.step(op, amount, known[r])
            if after is not None:
                known[r] = after
                changed.add(r)
        for r in changed:
            self.reservations.updateValue((r,), known[r])
        self.wallet.update((wallet.balance, wallet.spent, wallet.open, wallet.refused))
        yield pd.DataFrame({"principal": [key[0]], "balance": [wallet.balance], "spent": [wallet.spent], "open": [wallet.open], "refused": [wallet.refused]})

    def close(self) -> None:
        pass


def run_to_end(stream: DataFrame, folder: str, key: str | None = None, mode: str = "append") -> DataFrame:
    """Everything a stream gives for what has arrived; with a key, the last row of each batch order wins."""
    path, spark = f"{folder}/{uuid.uuid4().hex}", stream.sparkSession

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/out/_batch={batch}")  # a replayed batch writes itself again

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    out = spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out/_batch=*")
    if key is None:
        return out.drop("_batch")
    rest = [c for c in out.columns if c not in (key, "_batch")]
    return out.groupBy(key).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(key, "r.*")


def stream_batches(arrivals: DataFrame, folder: str) -> DataFrame:
    """Named nets of each design while batches arrive, whatever their order: (design_id, net, ..., arrival), after each
    arrival the nets of the designs that it touches. `latest_nets` keeps what holds at the end.

    Each arrival is kept once per (design, batch, net, ref, pin), and the merge of its designs reads what is kept of them.
    """
    path, spark = f"{folder}/{uuid.uuid4().hex}", arrivals.sparkSession

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/rows/arrival={batch}")  # a replayed batch writes itself again
        kept = spark.read.parquet(f"{path}/rows").where(F.col("arrival") <= batch).drop("arrival")
        touched = spark.read.parquet(f"{path}/rows/arrival={batch}").select("design_id").distinct()
        own = kept.join(touched, "design_id", "left_semi").dropDuplicates(["design_id", "batch_no", "net_id", "ref", "pin"])
        batch_named_nets(own).write.mode("overwrite").parquet(f"{path}/nets/arrival={batch}")

    arrivals.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(f"{path}/nets")


def latest_nets(updates: DataFrame) -> DataFrame:
    """The nets of each design after the last arrival that touched it."""
    last = updates.groupBy("design_id").agg(F.max("arrival").alias("arrival"))
    return updates.join(last, ["design_id", "arrival"], "left_semi").drop("arrival")
