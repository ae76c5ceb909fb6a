"""Records as they arrive: pairing, duplicates, pileup."""

from __future__ import annotations

import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from readloom.operators.cuts import remove, shared_folder

PAIR = "qname string, rec_a long, rec_b long"
#: Open sessions of a share, as dedup_stream holds them.
HELD = pa.schema([("qname", pa.string()), ("rec", pa.int64()), ("quality", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])
#: What stands for a null there: last among records, least among qualities.
NO_REC, NO_MAPQ = 2**63 - 1, -(2**31)


def pair_stream(reads: DataFrame, wait: str = "10 minutes", shares: int = 200) -> DataFrame:
    """qname, rec_a, rec_b: a pair leaves when its second record arrives; a record whose mate hasn't come within `wait` leaves alone, with a rec_b of -1.

    reads: a stream with qname, rec_idx and an event time `ts`. State is a name and two numbers for each open name and is dropped by
    the watermark, so it follows the stream's disorder and not its length. Names are dealt into shares, and a trigger's records of a share are paired at once.
    Records that leave alone can be met with their mates in a batch join.
    """
    ms = pd.Timedelta(wait) // pd.Timedelta("1ms")

    def step(key, batches, state: GroupState):
        now = state.getCurrentWatermarkMs()
        held = pd.DataFrame(dict(zip(("qname", "rec_idx", "due"), map(list, state.get), strict=True)) if state.exists else {"qname": [], "rec_idx": [], "due": []})
        held = held.astype({"qname": object, "rec_idx": "int64", "due": "int64"})
        out = []
        if not state.hasTimedOut:
            came = pd.concat(list(batches), ignore_index=True)
            latest = came.groupby("qname", dropna=False, sort=False)["at"].max()
            met = held["qname"].isin(latest.index)
            rest = held[~met]
            new = came.dropna(subset=["rec_idx"])[["qname", "rec_idx"]].astype({"rec_idx": "int64"})
            both = pd.concat([held.loc[met, ["qname", "rec_idx"]], new], ignore_index=True).sort_values("rec_idx", kind="stable", ignore_index=True)
            group = both.groupby("qname", dropna=False, sort=False)
            first, last = group.cumcount() % 2 == 0, group.cumcount(ascending=False) == 0
            after = group["rec_idx"].shift(-1, fill_value=0)[first & ~last]
            out.append(pd.DataFrame({"qname": both.loc[after.index, "qname"], "rec_a": both.loc[after.index, "rec_idx"], "rec_b": after}))
            odd = both[first & last]
            due = latest.reindex(odd["qname"]).clip(lower=now + 1).to_numpy() + ms
            held = pd.concat([rest, odd.assign(due=due.astype("int64"))], ignore_index=True)
        gone = held["due"] <= now
        out.append(pd.DataFrame({"qname": held.loc[gone, "qname"], "rec_a": held.loc[gone, "rec_idx"], "rec_b": -1}))
        held = held[~gone]
        if len(held):
            state.update((held["qname"].tolist(), held["rec_idx"].tolist(), held["due"].tolist()))
            state.setTimeoutTimestamp(int(held["due"].min()))
        elif state.exists:
            state.remove()
        yield from (x for x in out if len(x))

    marked = reads.withWatermark("ts", wait)
    r = marked.select(F.pmod(F.xxhash64("qname"), F.lit(shares)).alias("share"), "qname", "rec_idx", "ts", F.unix_millis("ts").alias("at"))
    return r.groupBy("share").applyInPandasWithState(step, PAIR, "qname array<string>, rec array<long>, due array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def dedup_stream(reads: DataFrame, wait: str = "10 minutes", shares: int = 200) -> DataFrame:
    """qname, rec_idx, mapq: of the records of a name that come within `wait` of each other the one with the best mapping quality, on a tie the first.

    Records of a name form sessions of event time; one leaves when the watermark has passed it, so what is held follows the stream's
    disorder. Names are dealt into shares, and a trigger's records of a share meet its open sessions at once; these are held as one
    Arrow stream. Qualities are whole numbers of a byte.
    """
    us = pd.Timedelta(wait) // pd.Timedelta("1us")

    def step(key, batches, state: GroupState):
        now = state.getCurrentWatermarkMs()
        parts = [pa.ipc.open_stream(state.get[0]).read_all().to_pandas()] if state.exists else []
        if not state.hasTimedOut:
            parts += [b[["qname", "rec", "quality", "begin", "end"]] for b in batches]
        s = pd.concat(parts, ignore_index=True)
        s["name"] = pd.factorize(s["qname"], use_na_sentinel=False)[0]
        s = s.sort_values(["name", "begin"], ignore_index=True)
        reach = s.groupby("name")["end"].cummax().shift(1)
        s["session"] = ((s["name"] != s["name"].shift(1)) | (s["begin"] > reach)).cumsum()
        span = s.groupby("session").agg(begin=("begin", "min"), end=("end", "max"))
        best = s.sort_values(["session", "quality", "rec"], ascending=[True, False, True]).drop_duplicates("session")
        held = best[["qname", "rec", "quality"]].assign(begin=span["begin"].to_numpy(), end=span["end"].to_numpy())
        gone = held["end"] <= now * 1000
        if gone.any():
            yield held.loc[gone, ["qname", "rec", "quality"]]
        held = held[~gone]
        if len(held):
            sink = pa.BufferOutputStream()
            table = pa.Table.from_pandas(held, HELD, preserve_index=False)
            with pa.ipc.new_stream(sink, HELD) as w:
                w.write_table(table)
            state.update((sink.getvalue().to_pybytes(),))
            state.setTimeoutTimestamp(max(int(held["end"].min()) // 1000, now + 1))
        elif state.exists:
            state.remove()

    # a record is late once its own session would have ended: the watermark, `wait` behind the latest record, is held against its end
    marked = reads.where("ts is not null").withColumn("due", F.timestamp_micros(F.unix_micros("ts") + us)).withWatermark("due", f"{2 * us} microseconds")
    r = marked.select(
        F.pmod(F.xxhash64("qname"), F.lit(shares)).alias("share"), "qname", F.coalesce("rec_idx", F.lit(NO_REC)).cast("long").alias("rec"), F.coalesce("mapq", F.lit(NO_MAPQ)).cast("long").alias("quality"),
        F.unix_micros("ts").alias("begin"), F.unix_micros("due").alias("end"), "due",
    )
    out = r.groupBy("share").applyInPandasWithState(step, "qname string, rec long, quality long", "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    types = dict(reads.dtypes)
    return out.select("qname", F.nullif("rec", F.lit(NO_REC)).cast(types["rec_idx"]).alias("rec_idx"), F.nullif("quality", F.lit(NO_MAPQ)).cast(types["mapq"]).alias("mapq"))


def pileup_stream(reads: DataFrame, width: int = 100) -> DataFrame:
    """rname, tile, n: reads that begin in each tile of a contig, as running counts."""
    return reads.where("pos > 0").groupBy("rname", F.floor((F.col("pos") - 1) / width).alias("tile")).agg(F.count("*").alias("n"))


def _in_turn(spark: SparkSession, folder: str) -> bool:
    """Give a folder's Parquet files times in the order of their names, a second apart; whether the store has kept them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = lambda: sorted((f for f in fs.listStatus(path) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName())
    files = parts()
    if not files:
        return True
    first = min(f.getModificationTime() for f in files) // 1000 - len(files)
    for k, f in enumerate(files):
        fs.setTimes(f.getPath(), (first + k) * 1000, -1)
    times = [f.getModificationTime() for f in parts()]
    return all(a < b for a, b in zip(times, times[1:]))  # noqa: RUF007


def replay(spark: SparkSession, table: DataFrame, build, mode: str, files: int = 4, ordered: bool = False, seen=None) -> DataFrame:
    """Run a streaming query over all rows of a table, written as `files` Parquet files of ranges of rec_idx and read one file to a trigger, and return its final result.

    The files come in order of their ranges, as a stream takes files by the time of their writing: those written at once get times in that order, and where the
    store doesn't keep these (or with ordered) the files are written one after another. seen: gets the query when it has ended.

    In append mode the stream ends with one row of nulls a year after the last event: its watermark lets all that is still held
    leave; queries leave that row out. The files and the query's checkpoint lie in the folder for checkpoints and go when the
    query has ended; the result is a table written there.
    """
    home = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    ranges = table.repartitionByRange(files, "rec_idx")
    if not ordered:
        ranges.write.parquet(f"{home}/in")
        if not _in_turn(spark, f"{home}/in"):
            remove(spark, f"{home}/in")
            ordered = True
    if ordered:
        ranges.withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(f"{home}/parts")
        for k in range(files):
            spark.read.parquet(f"{home}/parts").where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{home}/in")
        remove(spark, f"{home}/parts")
    if mode == "append":
        written = spark.read.parquet(f"{home}/in")
        end = written.agg((F.max("ts") + F.expr("interval 365 days")).alias("ts")).where("ts is not null")
        end.select(*(F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in written.schema)).coalesce(1).write.mode("append").parquet(f"{home}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
    out = build(stream)

    def keep(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{home}/out/batch={n}")

    # each part of the state is committed at each trigger, whatever it holds: no more parts than keep the cores busy
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    spark.conf.set(setting, min(int(before), 2 * spark.sparkContext.defaultParallelism))
    try:
        q = out.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/state").foreachBatch(keep).trigger(availableNow=True).start()
    finally:
        spark.conf.set(setting, before)
    q.awaitTermination()
    if seen:
        seen(q)
    remove(spark, f"{home}/in")
    remove(spark, f"{home}/state")
    got = spark.read.schema(StructType([*out.schema, StructField("batch", LongType())])).parquet(f"{home}/out")
    if mode == "complete":
        last = got.agg(F.max("batch").alias("last"))
        got = got.where(F.col("batch") == last.scalar())
    return got.drop("batch")
