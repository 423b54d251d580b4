"""The change stream: events folded per file, then applied to the catalog in a fixed order, in batch or in a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import merge

EVENT = "volume_id string, seq long, kind string, fid long, path string, new_path string, new_size long"


def coalesce_changes(events: DataFrame) -> DataFrame:
    """At most two events of each volume and fid, folded over its events by seq: volume_id, fid, step, kind, seq, new_size.

    Created then Deleted cancel; Created takes in Modified; Deleted then Created is Modified; Moved then Modified stay
    two; those two then Deleted cancel; in every other case the latest event wins. A Modified between a creation and
    others keeps the creation, so one fold over the ordered events of a file is needed; states are a few fields.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "kind", "new_size")))
    grouped = events.groupBy("volume_id", "fid").agg(ordered.alias("e"))
    none_s, none_l = F.lit(None).cast("string"), F.lit(None).cast("long")

    def state(first, first_seq, first_size, second_seq, second_size):
        return F.struct(
            F.coalesce(first, none_s).alias("kind"), F.coalesce(first_seq, none_l).alias("seq"), F.coalesce(first_size, none_l).alias("size"),
            F.coalesce(second_seq, none_l).alias("seq2"), F.coalesce(second_size, none_l).alias("size2"),
        )

    empty = state(none_s, none_l, none_l, none_l, none_l)

    def step(s, e):
        k, both = e["kind"], s["seq2"].isNotNull()
        latest = state(k, e["seq"], e["new_size"], none_l, none_l)
        return (
            F.when(both & (k == "Modified"), state(s["kind"], s["seq"], s["size"], e["seq"], e["new_size"]))
            .when(both & (k == "Deleted"), empty)
            .when((s["kind"] == "Created") & (k == "Deleted"), empty)
            .when((s["kind"] == "Created") & (k == "Modified"), s)
            .when((s["kind"] == "Deleted") & (k == "Created"), state(F.lit("Modified"), e["seq"], e["new_size"], none_l, none_l))
            .when((s["kind"] == "Moved") & (k == "Modified"), state(s["kind"], s["seq"], s["size"], e["seq"], e["new_size"]))
            .otherwise(latest)
        )

    folded = grouped.select("volume_id", "fid", F.aggregate("e", empty, step).alias("s")).where("s.kind IS NOT NULL")
    steps = F.array(
        F.struct(F.lit(1).alias("step"), F.col("s.kind").alias("kind"), F.col("s.seq").alias("seq"), F.col("s.size").alias("new_size")),
        F.struct(F.lit(2).alias("step"), F.lit("Modified").alias("kind"), F.col("s.seq2").alias("seq"), F.col("s.size2").alias("new_size")),
    )
    return folded.select("volume_id", "fid", F.explode(steps).alias("x")).select("volume_id", "fid", "x.*").where("seq IS NOT NULL")


def apply_changes(state: DataFrame, changes: DataFrame) -> DataFrame:
    """state: volume_id, fid, size, moved. Creations first, then deletions, moves, changes of size, whatever their order."""
    keys = ["volume_id", "fid"]
    of = {k: changes.where(F.col("kind") == k) for k in ("Created", "Deleted", "Moved", "Modified")}
    made = of["Created"].select(*keys, F.col("new_size").alias("c"))
    out = state.join(made, keys, "full").select(*keys, F.coalesce("c", "size").alias("size"), F.coalesce("moved", F.lit(0).cast("long")).alias("moved"))
    out = out.join(of["Deleted"], keys, "left_anti")
    moves = of["Moved"].groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
    out = out.join(moves, keys, "left").select(*keys, "size", (F.col("moved") + F.coalesce("m", F.lit(0))).alias("moved"))
    sizes = merge.last_of_key(of["Modified"].select(*keys, "seq", "new_size"), keys, "seq").select(*keys, "new_size")
    return out.join(sizes, keys, "full").select(*keys, F.coalesce("new_size", "size").alias("size"), F.coalesce("moved", F.lit(0).cast("long")).alias("moved"))


def run_stream(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Starts a query that coalesces each micro-batch (300 ms of events, unless all that is there at once) and hands it to sink.

    The batch id makes a sink idempotent: a batch that is repeated after a failure has the id it had before.
    """
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(coalesce_changes(df), n))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="300 milliseconds")).start()


def pair_moves(events: DataFrame, within_ms: int = 500) -> DataFrame:
    """Halves of moves (cookie, kind from or to, at in ms, path) to Moved, or, if the other half doesn't come in time,
    Deleted (from) and Created (to): cookie, kind, path, new_path."""
    start = events.where("kind = 'from'").select("cookie", F.col("at").alias("a"), "path")
    end = events.where("kind = 'to'").select("cookie", F.col("at").alias("b"), F.col("path").alias("new_path"))
    late = F.col("b").isNull() | F.col("a").isNull() | ~F.col("b").between(F.col("a"), F.col("a") + within_ms)
    both = start.join(end, "cookie", "full").withColumn("late", late)
    halves = F.array(
        F.when(~F.col("late"), F.struct(F.lit("Moved").alias("kind"), F.col("path"), F.col("new_path"))),
        F.when(F.col("late") & F.col("a").isNotNull(), F.struct(F.lit("Deleted").alias("kind"), F.col("path"), F.lit(None).cast("string").alias("new_path"))),
        F.when(F.col("late") & F.col("b").isNotNull(), F.struct(F.lit("Created").alias("kind"), F.lit(None).cast("string").alias("path"), F.col("new_path"))),
    )
    return both.select("cookie", F.explode(F.filter(halves, lambda x: x.isNotNull())).alias("x")).select("cookie", "x.*")
