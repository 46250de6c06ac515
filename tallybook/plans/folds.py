"""Sequential folds: parallel across keys, ordered within one. Rows stream by in sorted partitions, so a key may be larger than memory."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import parse_iso
from ..sources.scratch import written

#: Fixed value: how far ahead of its arrival a report's time may be.
FUTURE_MINUTES = 10
FUTURE = pd.Timedelta(minutes=FUTURE_MINUTES)
START = b"\0" * 32


def streamed(df: DataFrame, key: str, order: list[str], run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run`` over the rows of df, those of a key together and in order."""
    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def hash_chain(lines: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """Per key the chain sha256(chain + raw) over its lines (seq, value) in seq order, and their number.

    ``known`` (key, chain, records) carries chains on from where an earlier run ended.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chain, n, done = None, START, 0, []
        for batch in batches:
            for k, value, old, count in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if n and k != held:
                    done.append((held, chain.hex(), n))
                    n = 0
                if not n:
                    held, chain, n = k, bytes.fromhex(old) if old else START, count or 0
                n += 1
                chain = hashlib.sha256(chain + (value or "").encode()).digest()
            if len(done) > 10_000:
                yield table(done)
                done = []
        if n:
            done.append((held, chain.hex(), n))
        yield table(done)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], [key, "chain", "records"])

    own = lines.select(key, "seq", "value")
    if known is None:
        own = own.withColumn("old", F.lit(None).cast("string")).withColumn("count", F.lit(None).cast("bigint"))
    else:
        own = own.join(known.select(key, F.col("chain").alias("old"), F.col("records").alias("count")), key, "left")
    ordered = own.repartition(key).sortWithinPartitions(key, "seq").select(key, "value", "old", "count")
    found = ordered.mapInArrow(run, f"{key} string, chain string, records bigint")
    return found if known is None else found.unionByName(known.select(key, "chain", "records").join(own.select(key).distinct(), key, "left_anti"))


#: Nodes under one node of a digest tree.
FAN_OUT = 1024


def merkle(rows: DataFrame, keys: list[str], leaf: str, width: int, seq: str = "seq") -> DataFrame:
    """keys, digest: for each key a digest over its rows' leaves (texts) in order of the whole number ``seq``, which binds places and order, however the rows are split.

    Rows whose seq falls into one stretch of ``width`` numbers are a block; digests of blocks are digested in groups of FAN_OUT, these in groups again, and those by
    the key. So no row gathers more than a block's leaves, FAN_OUT digests, or a key's size over width * FAN_OUT ** 2.
    """
    node = lambda at, value: F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(value).alias("of"))))), 256)
    out = rows.select(*keys, F.floor(F.col(seq) / width).alias("__block"), F.col(seq).alias("__seq"), F.col(leaf).alias("__leaf"))
    out = out.groupBy(*keys, "__block").agg(node("__seq", "__leaf").alias("__digest"))
    for _ in range(2):
        out = out.groupBy(*keys, F.floor(F.col("__block") / FAN_OUT).alias("__group")).agg(node("__block", "__digest").alias("__digest")).withColumnRenamed("__group", "__block")
    return out.groupBy(*keys).agg(node("__block", "__digest").alias("digest"))


def merkle_root(leaves: list[tuple[int, str]], width: int) -> str:
    """The digest of ``merkle`` for a single key, of its leaves (seq, text) in order of seq."""

    def level(nodes: list[tuple[int, str]], wide: int) -> list[tuple[int, str]]:
        out = []
        for at, group in itertools.groupby(nodes, lambda x: x[0] // wide):
            text = ",".join([f'{{"at":{a},"of":"{x}"}}' for a, x in group])
            out.append((at, hashlib.sha256(f"[{text}]".encode()).hexdigest()))
        return out

    blocks = level(leaves, width)
    for _ in range(2):
        blocks = level(blocks, FAN_OUT)
    return level(blocks, 1 << 62)[0][1]


#: Lines of a ledger whose digests are gathered in one row.
SNAPSHOT_LINES = 4096


def snapshot_digest(lines: DataFrame, key: str) -> DataFrame:
    """A3: one row with records and a digest of a table of lines (key, seq, value) that depends on the order of each key's: over the keys' digest trees, in order of key. Every key's lines are spread over all cores."""
    roots = merkle(lines.select(key, "seq", F.sha2(F.coalesce("value", F.lit("")), 256).alias("leaf")), [key], "leaf", SNAPSHOT_LINES)
    counts = lines.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("records"))
    ordered = F.array_sort(F.collect_list(F.struct(key, "digest")))
    both = roots.join(counts, F.col(key).eqNullSafe(F.col("__key")))
    return both.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.sha2(F.to_json(ordered), 256).alias("snapshot_sha256"))


def snapshot_chain(lines: DataFrame, key: str) -> DataFrame:
    """A3: one row with records and a digest over the keys' hash chains and numbers of lines, in order of key. A chain depends on all bytes before, so each key's lines stream through one task."""
    ordered = F.array_sort(F.collect_list(F.struct(key, "chain", "records")))
    return hash_chain(lines, key).agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.sha2(F.to_json(ordered), 256).alias("snapshot_sha256"))


def within_budget(items: DataFrame, key: str, budget: int) -> DataFrame:
    """Key, pos, bytes and whether the item is taken: items (pos, bytes) of each key in order while they fit; one that is too large is passed over and later ones may fit."""
    kind = items.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, used, first = None, 0, True
        for batch in batches:
            taken = []
            for k, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if first or k != held:
                    held, used, first = k, 0, False
                taken.append(used + n <= budget)
                used += n if taken[-1] else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(taken, pa.bool_())], [key, "pos", "bytes", "taken"])

    own = items.select(key, F.col("pos").cast("long").alias("pos"), F.col("bytes").cast("long").alias("bytes"))
    return streamed(own, key, ["pos"], run, f"{key} {kind}, pos bigint, bytes bigint, taken boolean")


#: A key with more items than this is packed by several tasks.
HOT_ITEMS = 1 << 20


def packed(items: DataFrame, key: str, limit: int, framed: bool = True) -> DataFrame:
    """Key, pos, request, start: the number of the request that takes an item (pos, bytes) of a key, and the bytes of it before the item.

    A request is a JSON array of at most ``limit`` bytes with its brackets and commas, or, not ``framed``, the items end to end. An
    item too large by itself is an error before anything is sent. A key is one stream through one task; one with more than HOT_ITEMS items is
    cut into blocks for all of them (``packed_in_blocks``).
    """
    frame, comma = (2, 1) if framed else (0, 0)
    own = items.select(key, "pos", F.col("bytes").cast("long").alias("bytes"))
    if own.where(F.col("bytes") + frame > limit).take(1):
        raise ValueError("an item does not fit into a request of its own")
    hot = own.groupBy(F.col(key).alias("__key")).count().where(F.col("count") > HOT_ITEMS).select("__key")
    alone = own.withColumns({"__size": F.lit(-1).cast("long"), "__number": F.lit(0).cast("long"), "__block": F.lit(0)})
    if not hot.take(1):
        return streamed_requests(alone, key, limit, frame, comma)
    same = F.col(key).eqNullSafe(F.col("__key"))
    large = packed_in_blocks(own.join(hot, same, "left_semi"), key, limit, frame, comma)
    return streamed_requests(alone.join(hot, same, "left_anti"), key, limit, frame, comma).unionByName(large)


def streamed_requests(rows: DataFrame, key: str, limit: int, frame: int, comma: int, by: str | None = None) -> DataFrame:
    """The requests of rows (key, pos, bytes, __block, and the open request that a key's items in a block find: its __size, -1 if there is none, and __number), those of a key and block together and in order."""
    kind, place = rows.schema[key].dataType.simpleString(), rows.schema["pos"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, size, some = (), 0, frame, False
        for batch in batches:
            requests, starts = [], []
            for k, n, block, open_size, open_number in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                if (k, block) != held:
                    held, number, size, some = (k, block), open_number, max(open_size, frame), open_size >= 0
                if size + n + comma * some > limit:
                    number, size, some = number + 1, frame, False
                size += comma * some
                requests.append(number)
                starts.append(size)
                size, some = size + n, True
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(requests, pa.int64()), pa.array(starts, pa.int64())], [key, "pos", "request", "start"])

    ordered = rows.repartition(by or key).sortWithinPartitions("__block", key, "pos").select(key, "pos", "bytes", "__block", "__size", "__number")
    return ordered.mapInArrow(run, f"{key} {kind}, pos {place}, request bigint, start bigint")


def packed_in_blocks(rows: DataFrame, key: str, limit: int, frame: int, comma: int) -> DataFrame:
    """``packed`` for keys of any size: rows are dealt to blocks in order, and each block tells for every place at which a first request of its own can start how its last one ends.

    Where the first request starts depends on the one that is open when the block begins, and only the first items of a block come into question. So these tables, a row for each block and
    key, chain the blocks of a key; then each block is packed for itself, from the request that it finds open.
    """
    kind = rows.schema[key].dataType.simpleString()
    blocks = written(rows.repartitionByRange(key, "pos").sortWithinPartitions(key, "pos").withColumn("__block", F.spark_partition_id()))

    def told(block: int, name, sizes: list[int]) -> tuple:
        ends = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + comma)])  # of the first items, each with its comma
        m = len(sizes)
        following = np.searchsorted(ends, ends[:m] + (limit - frame + comma), "right") - 1  # where the next request starts after one that starts at an item
        known: dict[int, tuple[int, int]] = {}

        def ending(start: int) -> tuple[int, int]:
            """(size of the last request, requests) if one starts at this item."""
            path = []
            while start not in known:
                path.append(start)
                if following[start] == m:
                    known[start] = int(frame + ends[m] - ends[start] - comma), 1
                else:
                    start = int(following[start])
            for s in reversed(path):
                if s not in known:
                    size, n = known[int(following[s])]
                    known[s] = size, n + 1
            return known[path[0]] if path else known[start]

        first = min(int(np.searchsorted(ends, limit - frame, "right")), m)  # items that can still join an open request
        found = [ending(k) for k in range(min(first + 1, m))]
        return name, block, m, ends[: first + 1].tolist(), [s for s, _ in found], [n for _, n in found]

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes, out = None, [], []
        for batch in batches:
            for name, block, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if held is not None and held != (name, block):
                    out.append(told(held[1], held[0], sizes))
                    sizes = []
                held = name, block
                sizes.append(n)
        if held is not None:
            out.append(told(held[1], held[0], sizes))
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((arrow_kind, pa.int32(), pa.int64(), longs, longs, longs))], [key, "block", "m", "ends", "sizes", "counts"])

    def chained(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        out, size, number = [], -1, 0
        for r in rows:
            out.append((r[key], r["block"], size, number))
            # how many items join the open request
            k = 0 if size < 0 else int(np.searchsorted(r["ends"], limit - size, "right")) - 1
            if size >= 0 and k >= r["m"]:
                size += r["ends"][r["m"]]
            else:
                number += r["counts"][k] - (size < 0)
                size = r["sizes"][k]
        return pa.Table.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((arrow_kind, pa.int32(), pa.int64(), pa.int64()))], ["__key", "__at", "__size", "__number"])

    arrow_kind = rows.select(key).limit(0).toArrow().schema.field(0).type
    ordered = blocks.repartition("__block").sortWithinPartitions("__block", key, "pos").select(key, "__block", "bytes")
    found = ordered.mapInArrow(tables, f"{key} {kind}, block int, m bigint, ends array<bigint>, sizes array<bigint>, counts array<bigint>")
    entries = written(found.groupBy(key).applyInArrow(chained, f"__key {kind}, __at int, __size bigint, __number bigint"))
    placed = blocks.join(entries, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__block") == F.col("__at")))
    return streamed_requests(placed, key, limit, frame, comma, "__block")


def walk(df: DataFrame, text: str, keep: list[str], texts: Callable[[str], bool] | None = None, values: Callable[[str | None, str], bool] | None = None) -> DataFrame:
    """Keep, path, key, kind, value of every member and element below the JSON in ``text``, at any depth; null keys in arrays, values as JSON.

    Text that is no JSON has no rows; of equal keys the last counts. With ``texts`` only the texts that it accepts are taken apart, with ``values`` only the rows whose key and
    value it accepts come out.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    kinds = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part, rows, origin = batch.slice(start, 256), [], []
                for i, line in enumerate(part.column(len(keep)).to_pylist()):
                    if texts and not texts(line or ""):
                        continue
                    try:
                        todo = [("$", json.loads(line or ""))]
                    except ValueError:
                        continue
                    while todo:
                        path, value = todo.pop()
                        below = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
                        for k, x in below:
                            at = f"{path}[{k}]" if isinstance(value, list) else f"{path}.{k}"
                            row = at, None if isinstance(value, list) else k, kinds[type(x)], json.dumps(x, ensure_ascii=False)
                            if not values or values(row[1], row[3]):
                                rows.append(row)
                                origin.append(i)
                            if isinstance(x, (dict, list)):
                                todo.append((at, x))
                columns = list(zip(*rows)) if rows else [[]] * 4
                at = pa.array(origin, pa.int32())
                yield pa.RecordBatch.from_arrays([*[part.column(i).take(at) for i in range(len(keep))], *[pa.array(c, pa.string()) for c in columns]], [*keep, "path", "key", "kind", "value"])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{fields}, path string, key string, kind string, value string")


def step(stored: dict | None, status: str, generated_at: pd.Timestamp | None, received_at: pd.Timestamp) -> dict | None:
    """The state after a report, or None to keep the stored one."""
    readable = stored is not None
    known = stored["generated_at"] if readable else None
    if status == "MISSING":
        return None if readable else {"status": "MISSING", "generated_at": received_at, "sanitized": False}
    if generated_at is None or generated_at > received_at + FUTURE:
        return None if known is not None else {"status": "FAIL", "generated_at": received_at, "sanitized": True}
    if known is not None and generated_at <= known:
        return None
    return {"status": status, "generated_at": generated_at, "sanitized": False}


def reported_states(reports: DataFrame) -> DataFrame:
    """Last state of each repo from reports (repo, seq, status, generated_at text, received_at) in arrival order, as a sum that can be taken in any grouping.

    The table of ``step`` comes to this: the first report makes a state, with the time it names if it can be used, else that of its arrival; from then on only a usable
    report with a later time replaces it. So two summaries of stretches of reports merge: the earlier first one, and of the usable ones that with the greatest time, of
    equal times the earlier. One repo's reports are summed up where they lie, then those sums.
    """
    generated, arrived = parse_iso(F.col("generated_at")), F.col("received_at")
    own = reports.select("repo", "seq", "status", generated.alias("generated"), arrived.alias("arrived"))
    missing = F.col("status").eqNullSafe("MISSING")
    usable = ~missing & F.coalesce(F.col("generated") <= F.col("arrived") + F.make_dt_interval(mins=F.lit(FUTURE_MINUTES)), F.lit(False))
    as_first = F.struct(
        F.when(missing, "MISSING").when(usable, F.col("status")).otherwise("FAIL").alias("status"), F.when(usable, F.col("generated")).otherwise(F.col("arrived")).alias("generated_at"), (~missing & ~usable).alias("sanitized")
    )
    found = own.groupBy("repo").agg(F.min_by(as_first, "seq").alias("first"), F.max_by(as_first, F.when(usable, F.struct("generated", (-F.col("seq")).alias("order")))).alias("best"))
    later = F.coalesce(F.col("best.generated_at") > F.col("first.generated_at"), F.lit(False))
    return found.select("repo", F.when(later, F.col("best")).otherwise(F.col("first")).alias("s")).select("repo", "s.*")
