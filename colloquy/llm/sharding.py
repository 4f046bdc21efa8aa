"""Sharding by a k-d tree over metadata.

A node that is to make n shards is split along the dimension in which its rows spread widest, as a share of the whole
table's spread, at the weighted quantile that leaves n // 2 shards' bytes on the left. For all nodes of a level at once,
bytes are counted in equal bins of the dimension, and again within the bin that holds the quantile, until no more than
``SORTED`` rows are left there, which are put in order. Rows that share a value are told apart by what comes next: the
whole string's hash, the doc_id, the text's checksum, and last a number that each row has for itself. So a value that
fills a third of the table, or copies of one row, don't make a shard uneven.

Everything is a DataFrame expression. A level's nodes, their search and their splits are tables, joined to the rows by
node: broadcast while they are few, and shuffled when they are so many that none has a large share of the rows. Each level's
rows, a few numbers without texts, are written, so plans don't grow with the tree, and nothing of it comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, stored

BINS = 1024
#: Rows in a node's search below which they are put in order, by one task at most.
SORTED = 2_000
#: Nodes of a level, or rows of offsets, up to which their table is broadcast.
FEW = 10_000
#: Slots of a shard are counted in parts of about so many rows, and in PARTS at least.
PART_ROWS, PARTS = 1_000_000, 64
#: Bytes of a string that order it along its dimension; strings that agree in these are told apart by a hash.
LEAD = 6
#: Numbers that order rows along a dimension.
DEPTH = 5


def _number(c: Column) -> Column:
    """A string's first bytes as a number, in byte order; null before all."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, LEAD)), 2 * LEAD, "0"), 16, 10).cast("bigint"), F.lit(-1))


def _along(dim: str) -> list[str]:
    ties = ["id", "text_crc32", "row"]
    return [dim, "h" + dim[1:], *ties] if dim in ("d_source", "d_lang") else [dim, *ties]


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, id, size, text_crc32, row, dimensions): what splitting needs of a row. A missing doc_id comes before all others."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    dims = {"d_size": size, "d_doc": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1))}
    for name in ("source", "lang"):
        if name in docs.columns:
            dims[f"d_{name}"] = _number(F.col(name).cast("string"))
            dims[f"h_{name}"] = F.shiftrightunsigned(F.xxhash64(name), 16)
    own = F.monotonically_increasing_id().alias("row")
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)).alias("id"), size.alias("size"), crc.alias("text_crc32"), own, *[c.alias(k) for k, c in dims.items()])


def _key(dims: list[str]) -> Column:
    """What orders a row along its node's dimension."""
    out = F.lit(None).cast("array<bigint>")
    for d in dims:
        columns = [F.col(c).cast("bigint") for c in _along(d)]
        out = F.when(F.col("dim") == d, F.array(*columns, *[F.lit(0).cast("bigint")] * (DEPTH - len(columns)))).otherwise(out)
    return out


def _with(rows: DataFrame, nodes: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(nodes) if few else nodes.hint("shuffle_merge"), "node")


def _inside() -> Column:
    """Whether a row is in the range that its node's search has come to."""
    at = F.get("key", F.col("depth"))
    return ((F.col("depth") == 0) | (F.slice("key", 1, F.greatest("depth", F.lit(1))) == F.col("found"))) & at.between(F.col("low"), F.col("high"))


def _narrowed(rows: DataFrame, search: DataFrame, dims: list[str], few: bool) -> DataFrame:
    """The search of each node, within the bin that holds its quantile; one value found goes on to the next number."""
    width = F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low") + 1) / BINS)).cast("bigint")
    some = _with(rows, search.withColumn("width", width), few).withColumn("key", _key(dims)).where(_inside())
    binned = some.select("node", "size", "key", "depth", F.expr("(key[depth] - low) div width").alias("bin"))
    following = F.get("key", F.col("depth") + 1)
    counted = binned.groupBy("node", "bin").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"), F.min(following).alias("next_low"), F.max(following).alias("next_high"))
    line = Window.partitionBy("node").orderBy("bin")  # at most BINS rows
    upto = counted.withColumn("upto", F.sum("s").over(line)).withColumn("last", F.lead("bin").over(line).isNull())
    both = upto.join(search.withColumn("width", width).drop("n").hint("shuffle_merge"), "node").where((F.col("below") + F.col("upto") >= F.col("target")) | F.col("last"))
    first = Window.partitionBy("node").orderBy("bin")
    held = both.withColumn("k", F.row_number().over(first)).where("k = 1")
    low, high = F.col("low") + F.col("bin") * F.col("width"), F.least(F.col("high"), F.col("low") + (F.col("bin") + 1) * F.col("width") - 1)
    one = low == high
    return held.select(
        *[c for c in search.columns if c not in ("found", "depth", "low", "high", "below", "n")],
        F.when(one, F.concat("found", F.array(low))).otherwise(F.col("found")).alias("found"),
        F.when(one, F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"),
        F.when(one, F.col("next_low")).otherwise(low).alias("low"),
        F.when(one, F.col("next_high")).otherwise(high).alias("high"),
        (F.col("below") + F.col("upto") - F.col("s")).alias("below"),
        "n",
    )


def _cuts(rows: DataFrame, search: DataFrame, dims: list[str], few: bool) -> DataFrame:
    """(node, half, dim, cut, own): rows up to cut go left, and the row at cut does if own: the side that it leaves more even."""
    done = []
    while True:
        search = durable(search)
        done.append(search.where(F.col("n") <= SORTED))
        search = search.where(F.col("n") > SORTED)
        if not search.limit(1).count():
            break
        search = _narrowed(rows, search, dims, few)
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    some = _with(rows, found, few).withColumn("key", _key(dims)).where(_inside()).select("node", "half", "dim", "key", "size", "below", "target")
    line = Window.partitionBy("node").orderBy("key")  # at most SORTED rows, which differ in their last number
    upto = some.withColumn("upto", F.col("below") + F.sum("size").over(line)).withColumn("last", F.lead("size").over(line).isNull())
    held = upto.where((F.col("upto") >= F.col("target")) | F.col("last")).withColumn("k", F.row_number().over(line)).where("k = 1")
    return held.select("node", "half", "dim", F.col("key").alias("cut"), (F.col("upto") - F.col("size") / 2 <= F.col("target")).alias("own"))


def _split(rows: DataFrame, nodes: DataFrame, dims: list[str], spread: dict[str, int], few: bool) -> DataFrame:
    """rows after one level: a node that makes several shards becomes two, named by the first shard of each."""
    ranges = [f(c).alias(f"{k}_{c}") for c in dims for k, f in (("low", F.min), ("high", F.max))]
    active = nodes.where("shards > 1")
    stats = durable(rows.groupBy("node").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("n"), *ranges).join(active.hint("shuffle_merge"), "node"))
    widths = [F.struct(((F.col(f"high_{d}") - F.col(f"low_{d}")) / spread[d]).alias("width"), F.lit(d).alias("dim"), F.col(f"low_{d}").alias("low"), F.col(f"high_{d}").alias("high")) for d in dims]
    half = F.expr("cast(shards div 2 as int)")
    widest = F.greatest(*widths) if len(widths) > 1 else widths[0]
    begin = stats.withColumn("w", widest).select("node", half.alias("half"), (F.col("weight") * half / F.col("shards")).alias("target"), "w.dim", F.array().cast("array<bigint>").alias("found"), F.lit(0).alias("depth"), "w.low", "w.high", F.lit(0).cast("bigint").alias("below"), "n")
    cuts = durable(_cuts(rows, begin, dims, few))
    both = rows.join(F.broadcast(cuts) if few else cuts.hint("shuffle_merge"), "node", "left").withColumn("key", _key(dims))
    left = (F.col("key") < F.col("cut")) | ((F.col("key") == F.col("cut")) & F.col("own"))
    node = F.when(F.col("cut").isNull() | left, F.col("node")).otherwise(F.col("node") + F.col("half"))
    return stored(both.withColumn("node", node.cast("int")).select(*rows.columns), "level")


def shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): shards of nearly equal bytes.

    Give the number of shards, or the bytes that a shard should reach. Size is the text's UTF-8 bytes (null: none) plus
    1. Shards differ by no more than a few of the largest rows, whatever rows agree in: repeated rows and rows without a
    doc_id are told apart by a number of their own. Slots number a shard's rows from 0 without a gap. An empty table
    gives an empty one. Only doc_id, text, source and lang are read, the last two where there are any.
    """
    base = durable(measured(docs))
    dims = [c for c in base.columns if c.startswith("d_")]
    ranges = [f(c).alias(f"{k}_{c}") for c in dims for k, f in (("low", F.min), ("high", F.max))]
    whole = base.agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("rows"), *ranges).first()
    total = whole["weight"] or 0
    wanted = n_shards or max(1, round(total / target_bytes))
    spread = {c: max(1, (whole[f"high_{c}"] or 0) - (whole[f"low_{c}"] or 0)) for c in dims}
    rows = base.withColumn("node", F.lit(0))
    nodes = base.sparkSession.range(1).select(F.lit(0).alias("node"), F.lit(wanted).alias("shards"))
    made = 1
    while total and made < wanted:
        rows = _split(rows, nodes, dims, spread, made <= FEW)
        half = "cast(shards div 2 as int)"
        nodes = durable(nodes.selectExpr(f"inline(if(shards > 1, array(struct(node, {half} as shards), struct(node + {half} as node, shards - {half} as shards)), array(struct(node, shards))))"))
        made *= 2
    parts = max(PARTS, -(-whole["rows"] // (wanted * PART_ROWS)))
    placed = durable(rows.select("doc_id", "id", "size", "text_crc32", F.col("node").alias("shard"), F.pmod("row", F.lit(parts)).cast("int").alias("part")))
    counts = placed.groupBy("shard", "part").count()  # at most shards * PARTS rows, or a row for each PART_ROWS
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    offsets = F.broadcast(offsets) if wanted * parts <= FEW else durable(offsets).hint("shuffle_merge")
    slot = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "text_crc32")) - 1
    return placed.withColumn("slot", slot).join(offsets, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("offset")).cast("bigint").alias("slot"))
