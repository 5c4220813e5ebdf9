"""Sharding by extendible hashing, in DataFrame operations only.

A directory is indexed by the first bits of a row's hash. A bucket whose rows exceed the byte limit splits on one more
bit, others stay, until every shard fits. Bytes are summed once per directory cell (all cells share the global depth,
some bits beyond the expected need), sums of all shallower prefixes follow from the cells, and a shard is a prefix that
fits while its parent doesn't. Cells that overflow at the global depth split on over all bits of their rows' hashes
alone. Rows that no bit tells apart (equal id and text) fill overflow pages of the last bucket, by their count, without
being gathered; a single row above the limit has a shard of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlens.llm.shared import free_name
from answerlens.storage import materialise

BITS, SPARE_BITS = 60, 4
LIMIT_BYTES = 1 << 20
FEW_HASHES = 100_000  # of cells that overflow: so many are broadcast, more are joined by shuffle


def row_hash(doc_id: str, text: str) -> Column:
    """60 bits of a digest of id and text."""
    inner = F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit(""))))
    return F.conv(F.substring(F.md5(inner), 1, 15), 16, 10).cast("long")


def prefixes(cells: DataFrame, width: int, low: int) -> DataFrame:
    """(d, p, bytes, rows) for all prefixes of low to width bits of the cells (cell, bytes, rows) of `width` bits."""
    levels = cells.select(F.explode(F.sequence(F.lit(low), F.lit(width))).alias("d"), "cell", "bytes", "rows")
    p = F.expr(f"shiftright(cell, {width} - d)").alias("p")
    return levels.select("d", p, "bytes", "rows").groupBy("d", "p").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))


def buckets(sums: DataFrame, limit: int, low: int) -> DataFrame:
    """(d, p, bytes, rows) of the prefixes that fit while their parents don't."""
    fits = sums.filter(F.col("bytes") <= limit)
    full = sums.filter(F.col("bytes") > limit).select((F.col("d") + 1).alias("d"), F.col("p").alias("parent"))
    return fits.filter(F.col("d") == low).unionByName(fits.withColumn("parent", F.expr("shiftright(p, 1)")).join(full, ["d", "parent"], "left_semi").select("d", "p", "bytes", "rows"))


def shard(df: DataFrame, limit_bytes: int = LIMIT_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: its columns, then row_bytes, shard, shard_depth, shard_bytes, shard_rows (names that are
    taken get underscores).

    row_bytes: UTF-8 bytes of the text (null: 0). shard: the hash bits of its bucket as text (empty: the only bucket),
    with +page behind where rows that can't be told apart overflow. Null ids and texts hash like empty ones. shard_bytes
    is at most the limit, but for a shard of one row. Repeated rows are all kept; for them all columns must be comparable.
    An empty table has no shards.
    """
    taken = list(df.columns)
    own: list[str] = []
    for wanted in ("row_bytes", "shard", "shard_depth", "shard_bytes", "shard_rows", "h", "cell", "page", "copies"):
        own.append(free_name(wanted, taken + own))
    size, name, depth, shard_bytes, shard_rows, h, cell, page, copies = own
    rows = df.withColumns({size: F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), h: row_hash(doc_id, text)})
    keys = materialise(rows.groupBy(F.col(h).alias("h")).agg(F.sum(size).alias("bytes"), F.count("*").alias("rows")), "shard-keys")
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    width = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit_bytes)))) + SPARE_BITS)

    at_width = F.expr(f"shiftright(h, {BITS - width})")
    cells = keys.groupBy(at_width.alias("cell")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    shallow = buckets(prefixes(cells, width, 0), limit_bytes, 0)
    spread = F.expr(f"explode(sequence(shiftleft(p, {width} - d), shiftleft(p + 1, {width} - d) - 1))")
    directory = shallow.select(spread.alias(cell), *_named(name, depth, shard_bytes, shard_rows))
    # Only the directory's own cells are spread, 2**width of them at most.

    over = cells.filter(F.col("bytes") > limit_bytes).select("cell")
    deep_keys = keys.join(over, at_width == over.cell, "left_semi")
    levels = deep_keys.select(F.col("h").alias("cell"), "bytes", "rows")
    deep = buckets(prefixes(levels, BITS, width), limit_bytes, width)
    found = levels.select(F.col("cell").alias("h"), F.explode(F.sequence(F.lit(width), F.lit(BITS))).alias("d")).withColumn("p", F.expr(f"shiftright(h, {BITS} - d)")).join(deep, ["d", "p"])
    single = levels.filter(F.col("bytes") > limit_bytes).select(F.col("cell").alias("h"), F.lit(BITS).alias("d"), F.col("cell").alias("p"), "bytes", "rows")
    of_hash = found.select("h", "d", "p", "bytes", "rows").unionByName(single)
    deep_map = materialise(of_hash.select(F.col("h").alias(h), *_named(name, depth, shard_bytes, shard_rows)), "shard-deep")

    keep = [*taken, size, h]
    plain = rows.withColumn(cell, F.expr(f"shiftright(`{h}`, {BITS - width})")).join(directory, cell).select(*keep, name, depth, shard_bytes, shard_rows)
    out = [*taken, size, name, depth, shard_bytes, shard_rows]
    hashes = deep_map.count()
    if not hashes:  # no cell overflows
        return plain.select(*out)
    split = rows.join(F.broadcast(deep_map) if hashes <= FEW_HASHES else deep_map, h).select(*keep, name, depth, shard_bytes, shard_rows)
    pages = (F.col(shard_bytes) > limit_bytes) & (F.col(shard_rows) > 1)
    each = F.greatest(F.lit(1), F.floor(F.lit(limit_bytes) / F.greatest(F.lit(1), F.col(size)))).cast("long")
    left = F.least(each, F.col(copies) - F.col(page) * each)
    paged = (
        split.filter(pages).groupBy(*keep, name, depth).agg(F.count("*").alias(copies))
        .withColumn(page, F.explode(F.sequence(F.lit(0), F.floor((F.col(copies) - 1) / each).cast("long"))))
        .withColumns({name: F.concat(name, F.lit("+"), F.col(page).cast("string")), shard_rows: left, shard_bytes: left * F.col(size)})
        .withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(shard_rows))))
    )
    return plain.select(*out).unionByName(split.filter(~pages).select(*out)).unionByName(paged.select(*out))


def _named(name: str, depth: str, shard_bytes: str, shard_rows: str) -> list[Column]:
    bits = F.expr("lpad(conv(cast(p AS string), 10, 2), d, '0')")
    return [bits.alias(name), F.col("d").alias(depth), F.col("bytes").alias(shard_bytes), F.col("rows").alias(shard_rows)]
