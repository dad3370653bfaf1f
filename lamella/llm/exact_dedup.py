"""Exact dedup by deterministic block naming (operator 6), in DataFrame functions only.

Texts are cut into fixed-size byte blocks. The distinct blocks are sorted and numbered, so equal blocks share an
integer name. Then adjacent names are paired, the distinct pairs are sorted and numbered again, and so on until
every document is down to one name. ``(level, name)`` is then equal for two documents exactly when their bytes are.

Only one exchange carries text (the distinct blocks, combined map-side). Names travel back to the occurrences by a
64-bit routing hash of the block; blocks that share a hash but differ keep different names, because the hash never
decides equality: such blocks (found by counting names per hash) are matched by their bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.plans.session import checkpointed

BLOCK_BYTES = 2048


def _routing(block: Column) -> Column:
    return F.xxhash64(block)


def block_identities(rows: DataFrame, data: str, block_bytes: int = BLOCK_BYTES, routing=_routing) -> DataFrame:
    """``(row, level, name)`` per row; ``row`` is a struct of every other column of ``rows``.

    A null value counts as empty. Empty values share one identity. An empty table gives an empty result.
    """
    keep = [c for c in rows.columns if c != data]
    based = rows.select(
        F.monotonically_increasing_id().alias("rid"),
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        F.coalesce(F.col(f"`{data}`").cast("binary"), F.lit(b"")).alias("bytes"),
    )
    last = f"greatest(0L, cast(ceil(octet_length(bytes) / {block_bytes}.0) as bigint) - 1)"
    blocks = F.expr(f"transform(sequence(0L, {last}), i -> substring(bytes, cast(i * {block_bytes} + 1 as int), {block_bytes}))")
    occurrences = based.select("rid", "row", F.posexplode(blocks).alias("pos", "block")).withColumn("h", routing(F.col("block")))

    # level 0: sort the distinct blocks of each partition; the row number in it, with the partition's number, is the name
    distinct = occurrences.select("h", "block").distinct()
    names = checkpointed(distinct.sortWithinPartitions("block").select("h", F.monotonically_increasing_id().alias("name")))
    shared = names.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    if shared.isEmpty():
        named = occurrences.select("rid", "row", "pos", "h").join(names, "h")
    else:
        shared = checkpointed(shared)
        twice = occurrences.join(shared, "h", "left_semi")
        own = twice.select("block").distinct().sortWithinPartitions("block").select("block", (-1 - F.monotonically_increasing_id()).alias("name"))
        one = names.join(shared, "h", "left_anti")
        named = occurrences.select("rid", "row", "pos", "h").join(one, "h").select("rid", "row", "pos", "name")
        named = named.unionByName(twice.join(own, "block").select("rid", "row", "pos", "name"))

    def gathered(named: DataFrame) -> DataFrame:
        return named.groupBy("rid").agg(
            F.min_by("row", "pos").alias("row"),
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"),
        )

    level, done = 0, []
    current = checkpointed(gathered(named.select("rid", "row", "pos", "name")))
    longest = current.agg(F.max(F.size("names"))).first()[0] or 1
    while True:
        done.append(current.where(F.size("names") == 1).select("row", F.lit(level).alias("level"), F.col("names")[0].alias("name")))
        if longest <= 1:
            break
        level += 1
        pairs = current.where(F.size("names") > 1).select(
            "rid",
            "row",
            F.posexplode(F.expr("transform(sequence(0, cast(ceil(size(names) / 2.0) as int) - 1), i -> struct(names[2 * i] as a, get(names, 2 * i + 1) as b))")).alias("pos", "pair"),
        ).select("rid", "row", "pos", F.col("pair.a").alias("a"), F.coalesce("pair.b", F.lit(-(2**63) + 1)).alias("b"))
        # stored like level 0, so that both sides of the join are plain exchanges and AQE can split a pair of very many rows
        names = checkpointed(pairs.select("a", "b").distinct().sortWithinPartitions("a", "b").select("a", "b", F.monotonically_increasing_id().alias("name")))
        current = checkpointed(gathered(pairs.join(names, ["a", "b"])))
        longest = -(-longest // 2)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    Of rows with the same bytes the one with the largest key stays, exactly one even if the key repeats. A null key is
    the smallest, so it stays only in a group of null keys (``keep_id`` is null then). Null texts equal empty ones.
    Other columns, whatever their names, are not read.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.sha2(body, 256).alias("sha"), body.alias("bytes"))
    ids = checkpointed(block_identities(rows, "bytes", block_bytes).select("row", "level", "name", F.monotonically_increasing_id().alias("rid")))
    # stored, so that both sides of the join are plain exchanges and AQE can split a text of very many rows
    best = checkpointed(ids.groupBy("level", "name").agg(F.max(F.struct(F.col("row.key").alias("key"), F.col("rid"))).alias("best"), F.count("*").alias("group_size")))
    return ids.join(best, ["level", "name"]).select(
        F.col("row.key").alias(key), F.col("best.key").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), F.col("row.sha").alias("text_sha256")
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops; one row stays of rows equal in id and text."""
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), F.col("doc_id").alias("own"))
    same = rows.join(kept, (F.col("sha") == F.col("digest")) & F.col("own").eqNullSafe(F.col("id")), "left_semi")
    return same.dropDuplicates(["sha", "own"]).select("row.*")
