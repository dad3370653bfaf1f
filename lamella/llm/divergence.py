"""Source divergence audit (operator 11): how far the sources of a language are apart in their terms.

Tasks number and count the terms of a slice of text by length-bucketed packing (:mod:`lamella.llm.terms`); Spark adds up
(lang, source, term) counts. A group's smoothed share of a term it lacks is one number, so a sum over all kept terms of
the divergence of two sources is split: terms of one source against the other's share of an absent term, by how many of
its terms have each count, and a correction for terms that both have. Terms that neither has are never listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.arrow import flat_bytes, sub_batches
from lamella.llm.terms import lowered, numbered, strings
from lamella.plans.session import bounded, checkpointed, forget, saved, small_batches

SLICE = 8 << 20
LEAST_DOCUMENTS, TOP, SCALE, PRIOR = 10, 10, 1_000_000_000, 2


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _count(part: pa.RecordBatch) -> pa.RecordBatch:
    """Occurrences and documents of each (lang, source, term) of a slice."""
    lang, langs = _codes(part.column(0))
    source, sources = _codes(part.column(1))
    group = lang * len(sources) + source
    by_group = np.argsort(group, kind="stable")
    data, offsets = flat_bytes(part.column(2))
    data = lowered(data)
    inside = (data >= 0x80) | (data >= 97) & (data <= 122)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    begin = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    doc = np.searchsorted(offsets, begin, "right") - 1
    rank = np.empty(len(group), np.int64)
    rank[by_group] = np.arange(len(group))
    first = np.argsort(rank[doc], kind="stable")  # terms by group and document, so that each term's run is in that order
    begin, end, doc = begin[first], end[first], doc[first]
    ids, order, _ = numbered(data, begin, end)
    ids, own = ids[order], doc[order]
    new_doc = np.ones(len(order), bool)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = (ids[1:] != ids[:-1]) | (group[own[1:]] != group[own[:-1]])
        new_doc[1:] = new[1:] | (own[1:] != own[:-1])
    at = np.flatnonzero(new)
    stop = np.append(at[1:], len(order))
    seen = np.concatenate(([0], np.cumsum(new_doc)))
    row = order[at]
    columns = [langs.take(pa.array(lang[own[at]])), sources.take(pa.array(source[own[at]])), strings(data, begin[row], end[row]), pa.array(stop - at), pa.array(seen[stop] - seen[at])]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of each term in each group and documents (rows) that have it."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in sub_batches(b, "text", SLICE):
                yield _count(part)

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column | str, total: str, v: str) -> Column:
    """The share as an exact integer; null where the language has no kept term."""
    wide = "decimal(20,0)"
    parts = F.lit(SCALE).cast("decimal(10,0)") * (F.col(n) if isinstance(n, str) else n).cast(wide) + F.lit(SCALE * PRIOR).cast(wide)
    whole = F.col(total).cast(wide) + PRIOR * F.col(v).cast(wide)
    return F.when(F.col(v) > 0, 1 + F.call_function("div", parts, whole))


def _apart(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for every (lang, source) group of ``docs``.

    Part ``pair``: each other source of the language with the sum over its kept terms; part ``term``: the ``top`` terms that
    set the group off from its language. A term is kept that ``least_documents`` rows of its language have; repeated rows
    count each. Null text, lang and source are ''. A group without terms is paired like any other; a language without
    kept terms has values 0 and no terms; an empty table gives no rows. Other columns, whatever their names, aren't read.
    """
    every = saved(term_counts(docs), "terms")
    word = Window.partitionBy("lang", "term")
    kept = every.withColumn("d", F.sum("docs").over(word)).withColumn("all_n", F.sum("n").over(word)).where(F.col("d") >= least_documents)
    kept = saved(kept.withColumn("lead", (F.min("source").over(word) == F.col("source")).cast("long")).select("lang", "source", "term", "n", "all_n", "lead"), "kept-terms")
    forget(every)
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("lead").alias("v"))
    langs = Window.partitionBy("lang")
    groups = groups.join(own, ["lang", "source"], "left").fillna(0, ["total", "v"])
    groups = groups.withColumn("v", F.sum("v").over(langs)).withColumn("all_total", F.sum("total").over(langs))
    groups = bounded(groups.withColumn("zero", _share(F.lit(0), "total", "v")))

    shares = kept.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", "v"))
    best = shares.withColumn("q", _share("all_n", "all_total", "v")).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart("p", "q").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other"))
    counted = shares.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("terms"))
    apart = (F.col("terms") * (_apart("p", "other") - _apart("zero", "other"))).alias("value")
    single = checkpointed(counted.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(apart).alias("value")))
    has = F.array_sort(F.collect_list(F.struct("source", "p", "zero")))
    lists = shares.groupBy("lang", "term").agg(has.alias("has")).where("size(has) > 1")
    pairs = lists.select("lang", F.posexplode("has").alias("i", "a"), "has").select("lang", "a", F.explode(F.expr("slice(has, i + 2, size(has))")).alias("b"))
    more = _apart("a.p", "b.p") - _apart("a.p", "b.zero") - _apart("a.zero", "b.p") + _apart("a.zero", "b.zero")
    both = checkpointed(pairs.groupBy("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item")).agg(F.sum(more).alias("value")))
    base = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", F.coalesce(F.col("v") * _apart("zero", "other"), F.lit(0)).alias("value"))
    swapped = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    total = base
    for df in (single, swapped(single), both, swapped(both)):
        total = total.unionByName(df)
    total = total.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pair = total.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    out = saved(pair.unionByName(terms), "divergence")
    forget(kept)
    return out
