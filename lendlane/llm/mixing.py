"""Mixing sources to target weights: random keys, a range sort per source, prefix sums, an exact cut.

Every source gets a word budget.  Its documents stand in a random but repeatable order, its
whole epochs are taken first, and the last epoch ends at the document nearest to the budget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lendlane.llm.shared import free_names, n_words, quoted, save

# What the sources weigh, in the order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = 3.0, share: float = 1.0) -> DataFrame:
    """``(source, source_size)`` with the ``target`` of each source.

    Sources by code point, NULL last, weigh ``weights``, repeating, and share ``share`` of all
    sizes.  A target stops at ``most`` times its source's size; what is over goes to the other
    sources by weight, until no target is above.  A source of size 0 has target 0.

    Only totals come to the driver, one row a round.  A round caps at least one more source or
    is the last one.
    """
    ranked = _numbered(sizes)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    ranked = save(ranked.select("source", "source_size", weight.alias("_weight"),
                                (F.col("source_size") * F.lit(most)).alias("_most")), "sources")
    whole = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = F.col("_most") <= F.col("_weight") * F.lit(level)
        capped, free = ranked.agg(F.sum(F.when(full, F.col("_most"))), F.sum(F.when(~full, F.col("_weight")))).first()
        if not free:
            break
        new = (whole * share - (capped or 0.0)) / free
        if new <= level:
            break
        level = new
    return ranked.select("source", "source_size", F.least("_most", F.col("_weight") * F.lit(level)).alias("target"))


def _numbered(sizes: DataFrame) -> DataFrame:
    """Number the sources from 1 by code point, NULL last, without a window over all of them.

    Names are numbered inside the group of their first two characters; groups before it are
    added up.  There are at most as many groups as pairs of characters.
    """
    head = F.when(F.col("source").isNotNull(), F.encode(F.substring("source", 1, 2), "UTF-8"))
    named = sizes.withColumn("_head", head)
    groups = named.groupBy("_head").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.orderBy(F.col("_head").asc_nulls_last())
    before = groups.select("_head", (F.sum("_n").over(order) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_head").orderBy(F.encode("source", "UTF-8")))
    return named.withColumn("_inside", inside).join(before, named["_head"].eqNullSafe(before["_head"])).select(
        "source", "source_size", (F.col("_before") + F.col("_inside")).alias("_rank"))


def mixed(
    docs: DataFrame, size: Column, ids: str = "doc_id", source: str = "source",
    weights: Sequence[float] = WEIGHTS, most: float = 3.0, keep: Sequence[str] = (),
) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, epochs, taken``, and the columns in ``keep``.

    ``epochs`` is how often the mix takes the document, ``taken`` the words that makes.  The key
    is the md5 of the id (NULL: of the empty text), ties go by id and size, so reruns agree.
    Whole epochs come first; the last one takes documents in key order as long as the middle
    of the document lies before the budget.  Empty documents are taken with their neighbours.
    Repeated rows are documents of their own.  An empty table gives an empty result.

    Documents are cut into as many key ranges per source as the square root of all documents, so
    that neither the rows of a range nor the ranges of a source are many, whatever a source holds.
    """
    key = F.md5(F.coalesce(F.col(ids).cast("string"), F.lit("")).cast("binary"))
    rows = save(docs.select(F.col(ids).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), key.alias("_key"), *keep), "sizes")
    ranges = max(1, int(rows.count() ** 0.5))
    at = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("_range", F.floor(at * ranges / F.lit(1 << 32)).cast("int"))

    per_range = save(rows.groupBy("source", "_range").agg(F.sum("size").alias("_size")), "ranges")
    targets = save(source_targets(per_range.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, most), "targets")
    earlier = F.sum("_size").over(Window.partitionBy("source").orderBy("_range")) - F.col("_size")
    offsets = per_range.select("source", "_range", earlier.alias("_earlier"))
    known = save(offsets.join(targets, offsets["source"].eqNullSafe(targets["source"]))
                 .select(offsets["source"], "_range", "_earlier", "source_size", "target"), "offsets")

    inside = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_inside", F.sum("size").over(inside) - F.col("size"))
    out = summed.join(known, (summed["_range"] == known["_range"]) & summed["source"].eqNullSafe(known["source"]))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - F.col("_whole") * F.col("source_size")
    start = F.col("_earlier") + F.col("_inside")
    last = F.when((2 * start + F.col("size") <= 2 * rest) & (rest > 0), 1).otherwise(0)
    return out.withColumn("_whole", whole).withColumn("epochs", (F.col("_whole") + last).cast("long")).select(
        "doc_id", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"), *keep)


def mix_documents(docs: DataFrame) -> DataFrame:
    """``mixed`` over words of ``text``."""
    return mixed(docs, n_words("text"))


PORTION = 1000


def repeated(docs: DataFrame, ids: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns, so often that each source has the words the mix takes of it.

    Only ids, text digests and counts are shuffled before the texts are.  Rows of one id and text share the
    copies the mix takes of them all: each gets as many whole ones, and the first of them, by a hash of their columns, one more.
    Rows without an id are taken too.
    """
    text, once, key, copies, number, before, mine = free_names(docs.columns, "_text", "_id", "_key", "_copies", "_number", "_before", "_mine")
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")))
    mix = mixed(docs.select(ids, "source", "text").withColumn("_digest", digest), n_words("text"), ids, keep=("_digest",))
    times = mix.groupBy("doc_id", "_digest").agg(F.sum("epochs").alias(copies), F.count(F.lit(1)).alias(number)).where(F.col(copies) > 0)
    times = save(times.withColumnRenamed("doc_id", once).withColumnRenamed("_digest", key), "times")
    own = docs.withColumn(text, digest).join(times, F.col(ids).eqNullSafe(F.col(once)) & (F.col(text) == F.col(key)))
    columns = quoted(docs.columns)
    single = own.where(F.col(number) == 1).select(*columns, F.col(copies).alias(mine))
    # equal rows are one row with their number; the copies are dealt to these by place
    kinds = own.where(F.col(number) > 1).groupBy(*columns, once, key, copies, number).agg(F.count(F.lit(1)).alias(mine))
    order = Window.partitionBy(once, key).orderBy(F.xxhash64(*columns)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = kinds.withColumn(before, F.sum(mine).over(order) - F.col(mine))
    more = F.least(F.greatest(F.col(copies) % F.col(number) - F.col(before), F.lit(0)), F.col(mine))
    share = F.col(mine) * F.floor(F.col(copies) / F.col(number)) + more
    several = placed.select(*columns, share.alias(mine)).where(F.col(mine) > 0)
    # in two steps, so that very many copies of one row are not made by one task
    portions = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(mine) - 1) / PORTION)))
    cut = several.select(*columns, mine, portions.alias(before)).select(
        *columns, F.least(F.col(mine) - F.col(before) * PORTION, F.lit(PORTION)).alias(mine), F.xxhash64(before).alias(before))
    dealt = cut.repartition(*columns, before).select(*columns, mine)
    return single.unionByName(dealt).select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(mine).cast("long"))).alias(before)).select(*columns)


ORACLE = r"""
with sized as (
 select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
  md5(coalesce(doc_id::varchar, '')) as k from documents),
src as (select source, sum(size)::bigint as source_size, count(*) as n from sized group by source),
ranked as (
 select *, 3.0::double * source_size as most,
  [5.0, 2.0, 1.0][((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1)::int]::double as w from src),
sorted as (
 select *, coalesce(sum(most) over (order by most / w, encode(source) nulls last rows between unbounded preceding and 1 preceding), 0) as full_before,
  sum(w) over (order by most / w, encode(source) nulls last rows between current row and unbounded following) as w_left,
  (select sum(source_size) from src) as whole from ranked),
lvl as (select max((whole - full_before) / w_left) as level from sorted),
goal as (select source, source_size, least(most, w * (select level from lvl)) as target from sorted),
placed as (
 select d.*, g.source_size, g.target, case when g.source_size > 0 then floor(g.target / g.source_size) else 0 end as whole,
  sum(d.size) over (partition by d.source order by k, doc_id, size rows between unbounded preceding and current row) - d.size as start
 from sized d join goal g on d.source is not distinct from g.source)
select doc_id, size, source_size, target,
 (size * (whole + case when target - whole * source_size > 0 and 2 * start + size <= 2 * (target - whole * source_size) then 1 else 0 end))::bigint as taken
from placed"""
