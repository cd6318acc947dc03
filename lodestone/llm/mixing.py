"""Mixing sources to target weights, with DataFrame functions only.

The words of a source, laid end to end, are packed into blocks of `block` words. The mix is a row of slots, as many as
the words fill blocks; any run of slots is an output shard. Each slot draws its source by a hash, so that a
shard's source counts are a multinomial draw; slots that a source draws beyond its quota settle the other sources'
shortfalls, so that totals meet the targets. A source's t-th slot takes block perm(t mod n) of its n blocks, where perm
is a pseudorandom permutation of block numbers that differs from pass to pass, and slots join blocks by
(source, index). Each pass takes every block once, so no document is taken more often than there are passes.

Prefix sums run in bounded groups (documents are dealt by a hash of id, size and text, slots by runs of `_RUN`), whose own
sums are added in two levels, so that a hot source is never one task.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; repeated rows and null ids
count row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import WORD, checkpoint, row_of

#: Weights of the sources by their order, repeating, and the most a target may be of its source's size.
WEIGHTS, MOST = (5, 2, 1), 3
_ROUNDS = 8
#: Rows made from one row by one explode(), rows of a chunk on average, slots of a run, and groups whose sums are added at
#: once.
_PART, _CHUNK_ROWS, _RUN, _FAN = 65_536, 512, 256, 4096
#: Sources that are looked up in a literal of so many cells; more are joined.
_LISTED, _CELLS = 4096, 1024


def word_count(text: Column) -> Column:
    """Number of words: runs of anything but ASCII white space."""
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, sid, target) from (source, source_size): shares by weight of the sum of all sizes; targets
    stop at `most` times their source's size and the excess is reshared by weight until none is above.

    So target = min(most * size, weight * level). Sources with the smallest ratio of size to weight stop first: with the
    first j stopped the level is what the others share, and the right level is the largest that stops no other source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = sizes.withColumn("sid", F.row_number().over(order) - 1)
    w = w.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")))
    stopped = F.coalesce(most * F.sum("source_size").over(before), F.lit(0))
    others = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    w = w.withColumn("level", (F.sum("source_size").over(everything) - stopped) / others)
    w = w.withColumn("level", F.max(F.when(F.col("weight") * F.col("level") <= most * F.col("source_size"), F.col("level"))).over(everything))
    target = F.least((most * F.col("source_size")).cast("double"), F.col("weight") * F.col("level"))
    return w.select("source", "source_size", "sid", F.coalesce(target, (most * F.col("source_size")).cast("double")).alias("target"))


def _permuted(x: Column, n: Column, *key: Column) -> Column:
    """A keyed pseudorandom permutation of 0..n-1 at x: rounds that swap x with (k - x) mod n or not, by a hash that
    both share."""

    def turn(y: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, F.lit("k"), *key), n) - y, n)
        return F.when(F.xxhash64(r, F.greatest(y, other), *key) % 2 == 0, other).otherwise(y)

    return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), x, turn)


def _ahead(groups: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """`groups` with the sum `name` of `value` over the rows of the same `key` (null equals null) that come before in
    `order`, a number that is unique there; added within runs of `_FAN` and over the runs, so that neither is large."""
    some = groups.withColumn("_run", F.floor(F.col(order) / _FAN))
    runs = some.groupBy(key, "_run").agg(F.sum(value).alias("_sum"))
    runs = runs.select(F.col(key).alias("_key"), F.col("_run").alias("_of"), F.coalesce(F.sum("_sum").over(_before(Window.partitionBy(key).orderBy("_run"))), F.lit(0)).alias("_base"))
    within = F.coalesce(F.sum(value).over(_before(Window.partitionBy(key, "_run").orderBy(order))), F.lit(0))
    return some.join(runs, some[key].eqNullSafe(F.col("_key")) & (F.col("_run") == F.col("_of"))).withColumn(name, F.col("_base") + within).drop("_run", "_of", "_key", "_base")


def _counted(n: Column, key: str) -> tuple[Column, Column]:
    """Two steps of explode() that number n rows, in parts of bounded size."""
    part = F.sequence(F.lit(0), F.ceil(n / F.lit(_PART)).cast("long") - 1)
    within = F.sequence(F.col(key) * _PART, F.least(n, (F.col(key) + 1) * _PART) - 1)
    return part, within


def _number(rows: DataFrame, n: str, name: str) -> DataFrame:
    """Each row of `rows` as often as column `n` says, with a running number `name` from 0.

    The planner takes the result for as small as `rows`; joins with it ask for a merge, so that it is not broadcast.
    """
    part, within = _counted(F.col(n), "_part")
    some = rows.where(F.col(n) > 0).select("*", F.explode(part).alias("_part")).repartition("sid", "_part")
    return some.select("*", F.explode(within).alias(name)).drop("_part")


def _before(w) -> object:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _sizes(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(text).alias("size"), F.xxhash64(text).alias("digest"))


def _chunk(chunks: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "size", "digest"), F.lit(chunks)).cast("int")


def _placed(rows: DataFrame, chunks: int) -> DataFrame:
    """Rows (doc_id, source, size, digest, ...) with their chunk, their number in it and the words before them in it.

    Rows that are equal in all of these have the same text, so that their order does not matter.
    """
    rows = rows.withColumn("chunk", _chunk(chunks))
    w = Window.partitionBy("source", "chunk").orderBy(F.col("doc_id").asc_nulls_last(), "size", "digest")
    return rows.withColumn("nth", F.row_number().over(w)).withColumn("before", F.coalesce(F.sum("size").over(_before(w)), F.lit(0)))


def _drawn(plan: DataFrame, total: int, seed: int) -> DataFrame:
    """(slot, sid, blocks, quota): every slot with the source whose part of 0..total-1 a hash of the slot falls into."""
    by_sid = Window.orderBy("sid")
    starts = plan.withColumn("from", F.coalesce(F.sum("quota").over(_before(by_sid)), F.lit(0))).where("quota > 0")
    slots = plan.sparkSession.range(total).select(F.col("id").alias("slot"), F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(total)).alias("at"))
    if plan.count() > _LISTED:
        wheel = _number(starts, "quota", "i").select((F.col("from") + F.col("i")).alias("at"), "sid", "blocks", "quota")
        return slots.join(wheel.hint("merge"), "at").drop("at")
    known = starts.orderBy("sid").collect()  # `_LISTED` rows at most
    ends, width = [r["from"] + r["quota"] for r in known], -(-total // _CELLS)
    first = [next(i for i, e in enumerate(ends) if e > min(c * width, total - 1)) for c in range(_CELLS)]
    # The sources that begin before the end of a cell and end after its start; the last of them that begins at or before.
    here = [[i for i in range(first[c], len(known)) if known[i]["from"] < (c + 1) * width] or [first[c]] for c in range(_CELLS)]
    cells = "array(" + ", ".join("array(" + ", ".join(f"struct({known[i]['from']}L, {known[i]['sid']}, {known[i]['blocks']}L, {known[i]['quota']}L)" for i in some) + ")" for some in here) + ")"
    table = plan.sparkSession.sql(f"SELECT CAST({cells} AS ARRAY<ARRAY<STRUCT<start: BIGINT, sid: INT, blocks: BIGINT, quota: BIGINT>>>) AS cells")
    found = F.array_max(F.filter(F.element_at("cells", F.floor(F.col("at") / width).cast("int") + 1), lambda s: s["start"] <= F.col("at")))
    return slots.crossJoin(F.broadcast(table)).select("slot", found.alias("s")).select("slot", "s.sid", "s.blocks", "s.quota")


def _slots(plan: DataFrame, total: int, seed: int) -> DataFrame:
    """(sid, blocks, t) for every slot of the mix; t numbers a source's slots from 0 to its quota, in order of the slots."""
    by_sid = Window.orderBy("sid")
    drawn = _drawn(plan, total, seed).withColumn("run", F.floor(F.col("slot") / _RUN))
    drawn = checkpoint(drawn)
    counts = checkpoint(drawn.groupBy("run", "sid").agg(F.count("*").alias("n")))
    ahead = _ahead(counts, "sid", "run", "n", "ahead").drop("n")
    in_run = Window.partitionBy("run", "sid").orderBy("slot")
    ranked = drawn.withColumn("k", F.row_number().over(in_run) - 1).join(ahead.hint("merge"), ["run", "sid"]).withColumn("t", F.col("ahead") + F.col("k"))
    got = plan.join(counts.groupBy("sid").agg(F.sum("n").alias("got")), "sid", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    got = got.withColumn("over", F.greatest(F.col("got") - F.col("quota"), F.lit(0))).withColumn("short", F.greatest(F.col("quota") - F.col("got"), F.lit(0)))
    got = got.withColumn("over_before", F.coalesce(F.sum("over").over(_before(by_sid)), F.lit(0))).withColumn("short_before", F.coalesce(F.sum("short").over(_before(by_sid)), F.lit(0)))
    spare = ranked.where("t >= quota").join(got.select("sid", "over_before"), "sid").select((F.col("over_before") + F.col("t") - F.col("quota")).alias("e"))
    wanted = _number(got, "short", "i").select((F.col("short_before") + F.col("i")).alias("e"), "sid", "blocks", (F.col("got") + F.col("i")).alias("t"))
    return ranked.where("t < quota").select("sid", "blocks", "t").unionByName(spare.join(wanted.hint("merge"), "e").drop("e"))


def plan_blocks(docs: DataFrame, block: int = 32, seed: int = 20) -> tuple[DataFrame, DataFrame, int]:
    """What the mix takes: (rows, taken blocks, chunks).

    rows: (sid, source, chunk, nth, doc_id, size, start, source_size, target) for every row of `docs`, where start is its
    first word's place in its source; taken blocks: (sid, idx, times) for every block that the mix takes.
    """
    sized = checkpoint(_sizes(docs))
    chunks = max(1, -(-sized.count() // _CHUNK_ROWS))
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    blocks = F.ceil(F.col("source_size") / block)
    plan = checkpoint(plan.withColumn("blocks", blocks).withColumn("quota", F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long")))
    placed = _placed(sized, chunks)
    parts = checkpoint(sized.withColumn("chunk", _chunk(chunks)).groupBy("source", "chunk").agg(F.sum("size").alias("words")))
    parts = _ahead(parts, "source", "chunk", "words", "ahead")
    parts = parts.join(plan, parts.source.eqNullSafe(plan.source)).select(parts.source.alias("_source"), F.col("chunk").alias("_chunk"), "ahead", "sid", "source_size", "target")
    rows = placed.join(parts, placed.source.eqNullSafe(F.col("_source")) & (F.col("chunk") == F.col("_chunk")))
    rows = rows.select("sid", "source", "chunk", "nth", "doc_id", "size", (F.col("ahead") + F.col("before")).alias("start"), "source_size", "target")
    total = plan.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    slots = _slots(plan, total, seed) if total else plan.sparkSession.createDataFrame([], "sid int, blocks long, t long")
    turn, place = F.floor(F.col("t") / F.col("blocks")), F.col("t") % F.col("blocks")
    taken = slots.select("sid", _permuted(place, F.col("blocks"), F.col("sid"), turn, F.lit(seed)).alias("idx")).groupBy("sid", "idx").agg(F.count("*").alias("times"))
    return rows, taken, chunks


def _pieces(rows: DataFrame, taken: DataFrame, block: int, *keep: str) -> DataFrame:
    """Every row's parts by block: `lo` and `hi` are places in the source, `times` how often the mix takes the part."""
    last = F.floor((F.col("start") + F.greatest(F.col("size"), F.lit(1)) - 1) / block)
    parts = rows.select(*keep, "sid", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), last)).alias("idx"))
    parts = parts.withColumn("lo", F.greatest("start", F.col("idx") * block)).withColumn("hi", F.least(F.col("start") + F.col("size"), (F.col("idx") + 1) * block))
    return parts.join(taken.hint("merge"), ["sid", "idx"], "left").withColumn("times", F.coalesce("times", F.lit(0)))


def mix(docs: DataFrame, block: int = 32, seed: int = 20) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of `docs`: the words that the mix takes of it."""
    rows, taken, _ = plan_blocks(docs, block, seed)
    keep = ("sid", "chunk", "nth", "doc_id", "size", "source_size", "target")
    pieces = _pieces(rows, taken, block, *(k for k in keep if k not in ("sid", "size")))
    out = pieces.groupBy(*keep).agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, block: int = 32, seed: int = 20) -> DataFrame:
    """The mix as rows of `docs`, all columns: a document's taken words, once for each time that they are taken.

    The first time has all parts that are taken at least once, and so on. Where every part is taken the text stays as it
    is, else its words are joined by spaces; `n_chars`, where there, follows. Rows of which nothing is taken go.
    """
    rows, taken, chunks = plan_blocks(docs, block, seed)
    pieces = _pieces(rows, taken, block, "source", "chunk", "nth").where("times > 0 AND hi > lo")
    part = F.struct((F.col("lo") - F.col("start")).cast("int").alias("at"), (F.col("hi") - F.col("lo")).cast("int").alias("n"), "times")
    spans = pieces.groupBy("source", "chunk", "nth").agg(F.sort_array(F.collect_list(part)).alias("spans"))
    spans = spans.select(F.col("source").alias("_source"), F.col("chunk").alias("_chunk"), F.col("nth").alias("_nth"), "spans")
    whole = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text").cast("string")).alias("size"), F.xxhash64(F.col("text").cast("string")).alias("digest"), row_of(docs).alias("_row"))
    placed = _placed(whole, chunks)
    joined = placed.join(spans, placed.source.eqNullSafe(F.col("_source")) & (F.col("chunk") == F.col("_chunk")) & (F.col("nth") == F.col("_nth")))
    most = F.array_max(F.transform("spans", lambda x: x["times"]))
    copies = joined.select("_row", "size", F.col("spans"), F.explode(F.sequence(F.lit(1), most.cast("int"))).alias("copy"))
    here = F.filter("spans", lambda x: x["times"] >= F.col("copy"))
    # The words are bound to a name by an array of one element, so that they are found once and not for every span.
    words = F.array(F.regexp_extract_all(F.col("_row.text"), F.lit(WORD), F.lit(0)))
    cut = F.transform(words, lambda w: F.array_join(F.flatten(F.transform(here, lambda x: F.slice(w, x["at"] + 1, x["n"]))), " "))[0]
    count = F.aggregate(here, F.lit(0), lambda n, x: n + x["n"])
    text = F.when(count == F.col("size"), F.col("_row.text")).otherwise(cut)
    out = copies.withColumn("_text", text)
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*[(new[c] if c in new else F.col("_row").getField(c)).alias(c) for c in docs.columns])
