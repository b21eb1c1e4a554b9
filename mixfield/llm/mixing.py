"""Mixing sources to target weights by a low-discrepancy schedule of token blocks; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixfield.llm.common import word_count, written

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: The mix has so many times the words of the input, and no source more than CAP times its own.
SHARE, CAP = 1.5, 2
#: A source is cut into at least BLOCKS blocks, and into more so that a block has at most BLOCK_WORDS words.
BLOCKS, BLOCK_WORDS = 4096, 1024
#: The golden-ratio points are the multiples of STEP modulo POINTS, two successive Fibonacci numbers.
POINTS, STEP = 1836311903, 1134903170
#: Points are matched with sources on a grid of cells of this width.
CELL = POINTS // 4096 + 1
#: Documents of one bucket, and slots of one run, are ordered in one task.
BUCKET, RUN_BITS = 4096, 16


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, key, copies``: the number of words, a hash of the text, and how many rows are alike in all of these."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"), text_key(F.col("text")).alias("key"))
    return rows.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("copies"))


def text_key(text: Column) -> Column:
    return F.xxhash64(text, F.length(text))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``source, sid, source_size, target`` for ``sizes(source, size)``.

    Sources get ``share`` of all words by weight; what would be above ``cap`` times a source's own size goes to the others by
    weight, until none is above. So a source has ``least(cap * size, level * weight)``, and the level is found by filling the sources
    up in order of ``size / weight``. ``sid`` numbers the sources by code point, null last.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row a source from here on
    sources = sources.withColumn("sid", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("cap", (cap * F.col("source_size")).cast("double"))
    upward = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before, onward, everything = upward.rowsBetween(Window.unboundedPreceding, -1), upward.rowsBetween(0, Window.unboundedFollowing), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    sources = sources.withColumn("level", left / F.sum("weight").over(onward))
    # the first source that is not filled up has the level of all; seen from those after it, it is lower
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything)
    return sources.withColumn("level", level).select("source", "sid", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), "cap").alias("target"))


def placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """``sizes`` with ``sid``, its source's columns and ``start``: the words of the same source that come before in shuffled order.

    A source is ordered in buckets by a hash of doc_id and text, whose sums are added up first, so no task orders a whole source. Rows that are alike are one row
    there, and are told apart by ``copy``, from 0, afterwards.
    """
    buckets = max(1, -(-sizes.count() // BUCKET))
    rows = sizes.join(sources, sizes.source.eqNullSafe(sources.source)).drop(sources.source).withColumn("place", F.xxhash64("doc_id", "key"))
    rows = rows.withColumn("bucket", F.pmod("place", F.lit(buckets))).withColumn("all", F.col("size") * F.col("copies"))
    earlier = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(F.col("sid").alias("s"), F.col("bucket").alias("b")).agg(F.sum("all").alias("words"))
    sums = sums.select("s", "b", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("sid", "bucket").orderBy("place", "doc_id", "key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("all").over(within), F.lit(0)))
    rows = rows.join(sums, (rows.sid == sums.s) & (rows.bucket == sums.b)).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return rows.withColumn("start", F.col("before") + F.col("inside") + F.col("copy") * F.col("size")).drop("s", "b", "bucket", "before", "inside", "place", "all")


def blocked(sources: DataFrame) -> DataFrame:
    """Sources with their number of ``blocks``, which differ by one word at most: ``words`` each and ``over`` words more, evenly spread."""
    wanted = F.greatest(F.lit(BLOCKS), F.ceil(F.col("source_size") / BLOCK_WORDS))
    # so many that their number's square is still a long
    rows = sources.where("source_size > 0").withColumn("blocks", F.least("source_size", wanted, F.lit(1 << 31)))
    return rows.withColumn("words", F.expr("source_size div blocks")).withColumn("over", F.col("source_size") % F.col("blocks"))


def block_start(block: str) -> str:
    """SQL for the number of a source's words before a block."""
    return f"(({block}) * words + (({block}) * over) div blocks)"


def block_of(word: str) -> str:
    """SQL for the block of a source's word: a guess in floating point, which is never off by more than one."""
    guess = f"cast(floor(({word}) * (blocks / source_size)) as bigint)"
    return f"({guess} + case when {block_start(guess)} > {word} then -1 when {block_start(guess + ' + 1')} <= {word} then 1 else 0 end)"


def schedule(sources: DataFrame) -> DataFrame:
    """``slot, sid, rank`` of all slots: the mix in the order in which blocks are read.

    Slot i belongs to the source in whose part of [0, 1) the i-th golden-ratio point lies; parts are as wide as the source's share
    of the slots. ``rank`` numbers the slots of a source.
    """
    # One row a source up to the parts; the number of slots is the one figure that the driver needs.
    wanted = blocked(sources).withColumn("wanted", F.col("target") * F.col("blocks") / F.col("source_size"))
    slots = int(round(wanted.agg(F.coalesce(F.sum("wanted"), F.lit(0.0))).first()[0]))
    total = F.sum("wanted").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    upto = F.round(F.sum("wanted").over(Window.orderBy("sid")) / total * float(POINTS)).cast("long")
    parts = wanted.select("sid", upto.alias("upto")).withColumn("since", F.coalesce(F.lag("upto").over(Window.orderBy("sid")), F.lit(0).cast("long"))).where("upto > since")
    parts = parts.withColumn("cell", F.explode(F.sequence(F.expr(f"since div {CELL}"), F.expr(f"(upto - 1) div {CELL}"))))
    spark = sources.sparkSession
    points = spark.range(1, slots + 1).select(F.col("id").alias("slot"), (F.col("id") % POINTS * STEP % POINTS).alias("point"))
    points = points.withColumn("cell", F.expr(f"point div {CELL}"))
    found = points.join(parts, "cell").where("point >= since and point < upto").select("slot", "sid", F.shiftright("slot", RUN_BITS).alias("run"))
    found = written(found, "slots")
    before = found.groupBy("sid", "run").agg(F.count("*").alias("n"))
    before = before.select("sid", "run", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = found.withColumn("inside", F.row_number().over(Window.partitionBy("sid", "run").orderBy("slot")) - 1)
    return ranked.join(before, ["sid", "run"]).select("slot", "sid", (F.col("before") + F.col("inside")).alias("rank"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """What a mix of the sources of ``docs(doc_id, text, source)`` takes of each document.

    The r-th slot of a source reads the r-th of its blocks, and begins again after the last one, ``cap`` times at most. Returns
    ``doc_id, source, size, source_size, target, taken, passes, key, copies, copy``, one row for each of ``docs``: ``passes`` has the words taken
    from the document's beginning or end in each reading of its source, as ``(pass, first, words)`` with ``first`` the words before them, and ``taken`` is their sum. Null
    text has no words and gives ``taken`` 0, as an empty one does; a null source is one of the sources, the last. Equal rows may be taken unequally often, but
    always in the same numbers: ``key`` is ``text_key`` of the text, and of ``copies`` rows with the same doc_id, source and text each has another ``copy``. Other columns are dropped.
    """
    sizes = written(sized(docs), "sizes")
    sources = written(targets(sizes.select("source", (F.col("size") * F.col("copies")).alias("size")), weights, share, cap), "sources")
    rows = placed(sizes, sources)
    cut = blocked(sources).select(F.col("sid").alias("s"), "blocks", "words", "over")
    uses = schedule(sources).join(cut, F.col("sid") == F.col("s")).select("sid", (F.col("rank") % F.col("blocks")).alias("block"), F.expr("rank div blocks").alias("pass"))
    uses = uses.where(F.col("pass") < cap).groupBy("sid", "block").agg(F.collect_set("pass").alias("used"))

    filled = rows.where("size > 0").join(cut, F.col("sid") == F.col("s"))
    pieces = filled.withColumn("block", F.explode(F.sequence(F.expr(block_of("start")), F.expr(block_of("start + size - 1")))))
    since, until = F.expr(block_start("block")), F.expr(block_start("block + 1"))
    pieces = pieces.withColumn("first", F.greatest(since, "start") - F.col("start")).withColumn("n", F.least(until, F.col("start") + F.col("size")) - F.col("start") - F.col("first"))
    key = ["doc_id", "source", "size", "source_size", "target", "sid", "start", "key", "copies", "copy"]
    read = pieces.join(uses, ["sid", "block"], "left").select(*key, "first", "n", F.explode_outer("used").alias("pass"))
    by_pass = read.groupBy(*key, "pass").agg(F.min("first").alias("first"), F.sum("n").alias("words"))
    took = F.filter(F.collect_list(F.when(F.col("pass").isNotNull(), F.struct("pass", "first", "words"))), lambda x: x.isNotNull())
    taken = by_pass.groupBy(*key).agg(F.sort_array(took).alias("passes"))
    taken = taken.select("doc_id", "source", "size", "source_size", "target", F.aggregate("passes", F.lit(0).cast("long"), lambda a, x: a + x.words).alias("taken"), "passes", "key", "copies", "copy")
    empty = rows.where("size = 0").select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.expr("cast(array() as array<struct<pass: bigint, first: bigint, words: bigint>>)").alias("passes"), "key", "copies", "copy")
    return taken.unionByName(empty)
