"""Removal of repeated runs of lines by a suffix order over line ids, made by prefix doubling; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixfield.llm.common import fresh, written
from mixfield.llm.substrings import bitmap, others, thinned
from mixfield.operators.storage import discard

#: Runs of at least so many lines are removed where they are repeated.
MIN_LINES = 3


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def positions(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, pos, last, h1, h2``: one row for each line of each distinct ``(doc_id, text)``.

    ``pos`` numbers all lines in order of doc_id (null first), text hash and place, without gaps in a document; ``last`` is the
    position of the document's last line. ``h1, h2`` are 128 bits of hash of the line. A null text has no line.
    """
    ids = F.transform(split_lines(F.col("text")), lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2")))
    thin = docs.where("text is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text", F.length("text")).alias("text_hash"), ids.alias("lines"))
    # Without texts this is small, and written once, since sorting by range reads its input twice. Only rows that may be repeated are shuffled to become one.
    thin = written(thin, "line-ids")
    repeated = thin.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    bits = written(bitmap(repeated.select("text_hash")), "repeated")
    once = others(thin, "text_hash", bits).unionByName(thinned(thin, "text_hash", bits).dropDuplicates(["doc_id", "text_hash"]))
    ordered = once.repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash")
    lines = ordered.select("doc_id", "text_hash", F.size("lines").alias("n"), F.posexplode("lines").alias("place", "line"))
    # partitions are ranges of documents in order, so these ids follow the order of documents and lines
    lines = lines.withColumn("pos", F.monotonically_increasing_id())
    lines = written(lines.select("doc_id", "text_hash", "place", "pos", (F.col("pos") - F.col("place") + F.col("n") - 1).alias("last"), "line.h1", "line.h2"), "lines")
    discard(thin, bits)
    return lines


def _ranked(blocks: DataFrame, *key: str, hashed: bool = False) -> DataFrame:
    """``pos, last, rank, first`` of the blocks that occur more than once.

    Ranks number the groups of equal blocks in the order of their keys, so suffixes are ordered by the ranks of what they begin with; ``first`` is
    a group's first position. Only the groups are sorted, by ranges, and not their members. With ``hashed``, for a key that begins with a hash, blocks
    that occur once go before the members are shuffled to meet their groups.
    """
    groups = written(blocks.groupBy(*key).agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "groups")
    # partitions are ranges of keys in order, so these ids follow the order of keys
    ordered = groups.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("new", F.monotonically_increasing_id())
    # a table of its own, so that Spark can split the join with it where a block is very frequent
    ordered = written(ordered, "ranks")
    if hashed:
        blocks = thinned(blocks, key[0], bitmap(groups.select(key[0])))
    found = written(blocks.select("pos", "last", *key).join(ordered, list(key)).select("pos", "last", F.col("new").alias("rank"), "first"), "suffixes")
    discard(ordered, groups)
    return found


def _joined(found: DataFrame, step: int) -> DataFrame:
    """``_ranked`` for blocks made of two blocks of ``found``, the second of which begins ``step`` lines later in the same document."""
    after = found.select((F.col("pos") - step).alias("pos"), F.col("last").alias("last_after"), F.col("rank").alias("rank_after"))
    blocks = written(found.join(after, "pos").where(F.col("last") == F.col("last_after")).select("pos", "last", "rank", "rank_after"), "blocks")
    ranked = _ranked(blocks, "rank", "rank_after")
    discard(blocks)
    return ranked


class Suffixes:
    """The suffixes of all documents' lines, ranked by prefix doubling.

    ``levels[j]`` holds the suffixes whose first ``2 ** j`` lines occur more than once, ranked by these lines: suffixes of equal rank are an
    interval of the suffix order whose longest common prefix has at least so many lines. Lines are ordered by their hashes. A level is ranked
    by the pairs of ranks of its two halves at the level before, and only suffixes that are still in an interval with others go on.
    """

    def __init__(self, lines: DataFrame):
        self.prefixes: list[DataFrame] = []
        self.levels = [_ranked(lines.select("pos", "last", "h1", "h2"), "h1", "h2", hashed=True)]

    def level(self, j: int) -> DataFrame:
        while len(self.levels) <= j:
            self.levels.append(_joined(self.levels[-1], 1 << (len(self.levels) - 1)))
        return self.levels[j]

    def close(self) -> None:
        """Deletes all tables."""
        discard(*self.levels, *self.prefixes)

    def complete(self) -> None:
        """Doubles until no suffix is in an interval with another."""
        while not self.levels[-1].isEmpty():
            self.level(len(self.levels))

    def common_prefixes(self) -> DataFrame:
        """``pos, last, length, earlier`` of each suffix that begins with a repeated line: the longest prefix that it has in common with any other suffix, and with an earlier one.

        This is the depth of the deepest interval that the suffix is in, found from the highest level down: a suffix goes on by ``2 ** j`` lines if
        another one with the same prefix so far goes on in the same way. Of suffixes that have gone on together one stays behind as well, for
        those that will follow them over fewer lines.
        """
        self.complete()
        start = found = self.levels[-1].select("pos", "last", "first", F.lit(0).cast("long").alias("length"))  # no rows
        group = ["first", "length"]
        for j in range(len(self.levels) - 2, -1, -1):
            step = self.levels[j]
            above = self.levels[j + 1].select("pos", F.col("first").alias("first_above"))
            entering = step.join(above, "pos", "left").where("first_above is null or first_above = pos").select("pos", "last", "first", F.lit(1 << j).cast("long").alias("length"))
            after = step.select(F.col("pos").alias("at"), F.col("last").alias("last_after"), "rank")
            ahead = found.withColumn("at", F.col("pos") + F.col("length")).join(after, "at").where(F.col("last") == F.col("last_after")).select("pos", "last", *group, "rank")
            ahead = written(ahead, "ahead")
            together = ahead.groupBy(*group, "rank").agg(F.min("pos").alias("next"), F.min_by("last", "pos").alias("next_last"), F.count("*").alias("n")).where("n > 1").drop("n")
            together = written(together, "together")
            going = written(ahead.join(together, [*group, "rank"]).select("pos", "last", *group, "next"), "going")
            gone_on = going.select("pos", "last", F.col("next").alias("first"), (F.col("length") + (1 << j)).alias("length"))
            behind = together.select(F.col("next").alias("pos"), F.col("next_last").alias("last"), *group)
            before, found = found, written(found.join(going.select("pos", *group), ["pos", *group], "left_anti").select("pos", "last", *group).union(gone_on).union(behind).union(entering), "prefixes")
            discard(ahead, together, going, *[before] * (before is not start))
        self.prefixes = [found] * (found is not start)
        # the first suffix of an interval has rows of the wider intervals that it is in, too
        return found.groupBy("pos", "last").agg(F.max("length").alias("length"), F.max(F.when(F.col("first") < F.col("pos"), F.col("length"))).alias("earlier"))


def later_copies(prefixes: DataFrame, lines: DataFrame, min_lines: int, runs: bool) -> DataFrame:
    """``doc_id, text_hash, n, removed``: number of lines, and the places of the lines that belong to a later copy of a run of lines, from ``Suffixes.common_prefixes``.

    A run is any ``min_lines`` or more lines in a row, also over blank lines; its first occurrence in order of doc_id and place stays. A suffix whose
    longest prefix in common with an earlier one has so many lines begins a later copy of a maximal run, unless that lies in the run of the suffix one line before: then it is one
    line shorter at most. Occurrences may overlap, so of a line repeated many times in a row the first one stays. Runs do not go over the end of a document.
    With ``runs`` there is also ``longest``, and a row for each document with a suffix in ``prefixes``; ``removed`` may be empty then.
    """
    copies = prefixes.where(F.col("earlier") >= min_lines).select("pos", "last", "earlier")
    before = copies.select((F.col("pos") + 1).alias("pos"), F.col("earlier").alias("before"))
    maximal = copies.join(before, "pos", "left").where("before is null or before <= earlier")
    none = F.lit(None).cast("long")
    marks = maximal.select("last", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("earlier") - 1)).alias("pos"), none.alias("length"))
    if runs:
        marks = marks.unionByName(prefixes.select("last", none.alias("pos"), "length"))
    # a document is known by the position of its last line, so its lines need not be joined; nulls are in no set
    found = written(marks.groupBy("last").agg(F.collect_set("pos").alias("gone"), *[F.max("length").alias("longest")] * runs), "gone")
    heads = thinned(lines.where("pos = last"), "last", bitmap(found.select("last"))).select("doc_id", "text_hash", "last", "place")
    removed = F.transform("gone", lambda pos: (pos - F.col("last") + F.col("place")).cast("int"))
    return heads.join(found, "last").select("doc_id", "text_hash", (F.col("place") + 1).alias("n"), removed.alias("removed"), *["longest"] * runs)


def _kept(text: Column, removed: Column) -> Column:
    """The text without the lines at the places ``removed``."""
    left = F.sort_array(F.array_except(F.sequence(F.lit(0), F.size(split_lines(text)) - 1), removed))
    # the lines are a variable of the outer lambda, so that a text is split once and not once for each line
    return F.transform(F.array(split_lines(text)), lambda lines: F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))[0]


def deduplicate(docs: DataFrame, min_lines: int = MIN_LINES, runs: bool = False, of: Callable[[Column], Column] | None = None) -> DataFrame:
    """``docs`` with ``kept`` (its text without the lines of ``later_copies``), ``n_lines`` and ``n_removed``.

    With ``runs`` there is also ``longest_run``: the number of lines of the longest maximal run in the document that occurs again, in it or anywhere, 0
    below ``min_lines``. All columns and rows of ``docs(doc_id, text, ...)`` stay; columns of the new names are replaced. A null text stays null and
    has 0 lines, an empty text has one empty line. Equal rows, by doc_id and text, are one document here and get equal results. A
    text all of whose lines go becomes empty. Null doc_ids come first in the order of documents.

    With ``of``, a function of a text such as its digest, ``kept`` is this of the text that is kept, and there is no column ``text``. Then only texts
    that lose a part of their lines are shuffled, and of the others what ``of`` makes of them.
    """
    rows = docs.drop("kept", "n_lines", "n_removed", *["longest_run"] * runs)
    at, text_hash, own, key, n, gone, longest, value = fresh(rows, "id", "text_hash", "own_hash", "key", "n", "removed", "longest", "value")
    places = positions(docs)
    suffixes = Suffixes(places)
    prefixes = written(suffixes.common_prefixes().where(F.col("length") >= min_lines), "runs")
    suffixes.close()
    found = written(later_copies(prefixes, places, min_lines, runs), "removed")
    discard(places, prefixes)
    removed = found.select(F.col("doc_id").alias(at), F.col("text_hash").alias(text_hash), F.col("n").alias(n), F.col("removed").alias(gone), *[F.col("longest").alias(longest)] * runs)
    rows = rows.withColumn(own, F.xxhash64("text", F.length("text"))).withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), own))
    rows = rows.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(split_lines(F.col("text")))).cast("long"))
    bits_of = lambda some: bitmap(some.select(F.xxhash64(at, text_hash)))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(at)) & (F.col(own) == F.col(text_hash))
    none = F.size(F.coalesce(F.col(gone), F.array())) == 0
    if of:
        part = removed.where(~none & (F.size(gone) < F.col(n))).select(at, text_hash, gone)
        texts = thinned(rows.select("doc_id", "text", own, key), key, bits_of(part)).join(part, same)
        texts = texts.select(at, text_hash, of(_kept(F.col("text"), F.col(gone))).alias(value)).dropDuplicates([at, text_hash])
        texts = texts.select(F.col(at).alias("d"), F.col(text_hash).alias("t"), value)
        removed = written(removed.join(texts, F.col(at).eqNullSafe(F.col("d")) & (F.col(text_hash) == F.col("t")), "left").drop("d", "t"), "removed")
        discard(found)
        rows = rows.withColumn("kept", of(F.col("text"))).drop("text")
        kept = F.when(none, F.col("kept")).when(F.size(gone) == F.col(n), of(F.lit(""))).otherwise(F.col(value))
    else:
        kept = F.when(none, F.col("text")).otherwise(_kept(F.col("text"), F.col(gone)))
    # only documents that have something to remove, or to tell of, are shuffled
    bits = bits_of(removed)
    joined = thinned(rows, key, bits).join(removed, same, "left")
    rows = joined.unionByName(others(rows, key, bits), allowMissingColumns=True)
    rows = rows.withColumn("n_removed", F.size(F.coalesce(F.col(gone), F.array())).cast("long")).withColumn("kept", kept)
    if runs:
        rows = rows.withColumn("longest_run", F.coalesce(longest, F.lit(0)).cast("long"))
    return rows.drop(at, text_hash, own, key, n, gone, longest, value)
