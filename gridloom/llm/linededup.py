"""Removal of repeated runs of lines, by a suffix array over line ids (DataFrame functions only).

The corpus is one sequence of lines per document. A run of consecutive lines of at least MIN_WORDS words that occurs earlier (in an earlier
document by doc_id, or further up in the same one) is deleted; its first occurrence stays, and so does everything else.

Suffixes are ordered by prefix doubling: rank 0 orders lines, and round k orders suffixes by their first 2^k lines from pairs
of ranks of the round before. Ranks come from a range sort of the distinct pairs, so equal ranks are an interval of the suffix array whose
longest common prefix is at least 2^k lines; suffixes that are alone in theirs leave the rounds. The intervals that matter are those of runs just long
enough: for each line the shortest qualifying run that starts there and the one that ends there. A run of m lines has the interval named by the
ranks of its first and last 2^k lines, 2^k <= m < 2^(k+1). Together these runs cover exactly the lines of all maximal
repeated runs, so no longer common prefix has to be measured; as a line has a word at least, MIN_WORDS bounds the rounds too.

Defined cases: lines are separated by newline characters and compared without outer blanks; blank lines are never deleted and do not interrupt a run; a null
text stays null; null doc_ids come last; rows equal in doc_id and text are one document, and all get its result; other columns pass through, and ones named like added
columns are refused; an empty table gives an empty result. A line, run or document that makes up a third of all rows is spread by salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm._common import lookup_join, materialize, new_name, shuffle_width, text_or_empty

MIN_WORDS = 50
LAST_ID = (1 << 63) - 1


def document_key() -> Column:
    """Orders documents and tells rows of one doc_id with different texts apart."""
    return F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(text_or_empty()).alias("text_hash"))


def line_table(docs: DataFrame) -> DataFrame:
    """doc, pos (among lines with words), line (its place in the text), words and a 128-bit digest of each line with words."""
    lines = F.transform(F.split(text_or_empty(), "\n", -1), lambda x, i: F.struct(i.alias("line"), F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "").alias("s")))
    full = F.filter(lines, lambda x: x["s"] != "")
    rows = docs.select(document_key().alias("doc"), full.alias("full")).select("doc", F.posexplode("full").alias("pos", "x"))
    words = F.size(F.split("x.s", r"[\x20\x09-\x0D]+"))
    return rows.select("doc", "pos", F.col("x.line").alias("line"), words.cast("long").alias("words"), F.unhex(F.md5("x.s")).alias("key"))


def ranked(keys: DataFrame, label: str) -> DataFrame:
    """Ranks of repeated keys in key order: key, n, rank. Equal keys meet in one range, and the id of a row grows with range and place in it."""
    counted = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ordered = counted.repartitionByRange(shuffle_width(keys.sparkSession), "key").sortWithinPartitions("key")
    return materialize(ordered.withColumn("rank", F.monotonically_increasing_id()), label)


def suffix_ranks(lines: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """(lines that occur twice at least, with rank 0; all levels' ranks as doc, level, pos, rank)."""
    spread = F.struct("doc", "pos")
    repeated = lookup_join(lines, ranked(lines.select("key"), "rank0"), "key", "n", spread).drop("key", "n")
    repeated = materialize(repeated.dropDuplicates(["doc", "pos"]), "repeated")
    level = repeated.select("doc", "pos", "rank")
    every = level.withColumn("level", F.lit(0))
    for k in range(levels):
        ahead = Window.partitionBy("doc").orderBy("pos").rangeBetween(1 << k, 1 << k)
        pairs = level.withColumn("next", F.max("rank").over(ahead)).where("next IS NOT NULL")
        pairs = materialize(pairs.select("doc", "pos", F.struct("rank", "next").alias("key")), "pairs")
        ranks = ranked(pairs.select("key"), "ranks")
        if ranks.isEmpty():
            break
        level = materialize(lookup_join(pairs, ranks, "key", "n", spread).select("doc", "pos", "rank"), "level")
        every = every.unionByName(level.withColumn("level", F.lit(k + 1)))
    return repeated, every


def shortest_runs(repeated: DataFrame, min_words: int) -> DataFrame:
    """doc, first, last (positions) of runs that just reach min_words, from every start and to every end, within stretches of repeated lines."""
    by_pos = Window.partitionBy("doc").orderBy("pos")
    stretch = repeated.withColumn("stretch", F.col("pos") - F.row_number().over(by_pos))
    upto = Window.partitionBy("doc", "stretch").orderBy("pos")
    before = stretch.withColumn("before", F.sum("words").over(upto) - F.col("words")).withColumn("ends", F.lead("pos").over(upto).isNull())
    # Each line starts after the words before it; a stretch's last line also marks where the stretch stops.
    here = F.struct("pos", "before")
    stop = F.struct((F.col("pos") + 1).alias("pos"), (F.col("before") + F.col("words")).alias("before"))
    marks = before.withColumn("mark", F.explode(F.when(F.col("ends"), F.array(here, stop)).otherwise(F.array(here)))).select("doc", "stretch", "mark.*")
    back = Window.partitionBy("doc", "stretch").orderBy("before").rangeBetween(Window.unboundedPreceding, -min_words)
    ahead = Window.partitionBy("doc", "stretch").orderBy(F.col("before").desc()).rangeBetween(Window.unboundedPreceding, -min_words)
    found = marks.withColumn("first", F.max("pos").over(back)).withColumn("after", F.min("pos").over(ahead))
    starting = F.struct(F.col("pos").alias("first"), (F.col("after") - 1).alias("last"))
    ending = F.struct("first", (F.col("pos") - 1).alias("last"))
    runs = found.select("doc", F.explode(F.array(starting, ending)).alias("run")).select("doc", "run.*")
    return runs.where("first IS NOT NULL AND last IS NOT NULL").distinct()


def later_copies(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc and line places (array) to delete."""
    repeated, ranks = suffix_ranks(lines, max(0, min_words.bit_length() - 1))
    m = F.col("last") - F.col("first") + 1
    level = F.floor(F.log2(m.cast("double") + 0.5)).cast("int")
    runs = shortest_runs(repeated, min_words).withColumn("level", level).withColumn("tail", F.col("last") - F.expr("shiftleft(1, level)") + 1)
    heads = ranks.select("doc", "level", F.col("pos").alias("first"), F.col("rank").alias("head_rank"))
    tails = ranks.select("doc", "level", F.col("pos").alias("tail"), F.col("rank").alias("tail_rank"))
    named = runs.join(heads, ["doc", "level", "first"]).join(tails, ["doc", "level", "tail"])
    named = materialize(named.select("doc", "first", "last", F.struct(m.alias("m"), "head_rank", "tail_rank").alias("interval")), "runs")
    earliest = named.groupBy("interval").agg(F.min(F.struct("doc", "first")).alias("origin"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = lookup_join(named, materialize(earliest, "intervals"), "interval", "n", F.struct("doc", "first")).where(F.struct("doc", "first") != F.col("origin"))
    places = copies.select("doc", F.explode(F.sequence("first", "last")).alias("pos")).distinct()
    return places.join(repeated.select("doc", "pos", "line"), ["doc", "pos"]).groupBy("doc").agg(F.collect_list("line").alias("gone"))


def drop_repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later copies of repeated runs deleted from the text, and n_lines and removed_lines."""
    if clash := [c for c in ("n_lines", "removed_lines") if c in docs.columns]:
        raise ValueError(f"columns {clash} are already there")
    lines = materialize(line_table(docs), "lines")
    doc, gone = (new_name(docs.columns, c) for c in ("_doc", "gone"))
    found = later_copies(lines, min_words).select(F.col("doc").alias(doc), F.col("gone").alias(gone))
    joined = docs.withColumn(doc, document_key()).join(found, doc, "left")
    split = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(split, i)), "\n"))
    columns = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return joined.select(*columns, F.coalesce(F.size(split), F.lit(0)).alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).alias("removed_lines"))
