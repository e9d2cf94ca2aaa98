"""Near-duplicate components by a grouped prefix join on word shingles.

A document's set is its distinct shingles of `words` lower-cased words, as 64-bit hashes. Two sets with Jaccard similarity t or more
share one of their first n - ceil(t n) + 1 elements in any common order; the order here puts rare shingles first, by a table of
2^20 counters over all shingles (fixed size, whatever the corpus), then by hash.

1. Documents with equal sets are one entity; entities with equal size and prefix are one group.
2. Groups meet in the lists of their prefix elements, cut where sizes leave a gap. In each list a leader is compared with every other group, and in each group a leader with every
   other entity: as many pairs as list entries, however long a list is.
3. Lists whose entries now lie in one component are done. In the others, every pair from different components is compared, in blocks of bounded size;
   pairs inside a component need no comparison, as they cannot change it.

Pairs pass filters on size and on parity maps (which bound the overlap from above; 512 bits, and about a bit per element for larger sets) before
texts are fetched and compared exactly.

Defined cases: a null text, or one without words, has an empty set and is linked with nothing; fewer words than a shingle form one shingle together; rows
that share a doc_id are separate documents; null doc_ids never name a component that has another id; other columns are ignored; empty tables give
empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm._common import batch_bytes, lookup_join, materialize, new_name, scratch, text_or_empty
from gridloom.llm.components import components
from gridloom.llm.fuse import mix
from gridloom.llm.quality import WHITE
from gridloom.llm.tokens import parts_of, slices

COUNTERS = 1 << 20
CHUNKS = 64
BLOCK = 500
#: Largest set for which the 512-bit map alone is used.
SMALL = 512
#: Bytes of text that a comparison of pairs holds at once.
PAIR_BYTES = 2_000_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts and which text each belongs to, sorted by text and hash."""
    sizes = np.fromiter((len(t.encode()) + 1 for t in texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    b = LOWER[np.frombuffer(b" ".join(t.encode() for t in texts) + b" ", np.uint8)]
    white = WHITE[b]
    edge = np.diff(white.astype(np.int8), prepend=np.int8(1), append=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        place = np.arange(len(b)) - np.repeat(starts, np.diff(np.concatenate([[0], starts[1:], [len(b)]])))
        power = np.cumprod(np.full(int((ends - starts).max()), 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
        weighted = np.where(white, np.uint64(0), (b.astype(np.uint64) + np.uint64(1)) * power[np.clip(place, 0, len(power) - 1)])
        word = mix(np.add.reduceat(weighted, starts, dtype=np.uint64), 1)
        owner = np.searchsorted(bounds, starts, "right") - 1
        per = np.bincount(owner, minlength=len(texts))
        first = np.cumsum(per) - per
        short = np.flatnonzero((per > 0) & (per < words))
        n = max(0, len(word) - words + 1)
        whole = np.flatnonzero(owner[:n] == owner[words - 1 :]) if n else np.zeros(0, np.int64)
        h = np.zeros(len(whole), np.uint64)
        for k in range(words):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + word[whole + k], 2)
        tails = np.zeros(len(short), np.uint64)
        for i, d in enumerate(short.tolist()):
            x = np.uint64(per[d])
            for w in word[first[d] : first[d] + per[d]]:
                x = mix(np.array([x * np.uint64(0xD6E8FEB86659FD93) + w]), 3)[0]
            tails[i] = x
    hashes, owners = np.concatenate([h, tails]), np.concatenate([owner[whole], short])
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    fresh = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])]) if len(hashes) else np.zeros(0, bool)
    return hashes[fresh], owners[fresh]


def counter_table(docs: DataFrame, words: int) -> np.ndarray:
    """How often shingles fall on each of COUNTERS counters, over all documents. Each task sends one table; they are added in two steps of bounded groups."""
    piece = COUNTERS // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, some in parts_of(batch, "text"):
                hashes, _ = shingle_sets(some, words)
                table += np.bincount((hashes & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        if table.any():
            part = TaskContext.get().partitionId()
            kind = np.dtype("<u4" if table.max() < 1 << 32 else "<i8")
            for k in range(CHUNKS):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part % 256], pa.int32()), pa.array([kind.itemsize], pa.int32()), pa.array([table[k * piece : (k + 1) * piece].astype(kind).tobytes()], pa.binary())], ["chunk", "part", "width", "data"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(piece, np.int64)
        for width, data in zip(table["width"].to_pylist(), table["data"].to_pylist()):
            total += np.frombuffer(data, "<u4" if width == 4 else "<i8")
        return pa.table({"chunk": table["chunk"][:1], "part": table["part"][:1], "width": pa.array([8], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    schema = "chunk int, part int, width int, data binary"
    sent = docs.select(text_or_empty().alias("text")).mapInArrow(count, schema)
    added = sent.groupBy("chunk", "part").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema)
    out = np.zeros(COUNTERS, np.int64)
    for r in added.select("chunk", "data").collect():  # CHUNKS rows, 8 MB in all
        out[r["chunk"] * piece : (r["chunk"] + 1) * piece] = np.frombuffer(r["data"], "<i8")
    return np.minimum(out, (1 << 32) - 1).astype(np.uint32)


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set of n with any set at the threshold."""
    return (n * percent + 99) // 100


def wide_map(hashes: np.ndarray) -> np.ndarray:
    """Parities of a set on the next power of two of bits from its size up, as 64-bit numbers; empty for sets that 512 bits suit."""
    if len(hashes) <= SMALL:
        return np.zeros(0, np.int64)
    bits = 1 << (len(hashes) - 1).bit_length()
    odd = np.bincount((hashes >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def signatures(docs: DataFrame, words: int, percent: int, counters: np.ndarray) -> DataFrame:
    """row, doc_id, text_hash, n, digest (of the set), group (digest of size and prefix), prefix (elements in order, 8 bytes each), maps (512 parities) and wide (see wide_map) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part, some in parts_of(batch, "text"):
                ids, marks = part.column("doc_id"), part.column("text_hash")
                hashes, owners = shingle_sets(some, words)
                n = np.bincount(owners, minlength=len(some))
                stop = np.cumsum(n)
                start = stop - n
                order = np.lexsort((hashes, shared.value[(hashes & np.uint64(COUNTERS - 1)).astype(np.int64)], owners))
                ordered = hashes[order].astype("<u8")
                bit = (hashes >> np.uint64(52) & np.uint64(511)).astype(np.int64)
                parity = (np.bincount(owners * 512 + bit, minlength=512 * len(some)).reshape(-1, 512) & 1).astype(np.uint8)
                maps = np.packbits(parity, axis=1, bitorder="little").view("<i8").reshape(len(some), 8)
                length = n - needed(n, percent) + 1
                sets, groups, prefixes, wides = [], [], [], []
                raw = hashes.astype("<u8")
                for a, z, k in zip(start.tolist(), stop.tolist(), length.tolist()):
                    prefix = ordered[a : min(z, a + k)].tobytes()
                    sets.append(hashlib.md5(raw[a:z].tobytes()).digest())
                    groups.append(hashlib.md5((z - a).to_bytes(8, "little") + prefix).digest())
                    prefixes.append(np.frombuffer(prefix, "<i8"))
                    wides.append(wide_map(hashes[a:z]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(len(some))), ids, marks, pa.array(n), pa.array(sets, pa.binary()), pa.array(groups, pa.binary()),
                        lists_of(prefixes), lists_of(list(maps)), lists_of(wides),
                    ],
                    ["row", "doc_id", "text_hash", "n", "digest", "group", "prefix", "maps", "wide"],
                )
                row += len(some)

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text_hash", text_or_empty().alias("text")).mapInArrow(run, f"row long, doc_id {kind}, text_hash long, n long, digest binary, group binary, prefix array<bigint>, maps array<bigint>, wide array<bigint>")
    try:
        return materialize(made, "signatures")
    finally:
        shared.destroy()


def lists_of(rows: list[np.ndarray]) -> pa.ListArray:
    edges = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate([*rows, np.zeros(0, np.int64)])))


def passes(percent: int) -> Column:
    """Whether the pair's sizes (n_a, n_b) and parity maps (maps_a, maps_b) allow the threshold. At least so many elements differ as parities do."""
    differ = sum((F.bit_count(F.col("maps_a")[k].bitwiseXOR(F.col("maps_b")[k])) for k in range(8)), F.lit(0))
    total = F.col("n_a") + F.col("n_b")
    size = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return size & (differ * (100 + percent) <= total * (100 - percent))


def passes_wide(percent: int) -> Column:
    """passes() on the maps wide_a and wide_b, where both rows have one; the larger is folded to the size of the smaller, which keeps parities right."""
    size = F.least(F.size("wide_a"), F.size("wide_b"))

    def folded(side: str) -> Column:
        wide = F.col(f"wide_{side}")
        half = F.zip_with(F.slice(wide, F.lit(1), size), F.slice(wide, size + 1, size), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(wide) == size, wide).otherwise(half)

    each = F.zip_with(folded("a"), folded("b"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(each, F.lit(0), lambda total, x: total + x)
    known = (size > 0) & (F.greatest(F.size("wide_a"), F.size("wide_b")) <= 2 * size)
    return F.when(known, differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)).otherwise(True)


def verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those at the threshold, by comparing their whole sets."""

    def with_text(rows: DataFrame, side: str) -> DataFrame:
        keyed = rows.groupBy(side).agg(F.count(F.lit(1)).alias("_n")).join(texts.withColumnRenamed("row", side), side)
        other = "b" if side == "a" else "a"
        return lookup_join(rows, materialize(keyed, "side"), side, "_n", F.col(other)).drop("_n").withColumnRenamed("text", f"text_{side}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.add(pc.binary_length(batch.column("text_a")), pc.binary_length(batch.column("text_b"))).to_numpy(zero_copy_only=False)
            # As many pairs at a time as hold about PAIR_BYTES of text; one pair at least.
            slot = np.cumsum(sizes) // PAIR_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), batch.num_rows]
            for at, end in zip(cuts, cuts[1:]):
                part = batch.slice(at, end - at)
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                texts = dict(zip(a, part.column("text_a").to_pylist())) | dict(zip(b, part.column("text_b").to_pylist()))
                keys, sets = list(texts), {}
                done = 0
                for some in slices(list(texts.values())):
                    hashes, owners = shingle_sets(some, words)
                    edges = np.searchsorted(owners, np.arange(len(some) + 1))
                    sets |= {keys[done + i]: hashes[edges[i] : edges[i + 1]] for i in range(len(some))}
                    done += len(some)
                hits = []
                for x, y in zip(a, b):
                    p, q = sets[x], sets[y]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    hits.append(100 * both >= percent * (len(p) + len(q) - both))
                keep = pa.array(hits, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], ["a", "b"])

    return materialize(with_text(with_text(pairs, "a"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "found")


def near_components(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; documents link at a Jaccard similarity of percent/100 or more."""
    return component_rows(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """docs with one document of each component, that of the smallest doc_id; among several of that id, the text of the smallest hash.

    Rows equal in doc_id and text stay or go together. Columns of docs may have any names.
    """
    rows = component_rows(docs, words, percent)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    kept = rows.groupBy("component_row").agg(F.min(order).alias("k"))
    id_, hash_ = new_name(docs.columns, "kept_id"), new_name(docs.columns, "kept_hash")
    kept = materialize(kept.select(F.col("k.doc_id").alias(id_), F.col("k.text_hash").alias(hash_)).distinct(), "kept", keep=True)
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(text_or_empty()) == F.col(hash_)), "left_semi")


def component_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and component_row (distinct by component) of every document."""
    with scratch(docs.sparkSession), batch_bytes(docs.sparkSession):
        return materialize(found_components(docs, words, percent), "components", keep=True)


def found_components(docs: DataFrame, words: int, percent: int) -> DataFrame:
    base = docs.select("doc_id", text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    signed = signatures(base, words, percent, counter_table(base, words))
    filled = signed.where("n > 0")
    entities = materialize(filled.groupBy("digest").agg(F.min("row").alias("row"), F.min("doc_id").alias("keep"), F.count(F.lit(1)).alias("copies")), "entities")
    leads = entities.select("row")
    members = materialize(filled.select("row", "group", "n", "maps", "wide").join(leads, "row"), "members")
    groups = materialize(members.groupBy("group").agg(F.min("row").alias("lead"), F.count(F.lit(1)).alias("size")), "groups")

    # Lists of groups by prefix element. The smaller set of a pair shares an element of its short prefix (see below), and the sizes of a
    # pair differ little; entries without a partner of such a kind and size, next to them in order of size, are left out.
    prefixes = signed.select("row", "n", "prefix").join(groups.select(F.col("lead").alias("row")).hint("merge"), "row")
    entries = prefixes.select(F.col("row").alias("lead"), "n", F.posexplode("prefix").alias("pos", "element"))
    short = F.col("pos") < short_prefix(F.col("n"), percent)
    lists = materialize(size_runs(entries.select("element", "lead", (2 * F.col("n") + short.cast("long")).alias("size_short")), percent), "lists")

    facts = members.select("row", "n", "maps", "wide")
    in_group = lookup_join(members.select("row", "group"), groups, "group", "size", F.col("row")).where("row <> lead")
    first = lists.groupBy("list").agg(F.min_by("lead", F.struct(~F.col("short"), F.col("lead"))).alias("leader"), F.count(F.lit(1)).alias("_n"))
    in_lists = lookup_join(lists.select("list", "lead"), first, "list", "_n", F.col("lead")).where("lead <> leader")
    pairs = in_group.select(F.struct(F.col("lead").alias("a"), F.col("row").alias("b")).alias("p"))
    pairs = pairs.unionByName(in_lists.select(F.struct(F.least("lead", "leader").alias("a"), F.greatest("lead", "leader").alias("b")).alias("p")))
    star = screened(materialize(pairs.groupBy("p").count().select("p.*"), "pairs"), facts, percent)

    active = lists.select(F.col("lead").alias("row")).unionByName(groups.where("size > 1").select(F.col("lead").alias("row")))
    active = materialize(lookup_join(members.select("row", "group"), groups, "group", "size", F.col("row")).join(active.distinct().withColumnRenamed("row", "lead"), "lead", "left_semi").select("row", "group", "lead", "size"), "active")
    links = verify(star, pair_texts(base, signed, star), words, percent)
    roots = components(links)

    # What is left: lists with entries of different components.
    placed = active.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    placed = materialize(placed.join(facts.drop("wide"), "row"), "placed")
    of_lists = lists.select("lead", "short", F.struct(F.lit(0).alias("kind"), F.col("list.element"), F.col("list.run")).alias("list"))
    of_groups = groups.where("size > 2").select("lead", F.lit(True).alias("short"), F.struct(F.lit(1).alias("kind"), F.col("lead").alias("element"), F.lit(0).cast("long").alias("run")).alias("list"))
    wanted = materialize(of_lists.unionByName(of_groups), "wanted")
    more = screened(open_pairs(wanted, placed, percent), facts, percent, done=star)
    links = materialize(links.unionByName(verify(more, pair_texts(base, signed, more), words, percent)), "all_links")

    named = components(links).withColumnRenamed("node", "row")
    whole = entities.join(named, "row", "left").withColumn("root", F.coalesce("root", "row"))
    ids = whole.groupBy("root").agg(F.min("keep").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    settled = lookup_join(whole.select("root", "digest", "copies"), materialize(ids, "ids"), "root", "_n", F.col("digest"))
    settled = materialize(settled.select("digest", "copies", "component_id", "root"), "settled")
    out = lookup_join(filled.select("row", "doc_id", "text_hash", "n", "digest"), settled, "digest", "copies", F.col("row"))
    lone = signed.where("n = 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("row").alias("component_row"))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id", F.col("root").alias("component_row")).unionByName(lone)


def short_prefix(n: Column, percent: int) -> Column:
    """Elements to look at for partners at least as large: their overlap is 2p/(100+p) of n at least."""
    return n - F.ceil(n * (2 * percent) / F.lit(100 + percent)) + 1


def size_runs(entries: DataFrame, percent: int) -> DataFrame:
    """list (element, run), lead, short: entries (element, lead, size_short: twice the size, and 1 for a short prefix) of an element in runs of sizes
    that follow each other closely enough to link.

    A run has two entries at least, and one with a short prefix that is no larger than some other.
    """
    n, short = F.shiftright("size_short", 1), F.col("size_short") % 2 == 1
    order = Window.partitionBy("element").orderBy("size_short", "lead")
    far = F.lag(n).over(order) * 100 < n * percent
    ran = entries.withColumn("far", F.coalesce(far.cast("long"), F.lit(0)))
    ran = ran.withColumn("run", F.sum("far").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("element", "run")
    counted = ran.withColumn("least", F.min(F.when(short, n)).over(whole)).where(short | (n >= F.col("least")))
    counted = counted.withColumn("_c", F.count(F.lit(1)).over(whole)).where("_c > 1")
    return counted.select(F.struct("element", "run").alias("list"), "lead", short.alias("short"))


def screened(pairs: DataFrame, facts: DataFrame, percent: int, done: DataFrame | None = None) -> DataFrame:
    """Pairs that pass the filters; facts has n, maps and wide of every row. Pairs in done are left out."""
    if done is not None:
        pairs = pairs.join(done, ["a", "b"], "left_anti")
    for side in ("a", "b"):
        other = "b" if side == "a" else "a"
        counted = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("_n"))
        known = counted.join(facts.select(F.col("row").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("n", "maps", "wide"))), side)
        pairs = materialize(lookup_join(pairs, materialize(known, "known"), side, "_n", F.col(other)).drop("_n"), "screen")
    return materialize(pairs.where(passes(percent)).where(passes_wide(percent)).select("a", "b"), "screened")


def pair_texts(base: DataFrame, signed: DataFrame, pairs: DataFrame) -> DataFrame:
    """row and text of the rows in pairs, matched by doc_id and text hash. A bit table of fixed size (2^22 bits) keeps most other texts out of the join."""
    needed_rows = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    named = signed.select("row", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    wanted = materialize(named.join(needed_rows, "row"), "wanted_texts")
    word = F.pmod("text_hash", F.lit(1 << 16)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright("text_hash", 20), F.lit(64)).cast("int"))
    table = wanted.withColumnRenamed("_hash", "text_hash").groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    likely = base.withColumn("_word", word).join(F.broadcast(table), "_word").where(F.col("_bits").bitwiseAND(bit) != 0)
    found = likely.select("doc_id", "text_hash", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    return materialize(found.select("row", "text").dropDuplicates(["row"]), "texts")


def open_pairs(wanted: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of rows of different components that share a list, in blocks. wanted: list, lead, short; placed: rows with lead, root, n and maps.

    Only rows outside a list's largest component are met with its others.
    """
    leads = placed.groupBy("lead").agg(F.count(F.lit(1)).alias("_n"), F.min("root").alias("low"), F.max("root").alias("high"))
    spans = wanted.join(leads, "lead").groupBy("list").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("_e"))
    spans = materialize(spans.where("low <> high AND rows > 2"), "spans")
    left_over = lookup_join(wanted, spans.select("list", "rows", "_e"), "list", "_e", F.col("lead")).drop("_e")
    left_over = materialize(left_over, "left_over")
    crowd = placed.select("row", "lead", "root", "n", "maps").join(left_over.groupBy("lead").agg(F.count(F.lit(1)).alias("_c")), "lead")
    crowd = materialize(crowd.withColumn("part", F.pmod(F.xxhash64("row"), F.ceil(F.count(F.lit(1)).over(Window.partitionBy("lead")) / F.lit(BLOCK)).cast("int"))), "crowd")
    packs = crowd.groupBy("lead", "part").agg(F.collect_list(F.struct("row", "root", "n", "maps")).alias("all"), F.max("_c").alias("_c"))
    parts = crowd.groupBy("lead").agg(F.max("part").alias("last"), F.max("_c").alias("_c"))
    spread = lookup_join(left_over, materialize(parts, "parts"), "lead", "_c", F.col("list")).drop("_c").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("last").cast("int"))))
    packs = packs.select(F.struct("lead", F.col("part").cast("int").alias("part")).alias("pack"), "all", "_c")
    full = lookup_join(spread.select(F.struct("lead", "part").alias("pack"), "list", "rows", "short"), materialize(packs, "packs"), "pack", "_c", F.col("list"))
    full = materialize(full.select("list", "rows", "short", F.explode("all").alias("x")).select("list", "rows", "short", "x.*"), "full")
    main = full.groupBy("list", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("list").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("_c"))
    told = lookup_join(full, materialize(main, "main"), "list", "_c", F.col("row"))
    blocks = F.ceil(F.col("rows") / F.lit(BLOCK)).cast("int")
    named = lambda side: [F.col(c).alias(f"{c}_{side}") for c in ("root", "n", "maps", "short")]
    right = told.select("list", F.pmod(F.xxhash64("row"), blocks).cast("int").alias("block"), F.col("row").alias("b"), (F.col("root") != F.col("main")).alias("rest_b"), *named("b"))
    left = told.where("root <> main").select("list", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("row").alias("a"), *named("a"))
    led = (F.col("short_a") & (F.col("n_a") <= F.col("n_b"))) | (F.col("short_b") & (F.col("n_b") <= F.col("n_a")))
    once = ~F.col("rest_b") | (F.col("a") < F.col("b"))
    met = left.join(right, (left["list"] == right["list"]) & (left["block"] == right["block"]) & (F.col("root_a") != F.col("root_b")) & once & led & passes(percent))
    pairs = met.select(F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).alias("p")).groupBy("p").count().select("p.*")
    return materialize(pairs, "open")
