"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Texts and benchmark items become words (letters and digits, lower case). Each fixed mask hashes the words at its set
places and ignores the others, so a substituted word under a zero spoils nothing. The masks together meet every pattern of
two misses or fewer in ``REGION`` = 12 words, wherever they stand. Hashes of all places of all texts are looked up among
those of the items; around each hit all stretches of 12 words that hold the start of the seed, before and behind it, are
compared on the same diagonal, and the hit counts if at least ``MIN_MATCH`` words of one agree (80 % for a shorter item,
all of which is compared). Equal hashes of unequal words are sorted out by that comparison.

The seeds of the items are broadcast in blocks of at most ``BLOCK_WORDS`` words (checked by counting), one pass over the
texts per block, so nothing of unproven size is broadcast. An item of more than ``PIECE`` words is cut into pieces first;
each seed belongs to one piece, which holds all words that are compared around it, and lengths are those of the whole item,
so the cut changes no result. The texts are never shuffled; what is shuffled is one partial count per text and item.

Nulls: null texts and items have no words; a null id of a text or an item is an id like any other. Items shorter than the
shortest mask are looked up by no seed and find nothing. Repeated rows of texts count as one (the result has a row per id
and item), and so do repeated items; ties cannot occur, as the largest number of agreeing words is returned. Empty tables
give no rows. Very long texts are read whole, place by place. Other columns are not read by ``find_leaks`` and are passed
through by ``apply``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from streetflow.llm import scratch
from streetflow.llm.names import prefix

# The masks.
MASKS = ("1111111", "110110111", "10110011011", "11110111", "1011101011", "1101001111")
REGION, MIN_MATCH, BLOCK_WORDS, PIECE = 12, 10, 50_000, 2_000
#: Places around a seed that a stretch of REGION words with the seed inside can reach.
BEFORE = REGION - min(map(len, MASKS))
AROUND = range(-BEFORE, REGION)
SPLIT = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Words of a text; the first and the last may be empty, which equals no word of an item."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT)


def _places(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def _hash(array: str, at: Column, size: Column, number: int) -> Column:
    """Hash of a mask laid at a place, null where it does not fit."""
    mask = MASKS[number]
    picked = [F.get(F.col(array), at + o) for o in _places(mask)]
    return F.when(at + len(mask) <= size, F.xxhash64(F.lit(number), *picked))


#: The places that all masks set.
COMMON = sorted(set.intersection(*(set(_places(m)) for m in MASKS)))


def _common(array: str) -> Column:
    return F.xxhash64(*(F.get(F.col(array), F.col("at") + o) for o in COMMON)).alias("common")


def _placed(df: DataFrame, array: str) -> DataFrame:
    """A row per place, with the hash of the words that all masks look at."""
    size = F.size(array)
    # No filter on the size: it would be pushed below the split and have every text split twice.
    last = F.greatest(size - min(map(len, MASKS)), F.lit(0))
    return df.select("*", F.explode(F.sequence(F.lit(0), last)).alias("at")).select("*", _common(array))


def _seeded(placed: DataFrame, array: str) -> DataFrame:
    """A row per place and mask that fits: at, hash."""
    size = F.size(array)
    hashes = F.array(*(_hash(array, F.col("at"), size, k) for k in range(len(MASKS))))
    return placed.select("*", F.explode(hashes).alias("hash")).where(F.col("hash").isNotNull())


def _pieces(items: DataFrame) -> DataFrame:
    """Items as pieces of bounded length: words, the place of the first one in the item, the seeds that are the piece's
    own (from low to below high, places in the item), and the size of the item."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("all") - 1), F.lit(PIECE))
    cut = items.select("item_id", "all", F.explode(starts).alias("low"))
    offset = F.greatest(F.lit(0), F.col("low") - BEFORE)
    return cut.select(
        "item_id", F.slice("all", offset + 1, F.lit(PIECE + BEFORE + 2 * REGION)).alias("item"), offset.alias("offset"),
        "low", (F.col("low") + PIECE).alias("high"), F.size("all").alias("whole"),
    )


def _blocks(pieces: DataFrame) -> DataFrame:
    """pieces with a block number, each block at most BLOCK_WORDS words (partitions are cut into blocks of their own)."""
    own = F.spark_partition_id()
    numbered = pieces.withColumn("part", own).withColumn("id", F.monotonically_increasing_id())
    before = F.sum(F.size("item")).over(W.partitionBy("part").orderBy("id").rowsBetween(W.unboundedPreceding, 0))
    return numbered.withColumn("block", F.struct("part", F.floor(before / (BLOCK_WORDS - 2 * PIECE)).alias("n"))).drop("id", "part")


def _hits(texts: DataFrame, pieces: DataFrame) -> DataFrame:
    seed = F.col("offset") + F.col("at")
    places = _placed(pieces, "item").where((seed >= F.col("low")) & (seed < F.col("high")))
    seeds = _seeded(places, "item").select(
        "hash", "item_id", "whole", F.array(*(F.get("item", F.col("at") + o) for o in AROUND)).alias("around")
    ).distinct()
    # A third of a mask's words decides for most places of a text that no mask can match there.
    maybe = _placed(texts, "words").join(F.broadcast(places.select("common").distinct()), "common", "left_semi")
    found = _seeded(maybe, "words").join(F.broadcast(seeds), "hash")
    # Written out per word: a lambda would end code generation, and the rows before the join would be built one by one.
    same = [(F.get("words", F.col("at") + o) == F.get("around", F.lit(k))) for k, o in enumerate(AROUND)]
    found = found.select("doc_id", "item_id", "whole", *(F.coalesce(x.cast("int"), F.lit(0)).alias(f"same{k}") for k, x in enumerate(same)))
    total = lambda a, b: sum((F.col(f"same{k}") for k in range(a + 1, b)), F.col(f"same{a}"))
    windows = F.greatest(*(total(k, k + REGION) for k in range(BEFORE + 1)))
    short = F.col("whole") < REGION
    need = F.when(short, F.ceil(F.col("whole") * 4 / 5).cast("int")).otherwise(F.lit(MIN_MATCH))
    return (
        found.select("doc_id", "item_id", F.when(short, total(0, len(AROUND))).otherwise(windows).alias("same"), need.alias("need"))
        .where("same >= need")
        .groupBy("doc_id", "item_id")
        .agg(F.max("same").cast("long").alias("best"))
    )


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, best (words that agree in the best region): texts that hold part of a benchmark item."""
    texts = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("words"))
    bench = items.select(F.col(item_col).alias("item_id"), F.filter(words(F.col(item_text_col)), lambda x: x != "").alias("all"))
    size = bench.agg(F.coalesce(F.sum(F.size("all")), F.lit(0))).first()[0]
    pieces = _pieces(bench)
    if size <= BLOCK_WORDS:
        return _hits(texts, pieces)
    blocks = _blocks(pieces)
    numbers = [r.block for r in blocks.select("block").distinct().collect()]
    out = None
    for b in numbers:
        mine = blocks.where((F.col("block.part") == b.part) & (F.col("block.n") == b.n))
        found = _hits(texts, mine)
        out = found if out is None else out.union(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))


def apply(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that leak. A row without id goes if any row without id leaks."""
    bad = prefix(docs) + "bad"
    found = find_leaks(docs, items, id_col, text_col).select(F.col("doc_id").alias(bad)).distinct()
    return docs.join(scratch.broadcast_if_small(found, "leaks"), F.col(id_col).eqNullSafe(F.col(bad)), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: documents that hold part of a benchmark item."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return find_leaks(read("documents"), read("benchmark"))


def _oracle() -> str:
    def key(array, at, k):
        return f"'{k}' || " + " || ' ' || ".join(f"{array}[{at} + {o + 1}]" for o in _places(MASKS[k]))

    def seeds(table, cols, array):
        return " union all ".join(
            f"select {cols}, pos, {key(array, 'pos', k)} as seed from {table}, range(len({array})) r(pos) where pos + {len(m)} <= len({array})"
            for k, m in enumerate(MASKS)
        )

    split = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    return f"""
with d as (select doc_id, {split} as w from documents),
b as (select item_id, {split} as i from benchmark),
ds as ({seeds('d', 'doc_id, w', 'w')}),
bs as ({seeds('b', 'item_id, i', 'i')}),
h as (select distinct doc_id, item_id, w, i, ds.pos - bs.pos as shift, bs.pos as s from ds join bs using (seed)),
f as (select *, unnest(range(greatest(0, s - {BEFORE}), greatest(0, least(s, len(i) - {REGION})) + 1)) as f from h),
v as (select doc_id, item_id, len(list_filter(range(least({REGION}, len(i))), lambda k:
        shift + f + k >= 0 and w[case when shift + f + k >= 0 then shift + f + k + 1 else 1000000000 end] = i[f + k + 1])) as same,
        case when len(i) >= {REGION} then {MIN_MATCH} else cast(ceil(len(i) * 4 / 5.0) as int) end as need from f)
select doc_id, item_id, cast(max(same) as bigint) as best from v where same >= need group by doc_id, item_id
"""


ORACLE = _oracle()
