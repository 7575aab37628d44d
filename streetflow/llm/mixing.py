"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

Documents are leaves of a tree domain > language > source. A leaf can give its words times ``MAX_EPOCHS``; a node can give
the sum of its leaves. The budget goes down the tree: the children of a node share its budget by their weights; a child
that can give less than its share gives all it has, and what is missing goes to its siblings by their weights again. Only
what all children together cannot give returns to the level above, where it goes to the siblings of the node. As a
node's share never exceeds what it can give, one pass from the root does this exactly. All amounts are whole numbers;
what rounding leaves over (less than one word per child) goes to no one.

A leaf that is granted A of its T words gives each document ``A div T`` whole epochs and fills the rest from the next
epoch: its documents in the order of an md5 of seed, epoch, id and text, as long as their running total fits. The running
total is built from 4096 hash buckets per leaf, so a leaf with a third of all rows is ordered in small pieces.

Nulls: a null language or source is the leaf named ``''``; a null text has no words; a document without words is never
selected. Weights that are not given are 1; a weight of 0 gives its branch nothing. Repeated rows are selected each for
itself. All other columns are passed through; input columns named domain, n_words or epochs give way to the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from streetflow.llm import scratch
from streetflow.llm.names import prefix

MAX_EPOCHS, SEED = 4, 17
LEVELS = ("domain", "language", "src")
#: Parts of the budget per hundred words of the corpus.
BUDGET_PERCENT = 100
#: Weights of domains and languages of the query.
DOMAIN_WEIGHTS = {"web": 4, "books": 3, "forum": 2, "code": 1}
LANGUAGE_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}


def domain(source: Column) -> Column:
    """Domain of a source: by its number modulo four."""
    number = F.coalesce(F.try_to_number(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("999999999")).cast("int"), F.lit(0))
    names = F.array(*(F.lit(x) for x in DOMAIN_WEIGHTS))
    return F.get(names, number % len(DOMAIN_WEIGHTS))


def count_words(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    empty = (F.element_at(parts, 1) == "").cast("int") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return (F.size(parts) - empty).cast("long")


def _weight(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(1).cast("long")
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(w).cast("long")).otherwise(out)
    return out


def share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """children (parent columns, name, cap, weight, budget of the parent) with ``grant``.

    With the children in order of cap / weight, a child is full if granting every later child the same level would cost
    no more than the budget. The full ones get their cap, the others share the rest by weight.
    """
    order = W.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), name)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy(*parent)
    c = children.where("weight > 0")
    c = c.withColumn("__before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("__weights", F.sum("weight").over(after))
    c = c.withColumn(
        "__full", F.expr("cast(cap as decimal(38)) * __weights <= cast(weight as decimal(38)) * (budget - __before)")
    )
    c = c.withColumn("__taken", F.coalesce(F.sum(F.when(F.col("__full"), F.col("cap"))).over(whole), F.lit(0)))
    c = c.withColumn("__open", F.sum(F.when(~F.col("__full"), F.col("weight"))).over(whole))
    grant = F.when(F.col("__full"), F.col("cap")).otherwise(F.expr("(budget - __taken) * weight div __open"))
    return c.withColumn("grant", grant.cast("long")).drop("__before", "__weights", "__full", "__taken", "__open")


def budgets(leaves: DataFrame, percent: int, epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """leaves (domain, language, src, words) with ``grant``: the words that each leaf gives."""
    leaves = leaves.withColumn("cap", F.col("words") * epochs)
    for level in LEVELS:
        leaves = leaves.withColumn(f"w_{level}", _weight(level, weights.get(level, {})))
    # A branch whose leaves all have weight 0 can give nothing, so the capacity of such leaves does not count.
    positive = leaves.where(" and ".join(f"w_{x} > 0" for x in LEVELS))
    total = leaves.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("all"))
    top = positive.agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("can")).crossJoin(total)
    now = top.select(F.least(F.col("can"), F.expr(f"all * {percent} div 100")).alias("grant"))
    for depth, level in enumerate(LEVELS):
        parent, path = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        nodes = positive.groupBy(*path, F.col(f"w_{level}").alias("weight")).agg(F.sum("cap").alias("cap"))
        up = now.withColumnRenamed("grant", "budget")
        nodes = nodes.join(up, parent) if parent else nodes.crossJoin(F.broadcast(up))
        now = share(nodes, parent, level).select(*path, "grant")
    return leaves.select(*LEVELS, "words").join(now, list(LEVELS), "left").withColumn("grant", F.coalesce("grant", F.lit(0)))


def mix(
    docs: DataFrame, percent: int = BUDGET_PERCENT, epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id",
    text_col: str = "text", lang_col: str = "lang", source_col: str = "source", weights: dict | None = None,
    domain_of=domain,
) -> DataFrame:
    """The selected documents: all columns, and domain, n_words, epochs (how often the document is read)."""
    weights = {"domain": DOMAIN_WEIGHTS, "language": LANGUAGE_WEIGHTS} if weights is None else weights
    source = F.coalesce(F.col(source_col), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    p = prefix(docs)
    rows = docs.select(
        "*", domain_of(source).alias(f"{p}domain"), F.coalesce(F.col(lang_col), F.lit("")).alias(f"{p}language"),
        source.alias(f"{p}src"), count_words(F.col(text_col)).alias(f"{p}words"),
        F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text)).alias(f"{p}tag"),
    )
    leaf = [f"{p}{x}" for x in LEVELS]
    # Written once without the texts: all sums come from these rows, so the words are counted here and once below.
    narrow = scratch.stage(rows.select(*(f"{p}{x}" for x in (*LEVELS, "words", "tag"))), "narrow")
    leaves = narrow.groupBy(*(F.col(f"{p}{x}").alias(x) for x in LEVELS)).agg(F.sum(f"{p}words").alias("words"))
    granted = budgets(scratch.stage(leaves, "leaves"), percent, epochs, weights).where("words > 0")
    granted = granted.select(
        *(F.col(x).alias(f"{p}{x}") for x in LEVELS),
        F.expr("grant div words").alias(f"{p}whole"),
        F.expr("grant % words").alias(f"{p}rest"),
    ).where(f"{p}whole > 0 or {p}rest > 0")
    granted = scratch.stage(granted, "granted")

    def place(df: DataFrame) -> DataFrame:
        """The order of the epoch that is filled in part; it differs by leaf, so the grant comes first."""
        tag = F.concat(F.lit(f"{seed}:"), F.col(f"{p}whole") + 1, F.lit(":"), F.col(f"{p}tag"))
        placed = df.join(granted, leaf).withColumn(f"{p}place", F.md5(tag)).drop(f"{p}tag")
        return placed.withColumn(f"{p}bucket", F.substring(f"{p}place", 1, 3))

    piece = [*leaf, f"{p}bucket"]
    sums = place(narrow).groupBy(*piece).agg(F.sum(f"{p}words").alias(f"{p}in"))
    run = W.partitionBy(*leaf).orderBy(f"{p}bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn(f"{p}before", F.coalesce(F.sum(f"{p}in").over(run), F.lit(0))).drop(f"{p}in")
    within = W.partitionBy(*piece).orderBy(f"{p}place").rowsBetween(W.unboundedPreceding, 0)
    placed = place(rows).withColumn(f"{p}upto", F.sum(f"{p}words").over(within)).join(sums, piece)
    times = F.col(f"{p}whole") + (F.col(f"{p}before") + F.col(f"{p}upto") <= F.col(f"{p}rest")).cast("int")
    return placed.withColumn(f"{p}epochs", times.cast("long")).where(
        f"{p}epochs > 0 and {p}words > 0"
    ).select(
        *(c for c in docs.columns if c.lower() not in ("domain", "n_words", "epochs")),
        F.col(f"{p}domain").alias("domain"),
        F.col(f"{p}words").alias("n_words"),
        F.col(f"{p}epochs").alias("epochs"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op10: which documents are read, and how often."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", "domain", "lang", "source", "n_words", "epochs")


def _oracle() -> str:
    def weight(col, weights):
        if not weights:
            return "1"
        return "case " + " ".join(f"when {col} = '{k}' then {v}" for k, v in weights.items()) + " else 1 end"

    def level(depth):
        path = ", ".join(LEVELS[: depth + 1])
        parent = ", ".join(LEVELS[:depth])
        part = f"partition by {parent}" if parent else ""
        name = LEVELS[depth]
        w = weight(name, {"domain": DOMAIN_WEIGHTS, "language": LANGUAGE_WEIGHTS}.get(name, {}))
        up = f"join g{depth} using ({parent})" if parent else "cross join g0"
        return f"""
n{depth} as (select {path}, {w} as weight, sum(words) * {MAX_EPOCHS} as cap from leaves group by all),
m{depth} as (select n{depth}.*, g{depth}.g as budget from n{depth} {up}),
o{depth} as (select *, coalesce(sum(cap) over (p rows between unbounded preceding and 1 preceding), 0) as b,
             sum(weight) over (p rows between current row and unbounded following) as ws
             from m{depth} window p as ({part} order by cast(cap as double) / weight, {name})),
p{depth} as (select *, cap * ws <= weight * (budget - b) as is_full from o{depth}),
g{depth + 1} as (select {path}, case when is_full then cap else ((budget - coalesce(sum(case when is_full then cap end) over ({part}), 0)) * weight)
             // sum(case when not is_full then weight end) over ({part}) end as g from p{depth})"""

    names = ", ".join(f"'{x}'" for x in DOMAIN_WEIGHTS)
    return f"""
with d as (
  select doc_id, lang, source, coalesce(lang, '') as language, coalesce(source, '') as src,
    ([{names}])[coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) as int), 0) % {len(DOMAIN_WEIGHTS)} + 1] as domain,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) as n_words,
    coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, '')) as tag
  from documents),
leaves as (select domain, language, src, sum(n_words) as words from d group by all),
g0 as (select least(sum(words) * {MAX_EPOCHS}, sum(words) * {BUDGET_PERCENT} // 100) as g from leaves),
{level(0)}, {level(1)}, {level(2)},
x as (select d.*, g // words as whole, g % words as rest from d join leaves using (domain, language, src)
      join g3 using (domain, language, src) where n_words > 0),
y as (select *, sum(n_words) over (partition by domain, language, src
        order by md5('{SEED}:' || cast(whole + 1 as bigint) || ':' || tag) rows between unbounded preceding and current row) as upto from x)
select doc_id, domain, lang, source, cast(n_words as bigint) as n_words,
       cast(whole + case when upto <= rest then 1 else 0 end as bigint) as epochs
from y where whole + case when upto <= rest then 1 else 0 end > 0
"""


ORACLE = _oracle()
