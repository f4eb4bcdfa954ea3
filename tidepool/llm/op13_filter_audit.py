"""Filter interaction audit by the Hart-Mas-Colell potential, DataFrame functions only.

Every document gets the set of the five filters it fails, as bits.  Within a part
(source) the removal game gives a coalition S of filters the number v(S) of documents
that fail at least one of S.  Its potential is defined by recursion over the coalitions,

    P(empty) = 0,    P(S) = (v(S) + sum of P(S without i) over i in S) / |S|,

and a filter's Shapley value is P(all) - P(all without it).  Scaled to whole numbers,
``Q(S) = |S|! P(S) = (|S| - 1)! v(S) + sum of Q(S without i)``, the sum of what a filter
removes over all 120 orders is ``Q(all) - 5 Q(all without it)``.  A step of an order that
applies i after the filters S removes v(S + i) - v(S); the same differences in the games
of good and of toxic documents give what is lost.

Filters (words are ``[^\\x20\\x09-\\x0D]+``): A under 200 words; B fewer distinct words than
half of the words; C more than 2 % of the code points in A-Z; D holds one of ``#$%&*|``;
E the same text as a row with a smaller id, wherever that row is and whether kept or not.

Cases: null text is empty; a null source is the part ``''``, together with an empty one; a
null id is larger than any id, so such a row repeats one with an id but not another without;
rows that share an id and a text don't repeat each other, each counts; of several labels of
an id, any quality or toxic 1 counts; a null id has no label; an empty table gives no rows.
Texts are compared by SHA-256.

Shuffled are (id, digest, part, bits), never text: by id to the labels (null ids by their
digest), and to the first row of each text.  Equal rows are counted before they move and the
rank of a text's rows has a partial limit in front of the shuffle, so a text that holds a
third of the rows costs a row per map task.  From the counts per (part, bits) on, sizes
depend on the number of parts alone.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import permutations
from math import factorial
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.llm.common import WS_RE, let, table, text_of

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
MIN_WORDS = 200
MIN_DISTINCT_PCT = 50
MAX_UPPER_PCT = 2
SYMBOLS_RE = "[#$%&*|]"
GAMES = ("n", "good", "toxic")


def failed_alone(text: Column) -> Column:
    """Bits of A to D, which depend on the text alone."""

    def bits(t: Column) -> Column:
        upper = F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))
        dense = F.when(100 * upper > MAX_UPPER_PCT * F.length(t), 4).otherwise(0)
        marks = F.when(t.rlike(SYMBOLS_RE), 8).otherwise(0)

        def words(w: Column) -> Column:
            n, distinct = F.size(w), F.size(F.array_distinct(w))
            return F.when(n < MIN_WORDS, 1).otherwise(0) + F.when(100 * distinct < MIN_DISTINCT_PCT * n, 2).otherwise(0)

        return let(F.filter(F.split(t, WS_RE), lambda w: w != ""), words) + dense + marks

    return let(text, bits)


def counts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, bits, n, good, toxic): documents by part and set of failed filters."""
    t = text_of(text)
    rows = docs.select(
        F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(t, 256)).alias("digest"), failed_alone(t).cast("byte").alias("alone"),
    )
    marks = labels.select(F.col("doc_id").alias("lid"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    marks = marks.where(F.col("lid").isNotNull()).groupBy(F.col("lid").cast("string").alias("lid")).agg(
        F.coalesce(F.bool_or("good"), F.lit(False)).alias("good"), F.coalesce(F.bool_or("toxic"), F.lit(False)).alias("toxic")
    )
    # rows without an id match nothing; dealt out by their digest and part, they don't meet in one task
    key = F.coalesce(F.col("id").cast("string"), F.concat(F.lit(" "), F.hex("digest"), F.col("part")))
    rows = rows.withColumn("key", key).join(marks, F.col("key") == F.col("lid"), "left")
    kinds = rows.groupBy("digest", "id", "part", "alone", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(
        F.count(F.lit(1)).alias("n")
    )
    game = lambda of: (
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"), F.lit(of).alias("first"),
    )
    first = F.rank().over(Window.partitionBy("digest").orderBy(F.col("id").asc_nulls_last()))
    firsts = kinds.withColumn("k", first).where("k = 1").groupBy("part", "alone").agg(*game(True))
    everything = kinds.groupBy("part", "alone").agg(*game(False))
    # a text's first rows pass E, all others fail it
    both = everything.unionByName(firsts).groupBy("part", "alone").pivot("first", [False, True]).agg(*[F.sum(g).alias(g) for g in GAMES])
    cells = lambda repeat: F.struct(
        (F.col("alone") + (16 if repeat else 0)).cast("int").alias("bits"),
        *[((F.col(f"false_{g}") - F.col(f"true_{g}")) if repeat else F.col(f"true_{g}")).alias(g) for g in GAMES],
    )
    whole = both.na.fill(0, [f"true_{g}" for g in GAMES])
    return whole.select("part", F.inline(F.array(cells(False), cells(True)))).where("n > 0")


def order_steps() -> list[dict]:
    """The 120 orders' steps: filter number, coalition before and after it."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[j] for j in order), 0
        for k, i in enumerate(order):
            steps.append({"filter_order": name, "step": k + 1, "i": i, "before": before, "after": before | 1 << i})
            before |= 1 << i
    return steps


def audit(cells: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step, from ``counts``."""
    fails = lambda s: F.col("bits").bitwiseAND(F.lit(s)) != 0
    games = cells.groupBy("part").agg(
        *[F.sum(F.when(fails(s), F.col(g)).otherwise(0)).alias(f"{g}{s}") for g in GAMES for s in range(ALL + 1)],
        *[F.sum(F.when(F.col("bits") == 1 << i, F.col("n")).otherwise(0)).alias(f"only{i}") for i in range(len(FILTERS))],
        F.sum("n").alias("total"),
    )
    # the recursion, one size of coalition at a time
    without = lambda s: [s ^ (1 << i) for i in range(len(FILTERS)) if s >> i & 1]
    games = games.withColumn("q0", F.lit(0).cast("long"))
    for size in range(1, len(FILTERS) + 1):
        games = games.withColumns({
            f"q{s}": reduce(add, [F.col(f"q{r}") for r in without(s)], factorial(size - 1) * F.col(f"n{s}"))
            for s in range(ALL + 1) if s.bit_count() == size
        })
    filters = F.array(*[
        F.struct(F.col(f"n{1 << i}").alias("fail"), F.col(f"only{i}").alias("only"),
                 (F.col(f"q{ALL}") - len(FILTERS) * F.col(f"q{ALL ^ 1 << i}")).alias("shapley"))
        for i in range(len(FILTERS))
    ])
    v = [F.array(*[F.col(f"{g}{s}") for s in range(ALL + 1)]).alias(g) for g in GAMES]
    steps = F.from_json(F.lit(json.dumps(order_steps())), "array<struct<filter_order:string,step:int,i:int,before:int,after:int>>")
    rows = games.select("part", "total", *v, filters.alias("filters")).select("*", F.inline(steps))
    gain = lambda g: F.get(F.col(g), F.col("after")) - F.get(F.col(g), F.col("before"))
    own = F.get(F.col("filters"), F.col("i"))
    return rows.select(
        "part", "filter_order", "step", (F.col("total") - F.get(F.col("n"), F.col("after"))).alias("kept"), gain("n").alias("removed"),
        (own["fail"] - gain("n")).alias("redundant"), own["only"].alias("unique_fails"),
        gain("good").alias("good_lost"), gain("toxic").alias("toxic_lost"), own["shapley"].alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


# every order walked document by document: no coalitions, no potential
OP13_SQL = """
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
f as (
  select d.doc_id, d.part,
    [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t),
     regexp_matches(t, '[#$%&*|]'), d.doc_id > min(d.doc_id) over (partition by t)] as fails,
    coalesce(l.quality = 1, false) as good, coalesce(l.toxic = 1, false) as toxic
  from d left join labels l on l.doc_id = d.doc_id),
letters as (select unnest(range(1, 6)) as i, unnest(['A', 'B', 'C', 'D', 'E']) as c),
orders as (
  select a.c || b.c || c.c || d.c || e.c as filter_order, [a.i, b.i, c.i, d.i, e.i] as o
  from letters a, letters b, letters c, letters d, letters e
  where b.i <> a.i and c.i not in (a.i, b.i) and d.i not in (a.i, b.i, c.i) and e.i not in (a.i, b.i, c.i, d.i)),
g as (select part, fails, count(*) as n, count_if(good) as good, count_if(toxic) as toxic from f group by part, fails),
walked as (
  select part, filter_order, step, o[step] as i, n, good, toxic, fails[o[step]] as fails_it,
    len(list_filter(o[1 : step - 1], lambda x: fails[x])) > 0 as gone, len(list_filter(fails, lambda x: x)) as n_fails
  from g, orders, (select unnest(range(1, 6)) as step)),
steps as (
  select part, filter_order, step, i,
    sum(case when not gone and not fails_it then n else 0 end) as kept, sum(case when fails_it and not gone then n else 0 end) as removed,
    sum(case when fails_it and gone then n else 0 end) as redundant, sum(case when fails_it and n_fails = 1 then n else 0 end) as unique_fails,
    sum(case when fails_it and not gone then good else 0 end) as good_lost, sum(case when fails_it and not gone then toxic else 0 end) as toxic_lost
  from walked group by part, filter_order, step, i)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
  cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
  cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, i) as bigint) as shapley
from steps
"""
