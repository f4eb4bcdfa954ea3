"""Mixing sources to target weights by entropy balancing, DataFrame functions only.

Each source gets a token target.  Document rates solve, per source, the entropy
balancing problem

    min  sum_d  w_d log w_d - w_d      s.t.  sum_d w_d size_d = target,  0 <= w_d <= 2

whose solution is an exponential tilt by size, ``w_d = min(2, exp(lambda_s x_d))``
with ``x_d = size_d / mean size of the source``.  The convex dual has one unknown
per source; safeguarded Newton steps for all sources run as one aggregation over
the (source, size) cells per iteration.  Rates become copies by systematic
rounding along the sizes of a source: the rounding errors telescope, so a source's
total stays within about its largest document of its target.

Cases: null text has size 0, takes nothing and is returned; a null source is a
source of its own, last in order; repeated rows are documents of their own (equal
rows may get different copies); an empty table gives an empty result; a source
without words has target 0.  Reruns agree: sums over cells are exact decimals, and
ties in rank are broken by id and by a digest of the text, which leaves equal rows only.

Shuffles carry (id, digest, source, size), never text.  A cell that holds most rows (documents
of one size) is ranked in parts, salted by id and text, so that rows without an id are parted, too.  The tables of sources and of sizes per
source are small beside the documents: one row per source, one per distinct size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.llm.common import WS_RE, stored, table, text_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
NEWTON_STEPS = 40
TOLERANCE = 1e-9
LOOSEST = 1e-3  # relative gap to a target that is an error after the last step
SALTS = 1024
OFFSETS = 32
EXACT = "decimal(38,12)"


def n_words(text: Column) -> Column:
    """Number of words; split leaves an empty piece at either end at most."""
    parts = F.split(text, WS_RE)
    return (
        F.size(parts) - F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)
        - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    ).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row per source.

    Targets are ``min(2 size, theta weight)`` with one theta for all: sharing the
    excess by weight among those below their cap ends there.  Sources are capped in
    ascending order of cap per weight, so theta follows from prefix sums.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)
    cap = F.col("source_size") * float(MAX_COPIES)
    ranked = sizes.withColumn("weight", weight).withColumn("ratio", cap / F.col("weight"))
    total = F.sum("source_size").over(whole) * SHARE
    capped = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * float(MAX_COPIES)
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # theta if exactly the sources before this one are capped; the first that it leaves uncapped fixes it
    theta = (total - capped) / weight_left
    fixed = ranked.withColumn("theta", theta).withColumn("free", F.col("theta") <= F.col("ratio"))
    theta_all = F.min(F.when(F.col("free"), F.struct("ratio", "theta"))).over(whole)["theta"]
    return fixed.withColumn("theta_all", theta_all).select(
        "source", "source_size",
        F.least(cap, F.coalesce(F.col("theta_all") * F.col("weight"), cap)).alias("target"),
    )


def tilt_rates(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """Cells (source, size, n) with their rate, by Newton on the dual of each source."""
    x = F.col("size") / F.col("mean")
    rate = F.least(F.lit(float(MAX_COPIES)), F.exp(F.least(F.col("lam") * x, F.lit(50.0))))
    inner = F.col("lam") * x < F.log(F.lit(float(MAX_COPIES)))

    means = cells.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    # only words count: cells of size 0 take nothing whatever their rate
    base = stored(
        cells.filter("size > 0").join(means, cells["source"].eqNullSafe(means["source"])).drop(means["source"])
        .join(targets.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2"), "mix-cells",
    )
    # sources whose target is their cap take every document MAX_COPIES times: nothing to solve
    full = F.col("target") >= F.col("source_size") * float(MAX_COPIES)
    everything = base.filter(full).select("source", "size", "n", F.lit(float(MAX_COPIES)).alias("rate"))
    base = base.filter(~full)
    state = base.groupBy("source").agg(
        F.first(F.log(F.col("target") / F.col("source_size"))).alias("lam"), F.lit(-60.0).alias("low"), F.lit(60.0).alias("high"),
    )
    for step in range(NEWTON_STEPS):
        now = base.join(state.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
        sums = now.groupBy("source").agg(
            F.first("lam").alias("lam"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("target").alias("target"),
            F.sum((F.col("n") * F.col("size") * rate).cast(EXACT)).cast("double").alias("taken"),
            F.sum(F.when(inner, F.col("n") * F.col("size") * x * rate).otherwise(0.0).cast(EXACT)).cast("double").alias("slope"),
        )
        over = F.col("taken") > F.col("target")
        moved = sums.withColumn("high", F.when(over, F.col("lam")).otherwise(F.col("high"))).withColumn(
            "low", F.when(over, F.col("low")).otherwise(F.col("lam"))
        )
        newton = F.col("lam") - (F.col("taken") - F.col("target")) / F.col("slope")
        # a step that leaves the bracket (flat or kinked dual) is replaced by halving it
        good = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        gap = F.abs(F.col("taken") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0))
        state = stored(
            moved.select(
                "source", "low", "high", gap.alias("gap"),
                F.when(gap <= TOLERANCE, F.col("lam")).when(good, newton).otherwise((F.col("low") + F.col("high")) / 2).alias("lam"),
            ), f"mix-state{step}",
        )
        worst = state.agg(F.max("gap")).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
    else:
        if not worst <= LOOSEST:
            raise RuntimeError(f"entropy balancing did not settle in {NEWTON_STEPS} steps: a source is {worst:.2g} off its target")
    solved = base.join(state.select(F.col("source").alias("s2"), "lam"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    return solved.select("source", "size", "n", rate.alias("rate")).unionByName(everything)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken), one row per document row."""
    rows = stored(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text_of(text_col)).alias("size"),
                    F.xxhash64(id_col, text_col).alias("mark")), "mix-sizes"
    )
    cells = stored(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-hist")
    targets = stored(source_targets(cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))), "mix-targets")
    rates = tilt_rates(cells, targets)

    # extra copies: along the sizes of a source, one wherever the running sum of the rates' fractions passes a whole number
    along = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    frac = (F.col("rate") - F.floor("rate")).cast("decimal(20,12)")
    cuts = rates.withColumn("frac", frac).withColumn(
        "start", F.coalesce(F.sum((F.col("frac") * F.col("n").cast("decimal(12,0)")).cast(EXACT)).over(along), F.lit(0).cast(EXACT))
    )
    cuts = stored(cuts, "mix-cuts")
    offset = F.explode(F.array(*[F.lit(k / OFFSETS).cast("decimal(10,8)") for k in range(OFFSETS)])).alias("offset")
    end = F.col("start") + F.col("frac") * F.col("n").cast("decimal(12,0)")
    extra = F.floor(end + F.col("offset")) - F.floor(F.col("start") + F.col("offset"))
    tried = cuts.select("*", offset).groupBy("source", "offset").agg(
        F.sum(F.col("size") * (F.floor("rate") * F.col("n") + extra)).alias("would_take")
    )
    o = tried.select(F.col("source").alias("s2"), "offset", "would_take")
    best = o.join(targets, F.col("s2").eqNullSafe(F.col("source"))).groupBy("source").agg(
        F.min(F.struct(F.abs(F.col("would_take") - F.col("target")), "offset"))["offset"].alias("offset")
    ).withColumnRenamed("source", "s2")
    cuts = cuts.join(best, F.col("source").eqNullSafe(F.col("s2"))).select(
        F.col("source").alias("s3"), F.col("size").alias("z3"), "frac", (F.col("start") + F.col("offset")).alias("start"), "rate"
    )

    # rank of each document in its (source, size) cell, in salted parts so that no task holds a hot cell
    salted = rows.withColumn("salt", F.pmod("mark", F.lit(SALTS)))
    salts = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = salted.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("k")).withColumn(
        "before", F.coalesce(F.sum("k").over(salts), F.lit(0))
    )
    rank = F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("doc_id", "mark")) - 1
    ranked = salted.withColumn("in_part", rank)
    p = parts.select(F.col("source").alias("s4"), F.col("size").alias("z4"), F.col("salt").alias("t4"), "before")
    ranked = ranked.join(p, ranked["source"].eqNullSafe(p["s4"]) & (ranked["size"] == p["z4"]) & (ranked["salt"] == p["t4"]))
    placed = ranked.join(cuts, ranked["source"].eqNullSafe(cuts["s3"]) & (ranked["size"] == cuts["z3"]), "left")

    at = lambda k: F.floor(F.col("start") + F.col("frac") * (F.col("before") + F.col("in_part") + k).cast("decimal(12,0)"))
    copies = F.coalesce((F.floor("rate") + at(1) - at(0)).cast("long"), F.lit(0))
    own = targets.select(F.col("source").alias("s5"), F.col("source_size").alias("ss"), F.col("target").alias("tt"))
    return (
        placed.withColumn("copies", F.least(copies, F.lit(MAX_COPIES)).cast("long"))
        .join(own, F.col("source").eqNullSafe(F.col("s5")))
        .select("doc_id", "source", "size", F.col("ss").cast("long").alias("source_size"), F.col("tt").alias("target"), "rate", "copies",
                (F.col("copies") * F.col("size")).alias("taken"))
    )


def op10_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
