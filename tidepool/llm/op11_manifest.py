"""Merkle dataset manifest: built levels as parent-linked node rows, climbed by a recursive query.

A leaf is the digest of a document's fields.  Per language, leaves in order of id are
the lowest level; while a level has several nodes, every 8 consecutive ones become one
node above.  The subroots, in order of language, are the leaves of the tree on top.
A node row holds the digests of its run and the place it has in its own parent's run.
To check documents, a recursive SQL query starts from every leaf with the digest that
the document has now; each round joins it to its parent's row, appends the run's other
digests to the proof and folds its own digest in among them; at the root, the folded
digest is held against the stored one.

``H`` is the lowercase hex SHA-256 of its inputs, concatenated (digests as hex text).
Digests are stored as 32 bytes.

Cases: null fields are ``-`` in the leaf; a null language is a tree of its own, first in
order; null ids come first in their tree and are never tampered with; rows that share an
id are ordered by their leaf, equal rows get the same digests; an empty table gives an
empty manifest; a single leaf or subroot is its own root with an empty proof.

Scale: ranks come from a range partitioning by (language, id, leaf, row), so a language
with a third of the rows, or one id with many, is many parts.  Levels shrink by 8.  A
climbing row would meet all others at the root; node rows above the level that spans
``BLOCK`` leaves are therefore repeated per block of leaves, and rows are joined by
block, so no key has more than ``BLOCK`` rows.  Each round adds one row per leaf with
the digests of that level alone; they are put together once, at the end.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.llm.common import stored, table

ARITY_BITS = 3  # 8 children a node
BLOCK_LEVEL = 5  # nodes of this level span 8^5 leaves
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """UTF-8 byte count, colon, value; ``-`` for null."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def sha(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def hexed(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def leaf_digest(**changed: Column) -> Column:
    """The digest of a document's fields, some of them ``changed``."""
    return sha(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, tampered) of every document; ``tampered`` is null where nothing was changed."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = leaf_digest(text=F.translate(F.col("text"), UPPER, LOWER))
    return docs.select("doc_id", "lang", leaf_digest().alias("leaf"), F.when(hit, lowered).alias("tampered"))


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their rank (``idx``, from 0) in their ``tree``, in ``order``.

    The written parts of a range partitioning are numbered, and a tree's ranks go on
    from part to part: sums over one row per (tree, part), not over rows.
    """
    place = F.monotonically_increasing_id()  # part number, then the row's number in the part
    parted = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("place", place)
    parted = stored(parted, name).withColumn("part", F.shiftright("place", 33))
    per_part = parted.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("k"), F.min("place").alias("first"))
    before = F.sum("k").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = per_part.select("tree", "part", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return parted.join(starts, ["tree", "part"]).withColumn("idx", F.col("before") + F.col("place") - F.col("first")).drop(
        "place", "part", "first", "before"
    )


def levels(bottom: DataFrame, name: str) -> list[DataFrame]:
    """The tables (tree, idx, digest, run) above ``bottom`` (tree, idx, digest), one per level, lowest first.

    A tree takes part until it has one node left.
    """
    out, below = [], bottom
    widest = bottom.groupBy("tree").agg((F.max("idx") + 1).alias("n"))
    n = widest.agg(F.max("n").alias("n")).collect()[0]["n"] or 0
    while n > 1:
        # with one node of a tree left there is nothing to group: its idx is 0 and it has no sibling
        run = F.array_sort(F.collect_list(F.struct("idx", "digest")))
        up = below.groupBy("tree", F.shiftright("idx", ARITY_BITS).alias("up")).agg(run.alias("run"), F.count(F.lit(1)).alias("k"))
        alone = (F.col("up") == 0) & (F.col("k") == 1)
        joined = F.unhex(F.concat_ws("", F.transform("run", lambda r: F.hex(r["digest"]))))
        up = up.where(~alone).select("tree", F.col("up").alias("idx"), joined.alias("run"))
        below = stored(up.select("tree", "idx", sha(hexed(F.col("run"))).alias("digest"), "run"), f"{name}-{len(out) + 1}")
        out.append(below)
        n = (n + 7) >> ARITY_BITS
    return out


def roots(bottom: DataFrame, above: list[DataFrame]) -> DataFrame:
    """(tree, n, height, root): leaves, levels above them and root digest of every tree."""
    size = bottom.groupBy("tree").agg((F.max("idx") + 1).alias("n"))
    height = F.lit(0)
    for k in range(len(above)):
        height = height + F.when(F.col("n") > (1 << ARITY_BITS * k), 1).otherwise(0)
    nodes = bottom.select("tree", "idx", "digest", F.lit(0).alias("level"))
    for k, df in enumerate(above):
        nodes = nodes.unionByName(df.select("tree", "idx", "digest", F.lit(k + 1).alias("level")))
    tops = nodes.where("idx = 0").select("tree", "level", F.col("digest").alias("root"))
    return size.withColumn("height", height).join(tops.withColumnRenamed("tree", "t"), (F.col("tree") == F.col("t")) & (F.col("height") == F.col("level"))).select(
        "tree", "n", "height", "root"
    )


def parent(idx: Column, has: Column) -> list[Column]:
    """The parent's number and the place in its run; null at a root."""
    return [F.when(has, F.shiftright(idx, ARITY_BITS)).alias("up"), F.when(has, idx.bitwiseAND(F.lit(7)).cast("int")).alias("pos")]


def manifest(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaves, nodes, top) of the dataset's manifest, all stored.

    ``leaves``: doc_id, tree_no, idx, leaf, tampered, up, pos, subroot.  ``nodes``:
    tree_no, block, level, idx, run, up, pos; parent-linked, the top tree's rows after
    the languages' own.  ``top``: tree, tree_no, n, height, subroot.
    """
    tree = F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit(""))  # null first
    flat = leaves(docs).select("doc_id", tree.alias("tree"), "leaf", "tampered", F.monotonically_increasing_id().alias("row"))
    flat = stored(flat, "manifest-leaves")
    bottom = ranked(flat, [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("row")], "manifest-order").drop("row")
    bottom = stored(bottom, "manifest-ranked")
    plain = bottom.select("tree", "idx", F.col("leaf").alias("digest"))
    above = levels(plain, "manifest-level")
    trees = stored(roots(plain, above), "manifest-trees")

    subroots = trees.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "n", "height", F.col("root").alias("digest"))
    subroots = stored(ranked(subroots, [F.col("name")], "manifest-top-order"), "manifest-top")
    top_plain = subroots.select("tree", "idx", "digest")
    top_above = levels(top_plain, "manifest-top-level")
    top = subroots.select(F.col("name").alias("tree"), F.col("idx").alias("tree_no"), "n", "height", F.col("digest").alias("subroot"))

    # every node's link: within its tree, from a subroot to the top tree, none from the root
    n_top = len(top_above)
    in_top = F.lit(n_top > 0)

    def linked(nodes: DataFrame, level: int) -> DataFrame:
        j = nodes.join(top, "tree")
        inside, from_root = F.col("height") > level, (F.col("height") == level) & in_top
        own = F.when(inside, F.col("idx")).otherwise(F.col("tree_no"))
        return j.select(*[c for c in nodes.columns if c != "tree"], "tree_no", "n", "height", "subroot", *parent(own, inside | from_root))

    block_bits = ARITY_BITS * BLOCK_LEVEL
    low = [linked(df, k + 1).withColumn("level", F.lit(k + 1)) for k, df in enumerate(above)]
    rows = []
    for k, df in enumerate(low):
        shift = ARITY_BITS * (k + 1) - block_bits
        if shift <= 0:
            blocks = F.array(F.shiftright("idx", -shift))
        else:
            last = F.least(F.shiftleft(F.col("idx") + 1, shift) - 1, F.shiftright(F.col("n") - 1, block_bits))
            blocks = F.sequence(F.shiftleft("idx", shift), last)
        rows.append(df.select("tree_no", F.explode(blocks).alias("block"), "level", "idx", "run", "up", "pos"))
    # the top tree's rows, numbered on from the height of each language's tree and repeated per block of its leaves
    spans = top.select("tree_no", F.col("height"), F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("n") - 1, block_bits))).alias("block"))
    for k, df in enumerate(top_above):
        links = parent(F.col("idx"), F.lit(k + 1 < n_top))
        step = df.select(F.col("idx"), "run", *links)
        reach = spans.withColumn("at", F.shiftright("tree_no", ARITY_BITS * (k + 1)))
        rows.append(
            reach.join(step, F.col("at") == F.col("idx")).select("tree_no", "block", (F.col("height") + k + 1).cast("int").alias("level"), "idx", "run", "up", "pos")
        )
    nodes = reduce(DataFrame.unionByName, rows) if rows else None
    sheet = linked(bottom, 0).select("doc_id", "tree_no", "idx", "leaf", "tampered", "up", "pos", "subroot")
    return stored(sheet, "manifest-sheet"), stored(nodes, "manifest-nodes") if nodes is not None else None, top


@contextmanager
def unlimited_recursion(spark: SparkSession):
    """Recursive queries without a row limit (a climb has a row per leaf and level); the level limit stays."""
    key = "spark.sql.cteRecursionRowLimit"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


CLIMB = """
with recursive climb(tree_no, leaf_no, level, up, pos, folded, siblings) as (
  select tree_no, idx, 0, up, pos, coalesce(tampered, leaf), cast('' as binary) from {leaves}
  union all
  select c.tree_no, c.leaf_no, c.level + 1, n.up, n.pos,
    unhex(sha2(lower(hex(concat(substring(n.run, 1, 32 * c.pos), c.folded, substring(n.run, 32 * c.pos + 33)))), 256)),
    concat(substring(n.run, 1, 32 * c.pos), substring(n.run, 32 * c.pos + 33))
  from climb c join {nodes} n on n.tree_no = c.tree_no and n.block = shiftright(c.leaf_no, {block_bits}) and n.level = c.level + 1 and n.idx = c.up)
select tree_no, leaf_no, level, folded, siblings from climb
"""


def verified(docs: DataFrame) -> DataFrame:
    """Every document's place in the manifest, its proof, and whether it still folds to the root."""
    spark = docs.sparkSession
    sheet, nodes, top = manifest(docs)
    if nodes is None:  # no tree has two leaves, and there is one tree at most
        own = sheet.select("*", F.coalesce("tampered", "leaf").alias("folded"), F.lit("").alias("proof"), F.col("subroot").alias("root"))
        return finished(own)
    root = nodes.where("up is null").select("run").limit(1).select(sha(hexed(F.col("run"))).alias("root")).collect()[0]["root"]
    with unlimited_recursion(spark):
        climb = spark.sql(CLIMB, block_bits=ARITY_BITS * BLOCK_LEVEL, leaves=sheet, nodes=nodes)
        steps = F.array_sort(F.collect_list(F.struct("level", "folded", "siblings")))
        paths = climb.groupBy("tree_no", "leaf_no").agg(steps.alias("steps")).select(
            F.col("tree_no").alias("t"), F.col("leaf_no").alias("l"), F.element_at("steps", -1)["folded"].alias("folded"),
            F.concat_ws("", F.transform("steps", lambda s: hexed(s["siblings"]))).alias("proof"),
        )
        joined = sheet.join(paths, (F.col("tree_no") == F.col("t")) & (F.col("idx") == F.col("l"))).withColumn("root", F.lit(bytes(root)))
        return stored(finished(joined), "manifest-verified")


def finished(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"),
        F.sha2("proof", 256).alias("proof_sha256"), hexed(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(table(spark, sf_dir, "documents"))


def _sql(levels: int = 7, top_levels: int = 3) -> str:
    """DuckDB SQL with the levels written out, enough for 8^7 leaves a language and 8^3 languages."""
    byte_steps = "list_reduce(flatten(list_prepend([4294967295], list_transform(string_split(cast(doc_id as varchar), ''), lambda c: [ord(c), 256, 256, 256, 256, 256, 256, 256, 256]))), lambda a, x: case when x < 256 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end)"
    field = lambda v: f"coalesce(octet_length(encode(cast({v} as varchar))) || ':' || cast({v} as varchar), '-')"
    leaf = lambda text: f"sha256({' || '.join(field(text if c == 'text' else c) for c in FIELDS)})"
    parts = [f"""
d as (
  select doc_id, coalesce('+' || lang, '') as tree, {leaf('text')} as leaf,
    case when doc_id is not null and xor({byte_steps}, 4294967295) % 3 = 0 then {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} end as tampered
  from documents),
a0 as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by tree) as n from d),
n0 as (select tree, idx, n, leaf as h from a0)"""]

    def build(stem: str, k: int) -> str:
        return f"""
{stem}r{k} as (
  select tree, idx // 8 as idx, any_value((n + 7) // 8) as n, list(h order by idx) as run from {stem}{k - 1} where n > 1 group by tree, idx // 8),
{stem}{k} as (select tree, idx, n, sha256(array_to_string(run, '')) as h from {stem}r{k})"""

    parts += [build("n", k) for k in range(1, levels + 1)]
    tops = " union all ".join(f"select tree, h from n{k} where n = 1" for k in range(levels + 1))
    parts.append(f"""
subs as (select tree, h, row_number() over (order by tree) - 1 as no, count(*) over () as n from ({tops})),
t0 as (select '' as tree, no as idx, n, h from subs)""")
    parts += [build("t", k) for k in range(1, top_levels + 1)]
    roots = " union all ".join(f"select h from t{k} where n = 1" for k in range(top_levels + 1))
    parts.append(f"""
c0 as (select doc_id, a0.tree, leaf, idx, coalesce(tampered, leaf) as f, '' as proof from a0)""")

    def climb(stem: str, source: str, out: str, k: int, key: str) -> str:
        return f"""
{out} as (
  select c.* exclude (idx, f, proof), c.idx // 8 as idx,
    case when r.run is null then f
      else sha256(array_to_string(r.run[: c.idx % 8], '') || f || array_to_string(r.run[c.idx % 8 + 2 :], '')) end as f,
    case when r.run is null then proof
      else proof || array_to_string(r.run[: c.idx % 8], '') || array_to_string(r.run[c.idx % 8 + 2 :], '') end as proof
  from {source} c left join {stem}r{k} r on r.tree = {key} and r.idx = c.idx // 8)"""

    parts += [climb("n", f"c{k - 1}", f"c{k}", k, "c.tree") for k in range(1, levels + 1)]
    parts.append(f"""
e0 as (select c.* exclude (idx), s.no as idx, s.h as subroot from c{levels} c join subs s on s.tree = c.tree)""")
    parts += [climb("t", f"e{k - 1}", f"e{k}", k, "''") for k in range(1, top_levels + 1)]
    return f"""
with {",".join(parts)}
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, f as folded_root, f = root as verified
from e{top_levels}, (select h as root from ({roots}))
"""


OP11_SQL = _sql()
