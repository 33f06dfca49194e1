"""Merkle manifest of a table: a hash per row, a binary tree per partition value,
one tree over their roots, and a proof for every row.

Rows get their places by a range shuffle and the row counts of its partitions, so no
task sorts a whole language. Levels are built in aligned blocks of ``2 ** BLOCK``
nodes, one task per block, and stored as node rows. A node row links to its parent and holds its
sibling; at every ``STRIDE``-th level it links to the ancestor ``STRIDE`` levels up
(or at the end of its tree) and holds the siblings on that way.

Proofs come from a recursive Spark query: the leaves are its anchor; every step joins
the rows it has reached with the stored nodes above, appends their siblings and folds the
claimed hash with them. A step reads the nodes of every ``STRIDE``-th level only, a 4096th of the
leaves, and Spark writes the rows of every step once, so few long steps move least.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

BLOCK = 12               # levels built by one task; a block has 2 ** BLOCK nodes at most
STRIDE = 12              # levels climbed by one step; divides BLOCK
TASK_BLOCKS = 8          # blocks a task builds one after another, on average
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = -1                 # number of the tree over the partitions' roots

_PATH = pa.list_(pa.struct([("sib", pa.binary()), ("before", pa.bool_())]))
_NODE = pa.schema([("tree", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("pos", pa.int64()), ("hash", pa.binary()),
                   ("up_tree", pa.int64()), ("up_level", pa.int32()), ("up_pos", pa.int64()), ("path", _PATH),
                   ("doc_id", pa.int64()), ("claim", pa.binary())])
_DDL = ("tree long, n long, level int, pos long, hash binary, up_tree long, up_level int, up_pos long, "
        "path array<struct<sib: binary, before: boolean>>, doc_id long, claim binary")


def leaf_hash(columns: dict[str, Column]) -> Column:
    """SHA-256 (binary) of the values in order, each ``-`` if null, else its UTF-8
    length, a colon and the value."""
    parts = []
    for value in columns.values():
        text = value.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs: DataFrame, claimed: dict[str, Column] | None = None, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """``(part, doc_id, hash, claim)`` of every row; ``claim`` is the hash of the
    row with the columns of ``claimed`` in place of its own."""
    own = {c: F.col(c) for c in columns}
    return docs.select(F.col("lang").alias("part"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash(own).alias("hash"),
                       leaf_hash(own | (claimed or {})).alias("claim"))


def placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows(part, doc_id, hash, ...)`` with ``pos``, their place among the rows of
    their part by doc_id (null first; equal ids by hash), ``n``, the rows of the part, and
    ``tree``, the part's number by UTF-8 order (null first). Second result: the
    distinct ``(part, tree)``. Equal rows may take each other's places."""
    numbered = cut_lineage(rows.withColumn("tie", F.monotonically_increasing_id()))
    order = ["part", "doc_id", "hash", "tie"]
    ranged = cut_lineage(numbered.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("at", F.monotonically_increasing_id()).drop("tie"))
    task = F.shiftright("at", 33)
    # a row per (task, part): each task holds a stretch of the order
    runs = ranged.groupBy("part", task.alias("task")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    in_part = W.partitionBy("part").orderBy("task")
    runs = cut_lineage(runs.withColumn("before", F.sum("rows").over(in_part) - F.col("rows"))
                       .withColumn("n", F.sum("rows").over(W.partitionBy("part"))))
    parts = _numbered(runs.select("part").distinct())
    runs = (runs.join(parts, runs["part"].eqNullSafe(parts["part"])).select(
        runs["part"].alias("p"), F.col("task").alias("t"), "first", "before", "n", "tree"))
    out = ranged.join(runs, F.col("part").eqNullSafe(F.col("p")) & (task == F.col("t")))
    return out.withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop("p", "t", "first", "before", "at"), parts


def _numbered(parts: DataFrame) -> DataFrame:
    """``(part, tree)``: distinct parts by their order, counted per range partition."""
    ranged = cut_lineage(parts.repartitionByRange("part").sortWithinPartitions("part").withColumn("at", F.monotonically_increasing_id()))
    sizes = ranged.groupBy(F.shiftright("at", 33).alias("task")).agg(F.count("*").alias("rows"))
    before = sizes.withColumn("before", F.sum("rows").over(W.orderBy("task")) - F.col("rows"))    # a row per task
    return (ranged.withColumn("task", F.shiftright("at", 33)).join(before, "task")
            .select("part", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("tree")))


def _up(h: str, sib: str | None, before: bool) -> str:
    both = h if sib is None else sib + h if before else h + sib
    return hashlib.sha256(both.encode()).hexdigest()


def _block(level: int):
    """One aligned block of nodes at ``level`` -> the node rows of its levels; the
    node above a whole block comes without a path."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        tree, n = table.column("tree")[0].as_py(), table.column("n")[0].as_py()
        first = table.column("pos")[0].as_py()
        height = max(0, n - 1).bit_length()
        top = min(BLOCK, height - level)
        levels = [[h.hex() for h in table.column("hash").to_pylist()]]
        for _ in range(top):
            below = levels[-1]
            levels.append([_up(below[i], below[i + 1] if i + 1 < len(below) else None, False) for i in range(0, len(below), 2)])
        extra = list(zip(table.column("doc_id").to_pylist(), table.column("claim").to_pylist()))
        out = []
        for k, row in enumerate(levels):
            at = level + k
            if at == level + BLOCK < height:
                out += [(tree, n, at, first >> k, bytes.fromhex(row[0]), None, None, None, None, None, None)]
                break
            steps = min(1 if at % STRIDE else STRIDE, height - at)
            for i, h in enumerate(row):
                path = []
                for t in range(steps):
                    j = (i >> t) ^ 1
                    sib = levels[k + t][j] if j < len(levels[k + t]) else None
                    path.append({"sib": None if sib is None else bytes.fromhex(sib), "before": bool(i >> t & 1)})
                pos = (first >> k) + i
                if at + steps < height:
                    link = (tree, at + steps, pos >> steps)
                else:
                    link = (None, None, None) if tree == TOP else (TOP, 0, tree)
                out.append((tree, n, at, pos, bytes.fromhex(h), *link, path, *(extra[i] if at == 0 else (None, None))))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _NODE)], schema=_NODE)
    return run


def _trees(bottom: DataFrame) -> DataFrame:
    """``bottom(tree, n, pos, hash, doc_id, claim)`` -> all node rows."""
    level, found, todo = 0, None, bottom
    while True:
        block = F.shiftright("pos", BLOCK)
        tasks = max(1, -(-todo.count() // (TASK_BLOCKS << BLOCK)))       # stated, or small rows would meet in one task
        dealt = todo.repartition(tasks, "tree", block)
        rows = cut_lineage(dealt.groupBy("tree", block.alias("block")).applyInArrow(_block(level), _DDL))
        nodes = rows.where("path is not null")
        found = nodes if found is None else found.unionByName(nodes)
        todo = rows.where("path is null").select("tree", "n", "pos", "hash", "doc_id", "claim")
        if todo.isEmpty():
            return found
        level += BLOCK


def _is_root() -> Column:
    """The last node of a tree has no level above it in its own tree."""
    return F.size("path") == 0


def manifest(rows: DataFrame) -> DataFrame:
    """Node rows of :func:`leaves`: ``(tree, n, level, pos, hash, up_tree, up_level,
    up_pos, path, doc_id, claim)``. ``tree`` is the part's number, or ``TOP`` for the
    tree over the parts' roots, whose leaf ``pos`` is part number ``pos``; ``path`` holds
    the siblings up to the linked node, ``sib`` null where a node is alone. An empty
    table has no nodes."""
    at, _ = placed(rows)
    below = _trees(at.select("tree", "n", "pos", "hash", "doc_id", "claim"))
    roots = below.where(_is_root())
    nothing = [F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("claim")]
    above = roots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(roots.count()).cast("long").alias("n"),
                         F.col("tree").alias("pos"), "hash", *nothing)
    return below.unionByName(_trees(above)) if above.count() else below


@contextmanager
def _unlimited_recursion(spark: SparkSession):
    """Row and level limits of recursive queries are guards for interactive use."""
    names = ("spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit")
    old = {k: spark.conf.get(k, None) for k in names}
    try:
        for k in names:
            spark.conf.set(k, "-1")
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_FOLD = """aggregate({path}, {start}, (h, p) -> unhex(sha2(CASE WHEN p.sib IS NULL THEN lower(hex(h))
  WHEN p.before THEN lower(concat(hex(p.sib), hex(h))) ELSE lower(concat(hex(h), hex(p.sib))) END, 256)))"""
_SIBS = "aggregate(path, X'', (s, p) -> concat(s, coalesce(p.sib, X'')))"


def climb(nodes: DataFrame) -> DataFrame:
    """``(doc_id, leaf, leaf_tree, folded, siblings)`` per leaf of the node rows: the
    leaf's ``claim`` folded up to the root, and the siblings met, bytes joined in
    order. The recursive query runs here; its rows are written once."""
    spark = nodes.sparkSession
    # the last step in a part's tree goes on to the first one above, so that is no step of its own
    on = nodes.where(f"tree = {TOP} and level = 0").select(
        F.lit(TOP).cast("long").alias("t0"), F.lit(0).alias("l0"), F.col("pos").alias("p0"),
        *[F.col(c).alias(f"{c}_on") for c in ("path", "up_tree", "up_level", "up_pos")])
    ends = (F.col("up_tree") == F.col("t0")) & (F.col("up_level") == F.col("l0")) & (F.col("up_pos") == F.col("p0"))
    links = [F.when(F.col("t0").isNull(), F.col(c)).otherwise(F.col(f"{c}_on")).alias(c) for c in ("up_tree", "up_level", "up_pos")]
    path = F.when(F.col("t0").isNull(), F.col("path")).otherwise(F.concat("path", "path_on")).alias("path")
    stations = (nodes.where(f"tree <> {TOP} or level > 0").where(f"level % {STRIDE} = 0").join(on, ends, "left")
                .select("tree", "level", "pos", "hash", "doc_id", "claim", *links, path))
    ground = stations.where("level = 0")
    above = cut_lineage(stations.where("level > 0").select(
        "tree", "level", "pos", "up_tree", "up_level", "up_pos", "path", F.expr(_SIBS).alias("sibs")))
    with _unlimited_recursion(spark):
        return cut_lineage(spark.sql(f"""
            WITH RECURSIVE climbed(doc_id, leaf, leaf_tree, tree, level, pos, folded, siblings) AS (
              SELECT doc_id, hash, tree, up_tree, up_level, up_pos, {_FOLD.format(path="path", start="claim")}, {_SIBS} FROM {{ground}}
              UNION ALL
              SELECT c.doc_id, c.leaf, c.leaf_tree, n.up_tree, n.up_level, n.up_pos,
                     {_FOLD.format(path="n.path", start="c.folded")}, concat(c.siblings, n.sibs)
              FROM climbed c JOIN {{above}} n ON c.tree = n.tree AND c.level = n.level AND c.pos = n.pos)
            SELECT doc_id, leaf, leaf_tree, folded, siblings FROM climbed WHERE tree IS NULL""", ground=ground, above=above))


def tampered() -> dict[str, Column]:
    """The contract's tampering: one more character where 7 divides the CRC-32 of the id."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    return {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}


def proofs(docs: DataFrame, claimed: dict[str, Column] | None = None) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` per
    row: hashes as lowercase hex; the proof digest is that of the siblings' hex text.

    Nulls are hashed as such (a null lang is a part of its own, the first; null ids come
    first in theirs). Repeated rows are leaves side by side. A part of one row has its
    leaf as root, a table of one part its root as the whole root. Columns beyond
    ``COLUMNS`` are ignored, whatever their names; an empty table gives no rows."""
    nodes = manifest(leaves(docs, claimed))
    top = nodes.where(f"tree = {TOP}")
    root = top.where(_is_root()).select("hash").first()
    low = lambda c: F.lower(F.hex(c))
    subroots = top.where("level = 0").select(F.col("pos").alias("part"), low("hash").alias("subroot"))
    found = climb(nodes)
    whole = F.lit(root.hash.hex() if root else None).cast("string")
    return found.join(subroots, F.col("leaf_tree") == F.col("part")).select(
        "doc_id", low("leaf").alias("leaf"), "subroot", whole.alias("root"), F.sha2(low("siblings"), 256).alias("proof_sha256"),
        low("folded").alias("folded_root"), (low("folded") == whole).alias("verified"))


PROOFS_SQL = r"""
WITH RECURSIVE f AS (SELECT doc_id, lang, n_chars,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(text) || ':' || text, '-') AS z FROM documents),
bits AS (SELECT doc_id, row_number() OVER () AS k FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
crc(k, doc_id, s, i, c) AS (
  SELECT k, doc_id, doc_id::VARCHAR, 0, 4294967295::BIGINT FROM bits
  UNION ALL
  SELECT k, doc_id, s, i + 1, CASE WHEN i % 9 = 0 THEN xor(c, ascii(s[i // 9 + 1])::BIGINT)
    ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END FROM crc WHERE i < 9 * length(s)),
hit AS (SELECT doc_id FROM crc WHERE i = 9 * length(s) AND xor(c, 4294967295) % 7 = 0),
l AS (SELECT f.doc_id, lang, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || z) AS h,
    CASE WHEN hit.doc_id IS NULL THEN h ELSE sha256(a || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || z) END AS claim
  FROM f LEFT JOIN hit ON hit.doc_id = f.doc_id),
p AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY lang) AS n,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM l),
low(tree, level, pos, h, n) AS (
  SELECT tree, 0, pos, h, n FROM p
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM low WHERE n > 1 GROUP BY tree, level, pos // 2, n),
sub AS (SELECT tree, h, count(*) OVER () AS n FROM low WHERE n = 1),
high(level, pos, h, n) AS (
  SELECT 0, tree, h, n FROM sub
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM high WHERE n > 1 GROUP BY level, pos // 2, n),
node AS (SELECT tree, level, pos, h, n FROM low UNION ALL SELECT -1, level, pos, h, n FROM high),
up AS (SELECT a.tree, a.level, a.pos, a.n, a.n = 1 AS ends, b.h AS sib, a.pos % 2 = 1 AS before
  FROM node a LEFT JOIN node b ON b.tree = a.tree AND b.level = a.level AND b.pos = xor(a.pos, 1) AND a.n > 1),
c(doc_id, leaf, own, at_tree, at_level, at_pos, folded, sibs) AS (
  SELECT doc_id, h, tree, tree, 0, pos, claim, '' FROM p
  UNION ALL
  SELECT doc_id, leaf, own, CASE WHEN ends THEN (CASE WHEN at_tree = -1 THEN NULL ELSE -1 END) ELSE at_tree END,
    CASE WHEN ends THEN 0 ELSE at_level + 1 END, CASE WHEN ends THEN at_tree ELSE at_pos // 2 END,
    CASE WHEN ends THEN folded WHEN sib IS NULL THEN sha256(folded) WHEN before THEN sha256(sib || folded) ELSE sha256(folded || sib) END,
    sibs || coalesce(sib, '')
  FROM c JOIN up ON up.tree = at_tree AND up.level = at_level AND up.pos = at_pos)
SELECT doc_id, leaf, sub.h AS subroot, (SELECT h FROM high WHERE n = 1) AS root, sha256(sibs) AS proof_sha256,
  folded AS folded_root, folded = (SELECT h FROM high WHERE n = 1) AS verified
FROM c JOIN sub ON sub.tree = own WHERE at_tree IS NULL
"""
