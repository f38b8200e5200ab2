"""Exact deduplication by deterministic block naming (DataFrame functions only).

A document's normalised text (white space ``[\\x20\\x09-\\x0D]`` deleted) is
cut into blocks of ``block`` characters.  The distinct blocks are sorted and
numbered: equal blocks get one integer name, different blocks different names.
Then each two adjacent names of a document are looked up in the sorted,
numbered table of distinct pairs, which names the pair; an odd last name makes
a pair of its own.  After ``log2`` of its block count each document has one
name, and two documents have the same (block count, name) exactly if their
normalised texts are equal.

*No collisions.*  Names are handed out per distinct text, not computed from
it.  A block's 64-bit hash only routes: it picks the table row, and where one
hash covers several different blocks (counted on the distinct blocks
themselves) those blocks are named and looked up by their whole text.

*At scale.*  Block text is shuffled once, reduced to distinct blocks before
(copies meet in the map tasks).  All later shuffles carry 8-byte names.  A hot
block or pair is pre-aggregated when named, and its look-up is a plain
equi-join that AQE splits.  No group of rows meets in one task, and a long
document is spread over its blocks.

Defined results: null text counts as empty, and all empty texts are equal.  Of
equal texts the row with the most code points stays, then the smallest
``doc_id`` (null last), then any one of exactly repeated rows.  An empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardprism.llm.common import WHITE, Scratch


def normalised(text):
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:   # byte search; several times as fast as translate's look-up per character
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def blocks_of(text, block: int):
    """Array of the text's blocks in order; one empty block for an empty text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)^$|.{{1,{block}}}"), F.lit(0))


def _named(df: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct ``keys`` of ``df``, sorted and numbered in ``name``: each
    task sorts its share, and the numbers of different tasks differ."""
    return df.select(*keys).distinct().sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def identify(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
             block: int = 4096, route=None) -> DataFrame:
    """One row per row of ``docs``: ``row`` (a number), ``doc_id``, ``n_code``
    (code points of the original text), ``text_sha256``, and the identity
    ``(n_blocks, name)``.  ``route`` is the routing hash, xxhash64 by default."""
    route = route or (lambda c: F.xxhash64(c))
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).select(
        "doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_code"), normalised(F.col("text")).alias("norm"))
    cut = texts.withColumn("blocks", blocks_of(F.col("norm"), block))
    rows = scratch.put(cut.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.col("n_code").cast("long").alias("n_code"),
        F.sha2("norm", 256).alias("text_sha256"), F.size("blocks").alias("n_blocks"),
        F.transform("blocks", route).alias("hashes")), "rows")

    # names of the blocks: one row per hash if it covers one text, else by text
    each = cut.select(F.explode("blocks").alias("block")).withColumn("hash", route(F.col("block")))
    by_text = each.groupBy("hash", "block").agg(F.lit(1).alias("one"))
    by_hash = scratch.put(by_text.groupBy("hash").agg(F.count("*").alias("n_texts")).sortWithinPartitions("hash")
                          .withColumn("name", F.monotonically_increasing_id()), "blocks")
    places = rows.select("row", F.col("n_blocks").alias("total"), F.posexplode("hashes").alias("pos", "hash"))
    level = places.join(by_hash.where("n_texts = 1"), "hash").select("row", "total", "pos", "name")
    shared = by_hash.where("n_texts > 1").select("hash")
    if not shared.isEmpty():  # different blocks with one hash: by their whole text, with names below 0
        clash = (cut.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.posexplode("blocks").alias("pos", "block"))
                 .withColumn("hash", route(F.col("block"))).join(shared, "hash", "left_semi"))
        names = scratch.put(_named(clash, ["block"]).withColumn("name", -F.col("name") - 1), "clashes")
        same = F.col("c.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("c.text_sha256") == F.col("r.text_sha256"))
        placed = clash.join(names, "block").alias("c").join(rows.alias("r"), same)
        level = level.unionByName(placed.select("r.row", F.col("r.n_blocks").alias("total"), "c.pos", "c.name").distinct())

    level = scratch.put(level.withColumn("size", F.col("total")), "level0")
    done, step = level.where("size = 1"), 0
    while not (rest := level.where("size > 1")).isEmpty():
        pairs = scratch.put(rest.groupBy("row", "total", "size", F.floor(F.col("pos") / 2).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("right")), f"pairs{step}")
        names = scratch.put(_named(pairs, ["left", "right"]), f"names{step}").alias("n")
        same = (F.col("p.left") == F.col("n.left")) & F.col("p.right").eqNullSafe(F.col("n.right"))
        named = pairs.alias("p").join(names, same).select("row", "total", F.ceil(F.col("size") / 2).cast("int").alias("size"), "pos", "name")
        level = scratch.put(named, f"level{step + 1}")
        done = done.unionByName(level.where("size = 1"))
        scratch.drop(f"pairs{step}")
        scratch.drop(f"names{step}")
        step += 1
    return rows.drop("hashes", "n_blocks").join(done.select("row", F.col("total").alias("n_blocks"), "name"), "row")


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 4096, route=None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_code``, ``text_sha256``,
    ``keep_id``, ``group_size`` and ``kept`` (one row of each group)."""
    scratch = Scratch(docs.sparkSession, "copies")
    named = identify(docs, scratch, id_col, text_col, block, route)
    named = scratch.put(named, "identities")
    order = F.struct((-F.col("n_code")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    groups = named.groupBy("n_blocks", "name").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
    groups = scratch.put(groups, "groups")   # both sides of the join are shuffled, so a hot group's rows can be split
    return named.join(groups, ["n_blocks", "name"]).select(
        "doc_id", "n_code", "text_sha256", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"))
