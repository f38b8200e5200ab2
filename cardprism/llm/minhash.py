"""Near-duplicate documents: MinHash, banding, verification on the full
shingle sets, connected components.

1. *Signatures.*  A text's words make 5-word shingles (fewer words: the whole
   sequence is the one shingle); a shingle is a 64-bit hash.  ``BANDS * ROWS``
   universal hash functions (multiply and add, 32 bits) give as many minima,
   and each ``ROWS`` of them one band key.  Two sets of similarity s share a
   key with probability ``1 - (1 - s^8)^50``: all but 1e-7 at s = 0.85, and one
   pair in 3000 at s = 0.25, so documents that share a passage only do not
   crowd the buckets.
2. *Classes.*  Documents with one shingle set (128-bit digest of the sorted
   set) form a class; its smallest doc_id stands for it from here on, so
   thousands of copies cost one row.
3. *Links without all pairs.*  A bucket's centre is its member with most bucket
   mates over all buckets (the text that copies were made from, if it is
   there).  In the first round a class is compared with one other only: the
   centre it shares most buckets with.
   Links are confirmed on the full shingle sets, and components computed.
   Only pairs of different components can still matter.  Buckets that hold
   several components get a second round: in small ones (up to ``SMALL``
   members) all cross pairs are compared, each pair once; the members of large
   ones are dealt into blocks of about ``BLOCK`` and every two blocks meet in
   one task, which intersects all their sets by one matrix product and returns
   a spanning forest of the links, not pairs.  Blocks of one component never
   meet.  So no candidate pair that could join two components goes untested,
   whatever the bucket's size, and after two rounds all are done.
4. *Components* by alternating large-star and small-star on confirmed links.

Text moves only for classes that share a bucket: it is fetched once, and each
round joins it with the pairs (pairs are broadcast if there are at most
``BROADCAST_PAIRS``, else sort-merge joined).

Defined results: documents without words (null, empty, white space) have 0
shingles and are linked with nothing.  Rows that repeat a doc_id are one node.
Rows without an id take no part and stay (``component_id`` null).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardprism.llm.common import WHITE, Scratch
from cardprism.llm.components import connected_components
from cardprism.llm.hashing import WordHasher, mix

SHINGLE, BANDS, ROWS = 5, 50, 8
SMALL, BLOCK, BROADCAST_PAIRS = 32, 256, 200_000
_M = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.isin(np.arange(256), [ord(c) for c in WHITE])


class Signer:
    """Shingle hashes and band keys."""

    def __init__(self, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, seed: int = 20_240_901):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.shingle, self.bands, self.rows, self.hasher = shingle, bands, rows, WordHasher(_BLANK)
        self.a = rng.integers(0, 2**32, bands * rows, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes."""
        if not text:
            return np.empty(0, np.uint64)
        w = self.hasher(text.encode("utf-8", "surrogatepass").lower())   # bytes.lower: A-Z only
        if not len(w):
            return w
        k = min(self.shingle, len(w))
        n = len(w) - k + 1
        h = np.full(n, k, np.uint64)
        for i in range(k):
            h = h * _M + w[i:i + n]
        return np.unique(mix(h))

    def keys(self, h: np.ndarray) -> np.ndarray:
        """One key per band, from the minima of all hash functions."""
        x, low = (h >> np.uint64(32)).astype(np.uint32), np.full(self.bands * self.rows, np.uint32(2**32 - 1))
        for i in range(0, len(x), 256):   # what fits the processor's cache
            v = x[i:i + 256, None] * self.a
            v += self.b
            np.minimum(low, v.min(axis=0), out=low)
        rows = low.astype(np.uint64).reshape(self.bands, self.rows)
        key = np.arange(1, self.bands + 1, dtype=np.uint64)
        for r in range(self.rows):
            key = mix(key * _M + rows[:, r])
        return key.view(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, text_hash, n_shingles, digest, bands`` of each row."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        signer = Signer(**options)
        for pdf in batches:
            n, digest, bands = [], [], []
            for text in pdf["text"]:
                h = signer.shingles(text)
                n.append(len(h))
                digest.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                bands.append(signer.keys(h) if len(h) else None)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_hash": pdf["text_hash"], "n_shingles": n, "digest": digest, "bands": bands})

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInPandas(run, f"doc_id {kind}, text_hash bigint, n_shingles bigint, digest binary, bands array<bigint>")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int, few: bool = False, **options) -> DataFrame:
    """The ``x, p`` pairs whose full shingle sets meet
    ``100 * intersection >= percent * union``.  Texts of ``x`` travel to those
    of ``p``; rows come sorted by ``p``, so its set is made once."""
    sent = F.broadcast(pairs) if few else pairs
    asked = pairs.select(F.col("p").alias("node")).distinct()
    left = texts.join(sent, texts["node"] == pairs["x"]).select("x", "p", F.col("text").alias("x_text"))
    right = texts.join(F.broadcast(asked) if few else asked, "node", "left_semi").select(F.col("node").alias("p"), F.col("text").alias("p_text"))
    kind = dict(pairs.dtypes)["x"]

    def run(batches):
        signer, at, known = Signer(**options), None, None
        for pdf in batches:
            keep = []
            for p, a, b in zip(pdf["p"], pdf["x_text"], pdf["p_text"], strict=True):
                if p != at:
                    at, known = p, signer.shingles(b)
                own = signer.shingles(a)
                both = len(own) + len(known) - len(np.union1d(own, known))
                keep.append(100 * both >= percent * (len(own) + len(known) - both) > 0)
            yield pdf.loc[keep, ["x", "p"]]

    met = left.hint("merge").join(right.hint("merge"), "p").select("x", "p", "x_text", "p_text")
    return met.mapInPandas(run, f"x {kind}, p {kind}").select(F.col("x").alias("u"), F.col("p").alias("v"))


def intersections(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets.  Only
    shingles of both sides count; they are the columns of two 0/1 matrices,
    multiplied some columns at a time."""
    lr, rr = np.repeat(np.arange(len(left)), [len(s) for s in left]), np.repeat(np.arange(len(right)), [len(s) for s in right])
    lh, rh = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(lh, rh)
    out = np.zeros((len(left), len(right)), np.float32)
    lk, rk = np.isin(lh, shared), np.isin(rh, shared)
    lr, rr, lc, rc = lr[lk], rr[rk], np.searchsorted(shared, lh[lk]), np.searchsorted(shared, rh[rk])
    for c in range(0, len(shared), columns):
        a, b = (np.zeros((n, columns), np.float32) for n in out.shape)
        at = (lc >= c) & (lc < c + columns)
        a[lr[at], lc[at] - c] = 1
        at = (rc >= c) & (rc < c + columns)
        b[rr[at], rc[at] - c] = 1
        out += a @ b.T
    return out


def block_links(large: DataFrame, texts: DataFrame, percent: int, **options) -> DataFrame:
    """Links between components inside large buckets (``_open_buckets`` rows):
    per two blocks a spanning forest over the components that meet there."""
    dealt = F.when(F.col("n") >= BLOCK, F.struct(F.col("component").alias("of"), F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK)).alias("nr"))).otherwise(
        F.struct(F.lit(None).cast(dict(large.dtypes)["component"]).alias("of"), F.pmod(F.xxhash64("node"), F.ceil(F.col("total") / BLOCK)).alias("nr")))
    placed = large.select("key", "node", "component", dealt.alias("block"))
    blocks = placed.select("key", "block").distinct()
    a, b = blocks.select("key", F.col("block").alias("a")), blocks.select("key", F.col("block").alias("b"))
    meet = a.join(b, "key").where("a <= b and not coalesce(a.of = b.of, false)").select("key", "a", "b")
    columns = ["key", "a", "b", "node", "component"]
    left = placed.join(meet.withColumn("block", F.col("a")), ["key", "block"]).select(*columns, F.lit(False).alias("side"))
    right = placed.join(meet.where("a < b").withColumn("block", F.col("b")), ["key", "block"]).select(*columns, F.lit(True).alias("side"))
    rows = left.unionByName(right).join(texts, "node").select("key", "a", "b", "side", "component", "text")
    kind = dict(large.dtypes)["component"]

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        signer = Signer(**options)
        sets, side = [signer.shingles(t) for t in pdf["text"]], pdf["side"].to_numpy()
        of = pdf["component"].tolist()
        i = np.flatnonzero(~side)
        j = np.flatnonzero(side) if side.any() else i
        size = np.array([len(s) for s in sets], float)
        both = intersections([sets[k] for k in i], [sets[k] for k in j])
        hit = 100 * both >= percent * (size[i][:, None] + size[j][None, :] - both)
        root, out = {c: c for c in of}, []

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(*np.nonzero(hit)):
            u, v = find(of[i[x]]), find(of[j[y]])
            if u != v:
                root[u] = v
                out.append((of[i[x]], of[j[y]]))
        return pd.DataFrame(out, columns=["u", "v"])

    return rows.groupBy("key", "a", "b").applyInPandas(links, f"u {kind}, v {kind}")


def _open_buckets(members: DataFrame, found: DataFrame) -> DataFrame:
    """``key, node, component, n`` of the buckets that hold several components;
    ``n`` counts the members of the row's component there, ``total`` all."""
    labelled = members.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    inside = labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
    several = inside.groupBy("key").agg(F.sum("n").alias("total"), F.count("*").alias("k")).where("k > 1").drop("k")
    return labelled.join(inside, ["key", "component"]).join(several, "key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, **options) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id``, the smallest
    doc_id reachable over links ``100 * intersection >= percent * union``."""
    scratch = Scratch(docs.sparkSession, "near")
    rows = scratch.put(signatures(docs, id_col, text_col, **options), "signatures")
    linkable = rows.where("doc_id is not null and n_shingles > 0")
    classes = scratch.put(linkable.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.first("bands").alias("bands"))
                          .select("digest", F.col("least.doc_id").alias("node"), F.col("least.text_hash").alias("text_hash"), "bands"), "classes")
    buckets = classes.select("node", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    mates = scratch.put(buckets.join(shared, "key"), "mates")
    score = mates.groupBy("node").agg(F.sum("n").alias("mates"))
    mates = mates.join(score, "node").select("key", "node", F.struct("mates", (-F.col("node")).alias("neg")).alias("rank"))
    mates = scratch.put(mates, "members")
    members = scratch.put(mates.join(mates.groupBy("key").agg((-F.max("rank")["neg"]).alias("first")), "key").select("key", "node", "first"), "starred")

    wanted = members.select("node").distinct().join(classes.select("node", "text_hash"), "node").alias("w")
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).withColumn("text_hash", F.xxhash64("text"))
    same = (F.col("s.doc_id") == F.col("w.node")) & (F.col("s.text_hash") == F.col("w.text_hash"))
    texts = scratch.put(source.alias("s").join(wanted, same).select("w.node", "s.text"), "texts")

    # rows that repeat a doc_id with another text are one node
    again = linkable.groupBy("doc_id").agg(F.min(F.xxhash64("digest")).alias("a"), F.max(F.xxhash64("digest")).alias("b")).where("a <> b").select("doc_id")
    several = linkable.join(again, "doc_id").join(classes, "digest").select("doc_id", "node")
    links = scratch.put(several.select(F.col("doc_id").alias("u"), F.col("node").alias("v")).distinct(), "links")

    votes = members.where("node <> first").groupBy("node", "first").agg(F.count("*").alias("n"))
    best = votes.groupBy("node").agg(F.max(F.struct("n", (-F.col("first")).alias("neg"))).alias("best"))
    pairs = best.select(F.col("node").alias("x"), (-F.col("best.neg")).alias("p"))
    members = members.select("key", "node")

    def joined(links, new, step):
        """Links so far and the new ones, and the components they make."""
        links = scratch.put(links.unionByName(new), f"links{step}")
        found = connected_components(links, scratch, f"round{step}-")
        return found.select(F.col("node").alias("u"), F.col("component").alias("v")), found

    pairs = scratch.put(pairs, "pairs0")
    links, found = joined(links, confirm(pairs, texts, percent, pairs.count() <= BROADCAST_PAIRS, **options), 0)
    open_ = scratch.put(_open_buckets(members, found), "open")
    small, large = open_.where(F.col("total") <= SMALL), open_.where(F.col("total") > SMALL)
    cross = small.alias("a").join(small.alias("b"), "key").where("a.component <> b.component and a.node > b.node").select(
        F.col("a.node").alias("x"), F.col("b.node").alias("p")).distinct()
    done = pairs.select(F.greatest("x", "p").alias("x"), F.least("x", "p").alias("p"))
    cross = scratch.put(cross.join(done, ["x", "p"], "left_anti"), "pairs1")
    more = confirm(cross, texts, percent, cross.count() <= BROADCAST_PAIRS, **options).unionByName(block_links(large, texts, percent, **options))
    links, found = joined(links, more, 1)

    named = rows.join(classes.select("digest", "node"), "digest", "left").join(found, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id"))
