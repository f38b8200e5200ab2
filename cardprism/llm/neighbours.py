"""Approximate nearest neighbours by multiprobe p-stable hashing.

1. *Distinct vectors.*  Rows with one vector are one point of the index, named
   by its smallest id and carrying its ``k + 1`` smallest ids.  No answer can
   need another one, as ties go to smaller ids, so a vector that makes up a
   third of all rows costs one row.
2. *Hashing.*  Each of ``TABLES`` tables projects a vector on ``m`` normal
   directions, shifts, and cuts the lines into slots of width ``w``.
3. *Probes.*  A query visits, in each table, its own bucket and those reached
   by moving some coordinates to the next slot, in the order of estimated
   success: a move costs the squared distance to the slot's border, and sets of
   moves come in the order of their expected cost (``template``).
4. *Fit.*  ``m``, ``w`` and the number of probes are chosen for the data: up to
   ``FIT_QUERIES`` sampled queries are compared with *all* points, which gives
   their true neighbours, and of the settings that find ``TARGET`` of these the
   one that visits fewest of up to ``FIT_ROWS`` sampled points wins.  Both
   bounds are the sample's only; all rows are indexed and all queries asked.
5. *Search.*  Points go to parts by their buckets, a query to the parts of its
   probes, once each, with the list of buckets to visit there.  Buckets larger
   than ``PART_BYTES`` are split over several parts, and a probe visits them
   all.  A task holds one part's points while the queries stream by; per bucket
   one matrix product bounds the distances, what may be among the best is
   measured exactly (differences, in doubles), and the best of each part are
   merged per query.
6. *The rest.*  A query whose buckets hold fewer than ``k`` other points (far
   from all) is compared with all points in the same way, as if there were one
   bucket.

Work and shuffle: points move ``TABLES`` times, queries at most once per part
or probe; no pairs are shuffled but each part's best ``k + 1``.  On data
without any structure the fit has to visit a large share of all points (of
uniform directions in 64 dimensions about 0.8); close neighbours need far less.

Defined results: vectors that are null, zero, hold null or non-finite
components, or have another length than most (ties: the longer) take no part.
Rows without an id take no part; rows that repeat id and vector count once; an
id with several vectors is asked and found with each.  An empty table and a
table without queries give no rows.  Only the two named columns are read, so
others cannot clash.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardprism.llm.common import Scratch
from cardprism.llm.hashing import mix

TABLES, TARGET = 2, 0.95
FIT_QUERIES, FIT_ROWS = 64, 2000
PROBES = (1, 10, 30, 60, 100, 200, 400, 700, 1000)
SIZES, WIDTHS = (4, 8, 12, 16, 24), (0.5, 1.0, 2.0, 3.0)   # m, and w in typical distances of the k-th neighbour
PART_BYTES = 64 << 20
TILE = 1 << 21
_EMPTY = np.empty(0, np.int64)


# --- hashing -----------------------------------------------------------------------

def template(m: int, n: int) -> np.ndarray:
    """The first ``n`` sets of moves by expected cost.  Columns stand for a
    query's 2 m moves, cheapest first; the j-th cheapest has a known expected
    cost, and j and 2 m - 1 - j are the two moves of one coordinate."""
    j = np.arange(1, 2 * m + 1, dtype=float)
    up = 2 * m + 1 - j
    cost = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - up / (m + 1) + up * (up + 1) / (4 * (m + 1) * (m + 2)))
    found, heap = [()], [(cost[0], (0,))]
    while heap and len(found) < n:
        total, moves = heapq.heappop(heap)
        last = moves[-1]
        if len({min(a, 2 * m - 1 - a) for a in moves}) == len(moves):
            found.append(moves)
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*moves[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*moves, last + 1)))
    out = np.zeros((len(found), 2 * m), np.int8)
    for row, moves in zip(out, found, strict=True):
        row[list(moves)] = 1
    return out


@dataclass
class Hashes:
    """The hash functions of all tables."""
    dim: int
    m: int
    width: float
    probes: int
    tables: int = TABLES
    seed: int = 20_240_917

    def __post_init__(self):
        rng = np.random.Generator(np.random.PCG64(self.seed))
        self.lines = rng.standard_normal((self.tables, self.dim, self.m))
        self.shift = rng.uniform(0, 1, (self.tables, self.m))
        self.mixer = rng.integers(1, 2**63, (self.tables, self.m), dtype=np.int64) | 1
        self.salt = rng.integers(-2**63, 2**63 - 1, self.tables, dtype=np.int64)
        self.moves = template(self.m, self.probes)

    def _slots(self, V: np.ndarray, t: int):
        at = V @ self.lines[t] / self.width + self.shift[t]
        slot = np.floor(at)
        return slot.astype(np.int64), at - slot

    def keys(self, V: np.ndarray, t: int) -> np.ndarray:
        """Bucket of each vector in table t."""
        with np.errstate(over="ignore"):
            return (self._slots(V, t)[0] * self.mixer[t]).sum(1) + self.salt[t]

    def probe(self, V: np.ndarray, t: int) -> np.ndarray:
        """Buckets to visit in table t, one row per vector, best first."""
        slot, off = self._slots(V, t)
        with np.errstate(over="ignore"):
            home = (slot * self.mixer[t]).sum(1) + self.salt[t]
            cost = np.concatenate([off ** 2, (1 - off) ** 2], axis=1)
            step = np.concatenate([-self.mixer[t], self.mixer[t]])[np.argsort(cost, axis=1, kind="stable")]
            return home[:, None] + step @ self.moves.T.astype(np.int64)


# --- points ------------------------------------------------------------------------

def vectors(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, np.dtype, int]:
    """id, vec (its components' bytes) and digest of the rows that take part;
    the type of the components and their number."""
    kind = dict(rows.dtypes)[vec_col]
    dtype, code = (kind, np.float32) if kind == "array<float>" else ("array<double>", np.float64)
    v = F.col(f"`{vec_col}`").cast(dtype)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))
    usable = usable.where("id is not null").where(F.coalesce(finite, F.lit(False))).where(F.exists("v", lambda x: x != 0))
    sizes = usable.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.col("n").desc(), F.col("size").desc()).first()
    usable = usable.where(F.size("v") == (most["size"] if most else 0))

    def run(batches):
        for pdf in batches:
            vec = [np.asarray(x, code).tobytes() for x in pdf["v"]]
            yield pd.DataFrame({"id": pdf["id"], "vec": vec, "digest": [blake2b(x, digest_size=16).digest() for x in vec]})

    return usable.mapInPandas(run, "id bigint, vec binary, digest binary"), np.dtype(code), most["size"] if most else 0


def matrix(vecs, dtype: np.dtype, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), dtype).reshape(-1, dim).astype(np.float64)


def points_of(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors: rep (smallest id), ids (the k + 1 smallest), vec,
    digest.  Rank filter and first vector are applied before the shuffle, too."""
    same = Window.partitionBy("digest").orderBy("id")
    few = rows.select("id", "digest").distinct().withColumn("nr", F.row_number().over(same)).where(F.col("nr") <= k + 1)
    ids = few.groupBy("digest").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return ids.join(rows.groupBy("digest").agg(F.first("vec").alias("vec")), "digest").select(F.col("ids")[0].alias("rep"), "ids", "vec", "digest")


# --- search ------------------------------------------------------------------------

class Best:
    """The k best points of each query of a batch (exact, ties to smaller reps)."""

    def __init__(self, Q: np.ndarray, V: np.ndarray, reps: np.ndarray, k: int):
        self.Q, self.V, self.reps, self.k = Q, V, reps, k
        self.q2, self.v2 = (Q * Q).sum(1), (V * V).sum(1)
        self.error = 1e-12 * (self.v2.max(initial=0) + self.q2.max(initial=0))   # of distances from products
        self.limit = np.full(len(Q), np.inf)
        self.pairs, self.open = (_EMPTY, _EMPTY, np.empty(0)), ([], [])

    def meet(self, queries: np.ndarray, lo: int, hi: int) -> None:
        """Compare queries with the points lo..hi."""
        step = max(1, TILE // max(1, len(queries)))
        for a in range(lo, hi, step):
            b = min(hi, a + step)
            near = self.q2[queries, None] + self.v2[None, a:b] - 2 * self.Q[queries] @ self.V[a:b].T
            bound = self.limit[queries]
            if b - a > self.k:
                bound = np.minimum(bound, np.partition(near, self.k - 1, axis=1)[:, self.k - 1])
            i, j = np.nonzero(~(near > bound[:, None] + self.error))   # not a number: measured exactly
            self.open[0].append(queries[i])
            self.open[1].append(j + a)
            if sum(map(len, self.open[0])) > TILE // 8:
                self.settle()

    def settle(self) -> None:
        """Measure what is open and keep the best."""
        q, v, d = self.pairs
        nq, nv = (np.concatenate([_EMPTY, *x]) for x in self.open)
        nd = np.empty(len(nq))
        for a in range(0, len(nq), TILE // 64):
            diff = self.Q[nq[a:a + TILE // 64]] - self.V[nv[a:a + TILE // 64]]
            nd[a:a + TILE // 64] = np.sqrt((diff * diff).sum(1))
        q, v, d = np.r_[q, nq], np.r_[v, nv], np.r_[d, nd]
        order = np.lexsort((self.reps[v], d, q))
        q, v, d = q[order], v[order], d[order]
        once = np.r_[True, (q[1:] != q[:-1]) | (self.reps[v[1:]] != self.reps[v[:-1]])] if len(q) else np.empty(0, bool)   # found by several tables
        q, v, d = q[once], v[once], d[once]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.limit[q[last]] = d[last] ** 2
        keep = place < self.k
        self.pairs, self.open = (q[keep], v[keep], d[keep]), ([], [])


def search_part(reps: np.ndarray, V: np.ndarray, keys: np.ndarray, asked: np.ndarray, Q: np.ndarray, visits: list[np.ndarray], k: int) -> pd.DataFrame:
    """The queries' best points among a part's buckets (``keys``: sorted)."""
    best = Best(Q, V, reps, k)
    who, key = np.repeat(np.arange(len(Q)), [len(x) for x in visits]), np.concatenate([_EMPTY, *visits])
    order = np.argsort(key, kind="stable")
    who, key = who[order], key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else _EMPTY
    lo, hi = np.searchsorted(keys, key[first]), np.searchsorted(keys, key[first], side="right")
    for a, b, x, y in zip(first, np.r_[first[1:], len(key)], lo, hi, strict=True):
        if y > x:
            best.meet(who[a:b], x, y)
    best.settle()
    q, v, d = best.pairs
    return pd.DataFrame({"query": asked[q], "rep": reps[v], "d": d})


def _search(stream: DataFrame, dtype: np.dtype, dim: int, k: int) -> DataFrame:
    """``stream``: part, side (0 point, 1 query), id, vec, keys; in each
    partition sorted by part and side."""
    def run(batches):
        part, held, built = None, [], None
        for pdf in batches:
            for (at, side), rows in pdf.groupby(["part", "side"], sort=True):
                if at != part:
                    part, held, built = at, [], None
                if side == 0:
                    held.append((rows["id"].to_numpy(), b"".join(rows["vec"]), np.array([x[0] for x in rows["keys"]], np.int64)))
                elif held or built:
                    if built is None:
                        reps, keys = np.concatenate([h[0] for h in held]), np.concatenate([h[2] for h in held])
                        order = np.argsort(keys, kind="stable")
                        built = reps[order], matrix([h[1] for h in held], dtype, dim)[order], keys[order]
                        held = []
                    yield search_part(*built, rows["id"].to_numpy(), matrix(rows["vec"], dtype, dim), [np.asarray(x, np.int64) for x in rows["keys"]], k)

    return stream.mapInPandas(run, "query bigint, rep bigint, d double")


def _true_neighbours(points: DataFrame, asked: pd.DataFrame, dtype: np.dtype, dim: int, k: int) -> pd.DataFrame:
    """query, d, vec of each sampled query's k nearest points, from all points."""
    Q, ids = matrix(asked["vec"], dtype, dim), asked["rep"].to_numpy()

    def run(batches):
        for pdf in batches:
            V, reps = matrix(pdf["vec"], dtype, dim), pdf["rep"].to_numpy()
            best = Best(Q, V, reps, k + 1)
            best.meet(np.arange(len(Q)), 0, len(V))
            best.settle()
            q, v, d = best.pairs
            yield pd.DataFrame({"query": ids[q], "rep": reps[v], "d": d, "vec": pdf["vec"].to_numpy()[v]})

    near = points.select("rep", "vec").mapInPandas(run, "query bigint, rep bigint, d double, vec binary").where("query <> rep")
    order = Window.partitionBy("query").orderBy("d", "rep")
    return near.withColumn("nr", F.row_number().over(order)).where(F.col("nr") <= k).select("query", "d", "vec").toPandas()


def choose(asked: np.ndarray, near: np.ndarray, of: np.ndarray, sample: np.ndarray, reach: float, tables: int = TABLES, target: float = TARGET) -> Hashes:
    """The hash functions that find ``target`` of the true neighbours
    (``near``, of the queries ``of``) with the fewest visits to ``sample``;
    if none does, those that find most."""
    options = []
    for m in SIZES:
        for w in WIDTHS:
            h = Hashes(asked.shape[1], m, w * reach, PROBES[-1], tables)
            hit, visits = np.zeros((len(PROBES), len(near)), bool), np.zeros(len(PROBES))
            for t in range(tables):
                probes, nk, sk = h.probe(asked, t), h.keys(near, t), h.keys(sample, t)
                for q in range(len(asked)):
                    order = np.argsort(probes[q], kind="stable")
                    at = lambda keys, p=probes[q], o=order: _rank(p, o, keys)
                    mine = np.flatnonzero(of == q)
                    hit[:, mine] |= at(nk[mine])[None, :] < np.array(PROBES)[:, None]
                    visits += (at(sk)[None, :] < np.array(PROBES)[:, None]).mean(1)
            for n, recall, cost in zip(PROBES, hit.mean(1), visits / len(asked), strict=True):
                options.append((recall < target, cost + n / 20_000 if recall >= target else -recall, m, w, n))
    _, _, m, w, n = min(options)
    return Hashes(asked.shape[1], m, w * reach, n, tables)


def _rank(probes: np.ndarray, order: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which probe reaches each key (a large number: none)."""
    found = np.minimum(np.searchsorted(probes[order], keys), len(order) - 1)
    return np.where(probes[order[found]] == keys, order[found], 1 << 30)


def fit(points: DataFrame, queries: DataFrame, n: int, dtype: np.dtype, dim: int, k: int, tables: int = TABLES, target: float = TARGET) -> Hashes:
    """Hash functions for the data (see ``choose``)."""
    asks = queries.count()
    asked = _about(queries.select("rep", "vec"), asks, FIT_QUERIES).toPandas()
    sample = matrix(_about(points.select("rep", "vec"), n, FIT_ROWS).toPandas()["vec"], dtype, dim)
    near = _true_neighbours(points, asked, dtype, dim, k)
    if near.empty:
        return Hashes(dim, SIZES[0], 1.0, 1, tables)
    place = {q: i for i, q in enumerate(asked["rep"])}
    reach = float(near.groupby("query")["d"].max().median()) or 1e-9
    return choose(matrix(asked["vec"], dtype, dim), matrix(near["vec"], dtype, dim), near["query"].map(place).to_numpy(), sample, reach, tables, target)


def _about(rows: DataFrame, n: int, most: int) -> DataFrame:
    """A sample by hash of the name, of about ``most`` rows (all, if fewer)."""
    return rows.where(F.pmod(F.xxhash64("rep", F.lit(17)), F.lit(max(1, -(-n // most)))) == 0)


def nearest(rows: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding",
            tables: int = TABLES, target: float = TARGET, part_bytes: int = PART_BYTES, hashes: Hashes | None = None) -> DataFrame:
    """query_id, rank (from 1), the found row's id and its Euclidean distance:
    the ``k`` nearest found of every row whose id is divisible by ``every``."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "neighbours")
    usable, dtype, dim = vectors(rows, id_col, vec_col)
    points = scratch.put(points_of(usable, k), "points")
    asking = usable.where(F.col("id") % every == 0).dropDuplicates(["id", "digest"])
    asking = scratch.put(asking.join(points.select("digest", "rep"), "digest").select("id", "rep", "vec"), "asking")
    queries = scratch.put(asking.dropDuplicates(["rep"]).select("rep", "vec"), "queries")
    n = points.count()
    if queries.isEmpty():
        return spark.createDataFrame([], f"query_id bigint, rank int, {id_col} bigint, score double")
    hashes = hashes or fit(points, queries, n, dtype, dim, k, tables, target)
    found = scratch.put(_nearest_points(points, queries, n, hashes, dtype, dim, k + 1, part_bytes), "found")
    full = found.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= min(k + 1, n)).select(F.col("query").alias("rep"))
    short = scratch.put(queries.join(full, "rep", "left_anti"), "short")
    if not short.isEmpty():
        rest = _nearest_points(points, short, n, Hashes(dim, 1, float("inf"), 1, 1), dtype, dim, k + 1, part_bytes)
        found = found.join(full.withColumnRenamed("rep", "query"), "query", "left_semi").unionByName(rest)
    found = found.join(points.select("rep", "ids"), "rep").select("query", "d", F.explode("ids").alias("id"))
    lists = found.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("d", "id"))).alias("near"))   # (k + 1)^2 at most
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    out = asking.select("id", "rep").join(lists, F.col("rep") == F.col("query")).select("id", F.posexplode(others).alias("at", "x"))
    return out.select(F.col("id").alias("query_id"), (F.col("at") + 1).alias("rank"), F.col("x.id").alias(id_col), F.col("x.d").alias("score"))


def _nearest_points(points: DataFrame, queries: DataFrame, n: int, hashes: Hashes, dtype: np.dtype, dim: int, k: int, part_bytes: int) -> DataFrame:
    """query, rep, d: each query's k nearest points in the buckets it visits."""
    found = _search(_stream(points, queries, n, hashes, dtype, dim, part_bytes), dtype, dim, k)
    best = Window.partitionBy("query").orderBy("d", "rep")
    found = found.dropDuplicates(["query", "rep"]).withColumn("nr", F.row_number().over(best))
    return found.where(F.col("nr") <= k).select("query", "rep", "d")


def _stream(points: DataFrame, queries: DataFrame, n: int, hashes: Hashes, dtype: np.dtype, dim: int, part_bytes: int) -> DataFrame:
    """Points by the parts of their buckets, and queries by the parts that
    their probes lead to."""
    limit = max(1, part_bytes // (dim * 8 + 24))   # points a task holds
    cores = points.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, -(-n * hashes.tables // limit))

    def keys(batches):
        for pdf in batches:
            V = matrix(pdf["vec"], dtype, dim)
            for t in range(hashes.tables):
                yield pd.DataFrame({"key": hashes.keys(V, t)})

    sizes = points.select("vec").mapInPandas(keys, "key bigint").groupBy("key").agg(F.count("*").alias("n"))
    large = {r["key"]: -(-r["n"] // limit) for r in sizes.where(F.col("n") > limit).collect()}   # at most n * tables / limit, as many as parts

    def part_of(key: np.ndarray, piece: np.ndarray) -> np.ndarray:
        return (mix(key.view(np.uint64) + mix(piece.astype(np.uint64))) % np.uint64(parts)).astype(np.int64)

    def placed(batches):
        for pdf in batches:
            V, rep = matrix(pdf["vec"], dtype, dim), pdf["rep"].to_numpy()
            for t in range(hashes.tables):
                key = hashes.keys(V, t)
                piece = mix(rep.view(np.uint64)) % np.array([large.get(x, 1) for x in key.tolist()], np.uint64)
                yield pd.DataFrame({"part": part_of(key, piece), "side": 0, "id": rep, "vec": pdf["vec"], "keys": list(key[:, None])})

    def asked(batches):
        for pdf in batches:
            for a in range(0, len(pdf), 256):
                rows = pdf[a:a + 256]
                V = matrix(rows["vec"], dtype, dim)
                key = np.concatenate([hashes.probe(V, t) for t in range(hashes.tables)], axis=1)
                who, key = np.repeat(np.arange(len(rows)), key.shape[1]), key.ravel()
                pieces = np.array([large.get(x, 1) for x in key.tolist()], np.int64) if large else np.ones(len(key), np.int64)
                who, key = np.repeat(who, pieces), np.repeat(key, pieces)
                part = part_of(key, np.arange(len(key)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
                order = np.lexsort((part, who))
                who, key, part = who[order], key[order], part[order]
                first = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (part[1:] != part[:-1])])
                yield pd.DataFrame({"part": part[first], "side": 1, "id": rows["rep"].to_numpy()[who[first]],
                                    "vec": rows["vec"].to_numpy()[who[first]], "keys": [np.unique(x) for x in np.split(key, first[1:])]})

    columns = "part bigint, side int, id bigint, vec binary, keys array<bigint>"
    rows = points.select("rep", "vec").mapInPandas(placed, columns).unionByName(queries.mapInPandas(asked, columns))
    return rows.repartition(parts, "part").sortWithinPartitions("part", "side")
