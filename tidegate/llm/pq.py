"""Near-duplicate embeddings by product quantisation.

Vectors that are equal form a class; one of each takes part. A coarse quantiser, fitted by k-means
on a bounded sample, deals unit vectors to inverted lists; what is left of a vector beside its
centroid is cut into subspaces, each coded by its nearest of 256 codewords. Every vector then
queries the lists that can hold a vector within the threshold's distance, told by how far it is from
the plane halfway between its own centroid and theirs: a neighbour at distance t lies beyond a plane
at distance h only if its offset points h/t or more along one direction, which for h/t over
REACH / sqrt(d) is all but impossible, d being the number of dimensions in which residuals really
spread (the sample tells: the square of the summed variances over the sum of their squares, along
principal axes); up to d = REACH^2 the whole distance is reached. In a list, a table of squared distances from the query's residual to all codewords gives the distance
to each coded vector by look-ups alone. A vector stays a candidate if that distance is within the
threshold's plus the vector's own coding error, which by the triangle inequality loses nothing;
candidates are ranked anew by exact cosine in double precision, and those below the threshold go.
So every link reported is one, and links are missed only across planes farther than that (tests
measure the recall). How many lists are probed follows from the data.

Lists longer than CHUNK rows are cut into chunks that are tasks of their own, and queries pass a
chunk in batches. A task returns each query's number of links and a spanning forest, never all
pairs.

Defined cases: null and empty vectors, zero vectors and vectors with null or non-finite components
link with nothing and are their own component; vectors of different lengths don't link; rows that
repeat are vectors of their own, linked with each other; a row without an id gets the component of
its class, or null; an empty table gives no rows. Columns beside the id and the vector aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import common

THRESHOLD = 0.95
#: The sample the quantisers are fitted on: vectors and bytes at most; and the most lists.
SAMPLE, SAMPLE_BYTES, MOST_LISTS = 60_000, 96 << 20, 15_000
SUBSPACES, CODES = 8, 256
#: Probes go as far as this many standard deviations of a random offset along one direction.
REACH = 3.5
CHUNK, QUERY_BATCH = 4096, 1024


# ---------------------------------------------------------------- quantisers


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return np.maximum((x * x).sum(1)[:, None] + (centroids * centroids).sum(1)[None] - 2 * x @ centroids.T, 0)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return distances(x, centroids).argmin(1)


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    k = min(k, len(x))
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        owner = np.concatenate([nearest(x[s : s + 8192], centroids) for s in range(0, len(x), 8192)])
        count = np.bincount(owner, minlength=k)
        order = np.argsort(owner, kind="stable")
        heads = np.flatnonzero(np.r_[True, owner[order][1:] != owner[order][:-1]])
        centroids[owner[order][heads]] = np.add.reduceat(x[order], heads, axis=0) / count[owner[order][heads]][:, None]
        if (empty := np.flatnonzero(count == 0)).size:
            centroids[empty] = x[rng.choice(len(x), len(empty))]
    return centroids


class Quantiser:
    """Coarse centroids and residual codebooks."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.coarse = k_means(sample, lists)
        self.cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        residual = sample - self.coarse[np.concatenate([nearest(sample[s : s + 8192].astype(np.float32), self.coarse) for s in range(0, len(sample), 8192)])]
        some = residual[:16384]
        spread = np.linalg.eigvalsh(some.T @ some) if len(some) else np.zeros(1)
        #: Dimensions in which residuals spread, as if evenly.
        self.spread = float(spread.sum() ** 2 / (spread**2).sum()) if (spread > 0).any() else 1.0
        self.books = [k_means(some[:, s:e], CODES) for s, e in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def parts(self) -> Iterator[tuple[int, int, np.ndarray]]:
        yield from zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), self.books, strict=True)

    def encode(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """Own lists, all lists to probe for vectors within ``reach``, codes, and coding errors."""
        d = distances(x.astype(np.float32), self.coarse)
        own = d.argmin(1)
        apart = np.sqrt(distances(self.coarse[own], self.coarse))
        part = min(1.0, REACH / np.sqrt(self.spread))
        near = d - np.take_along_axis(d, own[:, None], 1) <= 2 * part * reach * apart + 1e-3
        near[np.arange(len(x)), own] = True
        probes = [np.flatnonzero(row) for row in near]
        residual = x - self.coarse[own]
        codes = np.zeros((len(x), len(self.books)), np.uint8)
        error = np.zeros(len(x))
        for j, (s, e, book) in enumerate(self.parts()):
            codes[:, j] = nearest(residual[:, s:e].astype(np.float32), book)
            error += ((residual[:, s:e] - book[codes[:, j]]) ** 2).sum(1)
        return own, probes, codes, np.sqrt(error)

    def table(self, x: np.ndarray, cell: int) -> np.ndarray:
        """(query, subspace, code) squared distances of the queries' residuals to all codewords."""
        residual = x - self.coarse[cell]
        out = np.zeros((len(x), len(self.books), CODES), np.float32)
        for j, (s, e, book) in enumerate(self.parts()):
            r = residual[:, s:e]
            out[:, j, : len(book)] = (r * r).sum(1)[:, None] + (book * book).sum(1)[None] - 2 * r @ book.T
        return out


def links_in(q: Quantiser, cell: int, queries: np.ndarray, codes: np.ndarray, errors: np.ndarray, vectors: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (query, listed vector) of pairs at or above the threshold."""
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + errors + 1e-4
    table = q.table(queries, cell)
    adc = np.zeros((len(queries), len(codes)), np.float32)
    for j in range(codes.shape[1]):
        adc += table[:, j, codes[:, j]]
    a, b = np.nonzero(adc <= (reach * reach)[None].astype(np.float32))
    if not len(a):
        return a, b
    exact = np.concatenate([(queries[a[s : s + 65536]] * vectors[b[s : s + 65536]]).sum(1) for s in range(0, len(a), 65536)])
    good = exact >= threshold
    return a[good], b[good]


# ---------------------------------------------------------------- the plan


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def prepare(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id``, fingerprint ``f1 f2``, ``dim`` (0 if the vector can't link) and ``vec`` (doubles)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs, dims, prints = [], [], []
            for v in batch.column("v").to_pylist():
                x = np.array([np.nan if c is None else c for c in v], np.float64) if v else np.zeros(0)
                with np.errstate(over="ignore"):
                    ok = len(x) > 0 and np.isfinite(x).all() and x.any()
                if ok:
                    x = x / np.abs(x).max() + 0.0  # no overflow in squares, no negative zero
                vecs.append(x.tobytes() if ok else None)
                dims.append(len(x) if ok else 0)
                prints.append(xxhash.xxh3_128_digest(x.tobytes()) if ok else b"\0" * 16)
            two = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())], names=["id", "f1", "f2", "dim", "vec"])

    common.ship(table.sparkSession)
    common.small_batches(table.sparkSession)
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(work, "id long, f1 long, f2 long, dim int, vec binary")


def found(reps: DataFrame, threshold: float) -> DataFrame:
    """Rows ``a``, ``b``, ``n``: a query with its number of links, or a spanning link (n null).
    ``reps``: ``id``, ``m`` (vectors of the class), ``vec``, of one length."""
    n, size = reps.agg(F.count("*"), F.max(F.length("vec"))).first()
    most = max(1, min(SAMPLE, SAMPLE_BYTES // size))
    # chosen by a hash where the vectors lie, so that about the sample and no more is sent
    chosen = reps if n <= most else reps.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(most / n * (1 << 40)))
    sample = unit([bytes(r.vec) for r in sorted(chosen.select("id", "vec").collect(), key=lambda r: r.id)] or [bytes(reps.select("vec").first().vec)])
    lists = int(np.clip(4 * np.sqrt(n), 1, min(MOST_LISTS, max(1, len(sample) // 4))))
    quantiser = Quantiser(sample, lists)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, probes, codes, errors = quantiser.encode(unit(batch.column("vec").to_pylist()), reach)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("m"), batch.column("vec"), pa.array(own.astype(np.int32)), pa.array([p.tolist() for p in probes], pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors)],
                names=["id", "m", "vec", "cell", "probes", "codes", "error"],
            )

    coded = common.written(reps.mapInArrow(encode, "id long, m long, vec binary, cell int, probes array<int>, codes binary, error double"), "coded")
    sizes = coded.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    listed = coded.select("id", "m", "vec", "codes", "error", "cell").join(F.broadcast(sizes), "cell")  # at most MOST_LISTS rows
    listed = listed.select("cell", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), F.lit(0).alias("kind"), "id", "m", "vec", "codes", "error")
    asking = coded.select("id", "vec", F.explode("probes").alias("cell")).join(F.broadcast(sizes), "cell")
    asking = asking.select("cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("kind"), "id", F.lit(0).cast("long").alias("m"), "vec", F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("error"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def ask(ids: np.ndarray, raw: list[bytes]) -> pa.RecordBatch | None:
            if "ids" not in held:
                return None
            a, b = links_in(quantiser, held["cell"], unit(raw), held["codes"], held["errors"], held["vectors"], threshold)
            other = ids[a] != held["ids"][b]
            a, b = a[other], b[other]
            if not len(a):
                return None
            total = np.bincount(a, weights=held["m"][b], minlength=len(ids)).astype(np.int64)
            some = np.flatnonzero(total)
            every, place = np.unique(np.concatenate([ids, held["ids"]]), return_inverse=True)
            root = common.forest(len(every), place[: len(ids)][a], place[len(ids) :][b])
            child = np.flatnonzero(root != np.arange(len(every)))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.r_[ids[some], every[child]]), pa.array(np.r_[ids[some], every[root[child]]]), pa.array([*total[some].tolist(), *[None] * len(child)], pa.int64())], names=["a", "b", "n"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            c, k, kind = (batch.column(x).to_numpy() for x in ("cell", "chunk", "kind"))
            heads = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (k[1:] != k[:-1]) | (kind[1:] != kind[:-1])])
            for s, e in zip(heads.tolist(), [*heads[1:].tolist(), batch.num_rows], strict=True):
                part = batch.slice(s, e - s)
                if held.get("key") != (c[s], k[s]):
                    held = {"key": (c[s], k[s]), "cell": int(c[s])}
                ids, raw = part.column("id").to_numpy(), part.column("vec").to_pylist()
                if kind[s] == 0:
                    new = {"ids": ids, "m": part.column("m").to_numpy(), "vectors": unit(raw), "errors": part.column("error").to_numpy(), "codes": np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(len(raw), -1)}
                    for name, value in new.items():
                        held[name] = np.concatenate([held[name], value]) if name in held else value
                else:
                    for at in range(0, len(raw), QUERY_BATCH):
                        if (out := ask(ids[at : at + QUERY_BATCH], raw[at : at + QUERY_BATCH])) is not None:
                            yield out

    rows = listed.unionByName(asking).repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "kind", "id")
    return rows.mapInArrow(solve, "a long, b long, n long")


def dedup(table: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for every row of ``table``."""
    rows = common.written(prepare(table, id_col, vector_col), "vectors")
    # a class whose rows all lack an id can't be named and takes no part
    classes = rows.where("dim > 0").groupBy("f1", "f2", "dim").agg(F.min("id").alias("id"), F.count("*").alias("m"), F.first("vec").alias("vec")).where("id is not null")
    classes = common.written(classes, "classes")
    hits = None
    for r in classes.select("dim").distinct().collect():
        part = found(classes.where(F.col("dim") == r.dim).select("id", "m", "vec"), threshold)
        hits = part if hits is None else hits.unionAll(part)
    if hits is None:
        hits = rows.sparkSession.createDataFrame([], "a long, b long, n long")
    hits = common.written(hits, "hits")
    count = hits.where("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("far"))
    roots = common.components(hits.where("n is null").select("a", "b")).select(F.col("node").alias("id"), "root")
    labels = classes.select("f1", "f2", "id", "m").join(count, "id", "left").join(roots, "id", "left")
    labels = common.written(labels.select("f1", "f2", (F.coalesce("far", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "id").alias("component")), "labels")
    linked = rows.where("dim > 0").select("id", "f1", "f2").join(labels, ["f1", "f2"], "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component")
    alone = rows.where("dim = 0").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionAll(alone).select(
        F.col("id").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept")
    )


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "embeddings"))
