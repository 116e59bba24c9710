"""Near-duplicate vectors of one label: product quantisation, then exact cosines.

Coarse centroids and the codebooks of residual subspaces are fitted on a bounded sample. Every vector is indexed:
it goes to the inverted list of its nearest centroid, with one byte for each subspace of its residual. Every
vector probes the lists of its nearest centroids. In a list, a table of distances between the query's residual
and all code words gives asymmetric distances by look-up; what may reach the threshold, by the largest
quantisation error of the list, is reranked by exact cosine. Equal vectors are one class, so copies are not
expanded; lists are cut into tiles, so that a crowded list never lands in one task.

Links are not written out: a tile gives the number of links of each of its vectors, and as many links as span its
components. A link is found if one of the two probes the other's list; where both do, each counts the other once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import columns_of, connected_components, join_counted, materialize, worker_memory
from loomwright.llm.nearest import usable

THRESHOLD = 0.93
#: Vectors that centroids and codebooks are fitted on, at most about.
SAMPLE_ROWS = 20_000
#: Coarse lists: the square root of the number of vectors, between these; lists that a vector probes.
LEAST_LISTS, MOST_LISTS, PROBES = 64, 1024, 12
#: Subspaces, and code words of each.
SUBSPACES, WORDS = 8, 64
#: Rows of a tile of a list, on average, and queries whose distances are looked up at once.
TILE_ROWS, QUERY_ROWS = 1024, 64


def _kmeans(points: np.ndarray, k: int, seed: int = 7, rounds: int = 12) -> np.ndarray:
    pick = np.random.default_rng(seed)
    centres = points[pick.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        nearest = ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
        for i in range(len(centres)):
            own = points[nearest == i]
            if len(own):
                centres[i] = own.mean(axis=0)
    return centres


def _fit(points: np.ndarray, lists: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(coarse centroids, dimensions of each subspace, code words of each subspace)."""
    coarse = _kmeans(points, lists)
    residual = points - coarse[((coarse**2).sum(axis=1) - 2 * points @ coarse.T).argmin(axis=1)]
    parts = [p for p in np.array_split(np.arange(points.shape[1]), SUBSPACES) if len(p)]
    return coarse, parts, [_kmeans(residual[:, p], WORDS) for p in parts]


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int, kind: type = np.float64) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), kind).reshape(rows, -1)


class _Forest:
    """Components of the nodes of one tile; ``join`` says which of the nodes a query has to be linked with."""

    def __init__(self, n: int) -> None:
        self.part = np.arange(n)

    def join(self, node: int, others: np.ndarray) -> np.ndarray:
        parts, first = np.unique(self.part[others], return_index=True)
        new = parts != self.part[node]
        if new.any():
            self.part[np.isin(self.part, parts[new])] = self.part[node]
        return others[first[new]]


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row, linking rows of one label with cosine >= threshold.

    Rows whose label is null, or whose vector is null, empty, zero or holds null or non-finite components, link
    with nothing. Copies of a vector link with each other. Rows without a vec_id link with nothing and are kept;
    rows that repeat a vec_id are one node, whose links with other nodes are those of all its vectors. Other columns are not read; an empty table gives an
    empty one. Recall against brute force is measured by a test.
    """
    spark = vectors.sparkSession
    source = columns_of(vectors, "vec_id", "embedding", "label")
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    rows = source.where(good).select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    keyed = rows.select("vec_id", "label", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    classes = keyed.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.min_by("v", "vec_id").alias("v"), F.count("*").alias("size"))
    classes = materialize(classes, "classes")
    n, total = classes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not n:
        return source.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width = classes.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()["w"]
    some = classes.where(F.size("v") == width).where(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) * n < sample * 1_000_000).select("v").limit(2 * sample).collect()
    fit = np.array([r["v"] for r in some] or [[1.0] * width])
    lists = int(min(MOST_LISTS, max(LEAST_LISTS, np.sqrt(n))))
    model = spark.sparkContext.broadcast((*_fit(fit / np.linalg.norm(fit, axis=1, keepdims=True), lists), width))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory()
        coarse, parts, words, width = model.value
        for whole in batches:
            for at in range(0, whole.num_rows, TILE_ROWS):
                batch = whole.slice(at, TILE_ROWS)
                sizes = batch.column("v").value_lengths().to_numpy()
                # Other widths have a list of their own, by exact cosine only.
                homes: list[list[int]] = [[lists + int(x)] for x in sizes]
                codes, errors = [b""] * len(sizes), np.zeros(len(sizes))
                fine = np.nonzero(sizes == width)[0]
                if len(fine):
                    x = _matrix(batch.column("v").take(pa.array(fine)), len(fine))
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    near = np.argsort((coarse**2).sum(axis=1) - 2 * x @ coarse.T, axis=1, kind="stable")[:, :PROBES]
                    residual = x - coarse[near[:, 0]]
                    code = np.stack([((w**2).sum(axis=1) - 2 * residual[:, p] @ w.T).argmin(axis=1) for p, w in zip(parts, words, strict=True)], axis=1)
                    rebuilt = np.concatenate([w[code[:, s]] for s, w in enumerate(words)], axis=1)
                    errors[fine] = np.linalg.norm(residual[:, np.concatenate(parts)] - rebuilt, axis=1)
                    for i, own, c in zip(fine, near.tolist(), code.astype(np.uint8), strict=True):
                        homes[i], codes[i] = own, c.tobytes()
                columns = [*[batch.column(c) for c in ("label", "rep", "size", "v")], pa.array(homes, pa.list_(pa.int32())), pa.array(codes, pa.binary()), pa.array(errors)]
                yield pa.RecordBatch.from_arrays(columns, names=["label", "rep", "size", "v", "lists", "code", "error"])

    kind = dict(classes.dtypes)["label"]
    coded = materialize(classes.select("label", "rep", "size", "v").mapInArrow(assign, f"label {kind}, rep long, size long, v array<double>, lists array<int>, code binary, error double"), "codes")
    crowd = coded.groupBy("label", F.col("lists")[0].alias("list")).agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("tiles"))
    tile = lambda c: F.pmod(F.xxhash64(c), F.col("tiles")).cast("int")
    home = coded.withColumn("home", F.col("lists")[0])
    probing = home.select("label", F.col("rep").alias("q"), "size", "v", "home", F.explode("lists").alias("list")).join(crowd, ["label", "list"])
    # A query meets every tile of a list; queries are cut into as many tiles, and each index row meets all of those.
    probing = probing.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("j", tile("q"))
    index = home.withColumnRenamed("home", "list").join(crowd, ["label", "list"]).withColumn("i", tile("rep"))
    index = index.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def link(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return schema.empty_table()
        worker_memory()
        coarse, parts, words, _ = model.value
        x, y = (_matrix(t.column("v"), t.num_rows) for t in (left, right))
        x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
        reps, asked = left.column("rep").to_numpy(), right.column("q").to_numpy()
        sizes, weights = left.column("size").to_numpy(), right.column("size").to_numpy()
        centre, homes = left.column("list")[0].as_py(), right.column("home").to_numpy()
        quantised = centre < lists
        probed = left.column("lists").combine_chunks()
        back = np.zeros((len(x), lists + 1), bool)  # does an index row probe a query's list?
        if quantised:
            back[np.repeat(np.arange(len(x)), probed.value_lengths().to_numpy()), probed.flatten().to_numpy()] = True
            codes = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
            reach = (np.sqrt(max(0.0, 2 - 2 * threshold)) + left.column("error").to_numpy() + 1e-9) ** 2
        counts: dict[int, int] = {}
        nodes = {r: i for i, r in enumerate(dict.fromkeys([*reps.tolist(), *asked.tolist()]))}
        place = np.array([nodes[r] for r in reps.tolist()])
        forest, names, edges = _Forest(len(nodes)), np.array(list(nodes)), []
        for at in range(0, len(y), QUERY_ROWS):
            some = y[at : at + QUERY_ROWS]
            if quantised:
                residual = some - coarse[centre]
                tables = [((residual[:, None, p] - w[None]) ** 2).sum(axis=2) for p, w in zip(parts, words, strict=True)]
                near = sum(t[:, codes[:, s]] for s, t in enumerate(tables)) <= reach
            else:
                near = np.ones((len(some), len(x)), bool)
            for k in np.nonzero(near.any(axis=1))[0]:
                q = int(asked[at + k])
                hit = np.nonzero(near[k])[0]
                hit = hit[(x[hit] @ some[k] >= threshold) & (reps[hit] != q)]
                if not len(hit):
                    continue
                counts[q] = counts.get(q, 0) + int(sizes[hit].sum())
                if quantised:
                    for i in hit[~back[hit, homes[at + k]]].tolist():
                        counts[int(reps[i])] = counts.get(int(reps[i]), 0) + int(weights[at + k])
                edges += [(q, int(names[o])) for o in forest.join(nodes[q], place[hit])]
        out = [(a, a, c) for a, c in counts.items()] + [(a, b, 0) for a, b in edges]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ((), (), ()))], schema=schema)

    keys = ["label", "list", "i", "j"]
    left, right = (df.toDF(*df.columns).groupBy(*keys) for df in (index, probing))  # renamed: both come from one table
    found = materialize(left.cogroup(right).applyInArrow(link, "a long, b long, links long"), "links")

    parts_ = connected_components(found.where("a <> b").select("a", "b"))
    others = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("others"))
    known = (
        classes.drop("v").join(others, "rep", "left")
        .join(parts_.withColumnRenamed("id", "rep"), "rep", "left")
        .select("label", "h1", "h2", "size", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    members = join_counted(keyed.drop("v"), known, ["label", "h1", "h2"], total).select("vec_id", "n_links", "component_id")
    alone = source.where(~F.coalesce(good, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return members.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
