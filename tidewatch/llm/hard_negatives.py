"""Hard negatives from an inverted multi-index.

Vectors are cut into halves, each half has a codebook, and a pair of codewords
is a cell. What a cell can score at best against an anchor is the sum of two
half scores, each a codeword's score and its radius times the anchor's length,
so a heap over the two sorted lists of half scores meets cells in the order of
that bound. A search runs twice: a short probe of the best cells gives every
window a floor, then the heap runs until no window can gain from a lower bound.
The second run alone gives the result; it is exact.

Cells are packed into blocks of bounded size, large cells cut into several, and
an anchor travels to the blocks that hold its cells. There a block is held by a
task while the anchors stream past it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship_package
from .common import order_id, plain_id, written

BLOCK_ROWS = 4096
PROBE_ROWS = 4096
CELL_ROWS = 512  # on average, until a half has MOST_CODEWORDS
MOST_CODEWORDS = 64
SAMPLE_ROWS, SAMPLE_NUMBERS = 16384, 1 << 20  # bounds of what the codebooks are fitted on
EXACT = 2.0**53
_FOUND = "query long, window int, score long, id long, row long"
_ROUTED = ("block int, kind int, row long, id long, label long, cell int, vector binary, same boolean, "
           "cells array<int>, windows array<struct<low:double,high:double>>")


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A score is the inner product of two vectors whose components x are
    floor(scale * x). Rows where ``anchors`` holds are anchors. An anchor's positives are
    its best other rows of the same label; for each, the best rows of other labels
    that score between ``low`` and ``high`` percent of the positive's score, ends
    included, are its negatives. Ties go to smaller ids.

    Rows with a null label, a null vector, or any null or infinite component
    take no part. A null id comes before others in ties. Rows of one id are rows
    of their own: each can be found, and each is an anchor if its id says so.
    Missing components of a shorter vector count as 0. Components so large that
    scores would not be exact in 53 bits are an error. An empty table, or one
    without anchors, gives no rows. Other columns are never read.
    """
    index = _Index(_vectors(rows, anchors, scale, vec_id, embedding, label))
    queries = index.rows.where("anchor").select(F.col("row").alias("query"), "id", "label", "vector")
    everything = F.array(F.struct(F.lit(-math.inf).alias("low"), F.lit(math.inf).alias("high")))
    best = index.search(queries.withColumn("windows", everything), True, positives)
    best = best.join(queries.select("query", F.col("id").alias("anchor")), "query").select(
        "query", "anchor", "rank", F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    best = written(best, "positives")

    at = F.col("positive_score")
    bounds = F.struct(F.col("rank"), (-_hundredth(-low * at)).cast("double").alias("low"),
                      _hundredth(high * at).cast("double").alias("high"))
    windows = best.groupBy("query").agg(F.array_sort(F.collect_list(bounds)).alias("windows")).select(
        "query", F.transform("windows", lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"))).alias("windows"))
    found = index.search(queries.join(windows, "query"), False, negatives)
    found = found.select("query", (F.col("window") + 1).alias("positive_rank"), "rank", "id", "score")
    return found.join(best.withColumnRenamed("rank", "positive_rank"), ["query", "positive_rank"]).select(
        plain_id("anchor").alias("anchor_id"), plain_id("positive").alias("positive_id"), found["rank"],
        plain_id("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _hundredth(value: Column) -> Column:
    """A hundredth, rounded down."""
    return F.call_function("div", value - F.pmod(value, F.lit(100)), F.lit(100))


def _vectors(rows: DataFrame, anchors: Column, scale: int, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(id, label, anchor, size, top, vector) of the rows that take part; ``top`` is the largest component."""
    ship_package(rows.sparkSession)
    taking = rows.select(order_id(f"`{vec_id}`").alias("id"), F.col(f"`{label}`").cast("long").alias("label"),
                         F.coalesce(anchors, F.lit(False)).alias("anchor"),
                         F.col(f"`{embedding}`").cast("array<double>").alias("numbers"))
    taking = taking.where("label IS NOT NULL AND numbers IS NOT NULL AND NOT exists(numbers, x -> x IS NULL)")

    def quantize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = batch.column("numbers")
            flat = np.floor(numbers.flatten().to_numpy(zero_copy_only=False) * scale)
            ends = np.cumsum(numbers.value_lengths().to_numpy(zero_copy_only=False))
            vectors, kept, tops = [], [], []
            for at, vector in enumerate(np.split(flat, ends[:-1])):
                if np.isfinite(vector).all():
                    kept.append(at)
                    vectors.append(vector.tobytes())
                    tops.append(float(np.abs(vector).max(initial=0.0)))
            chosen = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [chosen.column("id"), chosen.column("label"), chosen.column("anchor"),
                 pa.array([len(v) // 8 for v in vectors], pa.int32()), pa.array(tops, pa.float64()),
                 pa.array(vectors, pa.binary())], names=["id", "label", "anchor", "size", "top", "vector"])

    return taking.mapInArrow(quantize, "id long, label long, anchor boolean, size int, top double, vector binary")


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    if size and len(vectors) and not vectors.null_count and pc.all(pc.equal(pc.binary_length(vectors), 8 * size)).as_py():
        first = np.frombuffer(vectors.buffers()[1], dtype=np.int32)[vectors.offset]
        return np.frombuffer(vectors.buffers()[2], dtype=np.float64, count=len(vectors) * size,
                             offset=int(first)).reshape(-1, size)
    made = np.zeros((len(vectors), size))
    for row, vector in enumerate(vectors):
        numbers = np.frombuffer(vector.as_buffer(), dtype=np.float64) if vector.is_valid else ()
        made[row, :len(numbers)] = numbers
    return made


def _codebook(points: np.ndarray, codewords: int, rounds: int = 8) -> np.ndarray:
    """k-means from a fixed start: the points are in the order of a hash."""
    centers = points[:codewords].copy()
    for _ in range(rounds if len(points) else 0):
        nearest = _nearest(points, centers)[0]
        for code in range(len(centers)):
            if (own := nearest == code).any():
                centers[code] = points[own].mean(axis=0)
    return centers


def _nearest(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest center and the distance to it."""
    squares = (points**2).sum(axis=1)[:, None] - 2 * points @ centers.T + (centers**2).sum(axis=1)
    nearest = squares.argmin(axis=1)
    return nearest, np.sqrt(((points - centers[nearest]) ** 2).sum(axis=1))


class _Index:
    """Codebooks, radii, cells and blocks (all of bounded size), and ``rows``: every vector with its cell."""

    def __init__(self, vectors: DataFrame):
        count, size, top = vectors.agg(F.count("*"), F.max("size"), F.max("top")).first()
        self.size = size = size or 0
        if size and size * (top or 0.0) ** 2 >= EXACT:
            raise ValueError("components are too large for exact scores")
        self.half = half = size // 2
        limit = max(1, min(SAMPLE_ROWS, SAMPLE_NUMBERS // max(size, 1)))
        sample = vectors.orderBy(F.xxhash64("vector", "id")).limit(limit).select("vector").toArrow().column(0)
        points = _matrix(sample.combine_chunks(), size)
        codewords = max(2, min(MOST_CODEWORDS, round(math.sqrt(count / CELL_ROWS))))
        self.books = books = [_codebook(points[:, :half], codewords), _codebook(points[:, half:], codewords)]
        self.codes = codes = max(len(books[0]), 1)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                matrix = _matrix(batch.column("vector"), size)
                first, far = _nearest(matrix[:, :half], books[0])
                second, wide = _nearest(matrix[:, half:], books[1])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("row", "id", "label", "anchor", "vector")),
                     pa.array((first * codes + second).astype(np.int32)), pa.array(far), pa.array(wide)],
                    names=["row", "id", "label", "anchor", "vector", "cell", "far", "wide"])

        numbered = vectors.withColumn("row", F.monotonically_increasing_id()).select(
            "row", "id", "label", "anchor", "vector")
        self.rows = written(numbered.mapInArrow(
            place, "row long, id long, label long, anchor boolean, vector binary, cell int, far double, wide double"),
            "cells")
        cells = self.rows.groupBy("cell").agg(F.count("*"), F.max("far"), F.max("wide")).orderBy("cell").collect()
        self.counts = np.zeros(codes * codes, dtype=np.int64)
        self.radii = np.zeros((2, codes * codes))
        self.first_block = np.zeros(codes * codes, dtype=np.int64)
        self.parts = np.ones(codes * codes, dtype=np.int64)
        block, room = 0, BLOCK_ROWS
        for cell, rows, far, wide in cells:
            self.counts[cell], self.radii[:, cell] = rows, (far, wide)
            if rows > room:
                block, room = block + (room < BLOCK_ROWS), BLOCK_ROWS
            self.first_block[cell], self.parts[cell] = block, max(1, math.ceil(rows / BLOCK_ROWS))
            block, room = (block, room - rows) if rows <= room else (block + self.parts[cell], BLOCK_ROWS)
        first, parts = (F.expr(f"get(array({','.join(map(str, table.tolist()))}), cell)")
                        for table in (self.first_block, self.parts))
        self.blocks = self.rows.select((first + F.pmod(F.xxhash64("row"), parts)).cast("int").alias("block"),
                                       F.lit(0).alias("kind"), "row", "id", "label", "cell", "vector")

    def search(self, queries: DataFrame, same: bool, most: int) -> DataFrame:
        """(query, window, rank, score, id, row): the best ``most`` rows in each window of
        scores, of the query's label (but for its own row) or of any other."""
        queries = queries.select("query", "label", "vector", "windows")
        probed = self._visited(queries, same, most, PROBE_ROWS)
        floors = probed.groupBy("query", "window").agg(F.max("rank").alias("n"), F.min("score").alias("score")) \
            .where(F.col("n") == most).groupBy("query").agg(F.map_from_entries(F.collect_list(
                F.struct("window", F.col("score").cast("double")))).alias("floors"))
        raised = queries.join(floors, "query", "left").withColumn("windows", F.transform("windows", lambda w, i: F.struct(
            F.greatest(w["low"], F.coalesce(F.element_at("floors", i), w["low"])).alias("low"), w["high"].alias("high"))))
        return self._visited(raised.drop("floors"), same, most, None)

    def _visited(self, queries: DataFrame, same: bool, most: int, budget: int | None) -> DataFrame:
        routed = queries.mapInArrow(self._route(same, budget), _ROUTED)
        both = self.blocks.unionByName(routed, allowMissingColumns=True).select(routed.columns)
        both = both.repartition("block").sortWithinPartitions("block", "kind")
        ranked = Window.partitionBy("query", "window").orderBy(F.desc("score"), "id", "row")
        return both.mapInArrow(_scores(self.size, self.codes, most), _FOUND) \
            .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= most)

    def _route(self, same: bool, budget: int | None):
        """Sends a query to the blocks of the cells that its heap meets."""
        books, codes, counts, radii, half = self.books, self.codes, self.counts, self.radii, self.half
        first_block, parts, size = self.first_block, self.parts, self.size
        # A codeword's radius is that of its widest cell.
        spread = [radii[0].reshape(codes, codes).max(axis=1), radii[1].reshape(codes, codes).max(axis=0)]

        def cells_of(vector: np.ndarray, windows: list[dict]) -> list[int]:
            ends = [vector[:half], vector[half:]]
            lengths = [float(np.sqrt((end**2).sum())) for end in ends]
            at = [book @ end for book, end in zip(books, ends)]
            bound = [at[i] + spread[i] * lengths[i] for i in (0, 1)]
            order = [np.argsort(-b, kind="stable") for b in bound]
            sums = [b[o].tolist() for b, o in zip(bound, order)]
            slack = 1e-6 + 1e-9 * sum(float(np.abs(b).max()) for b in bound)
            floor = min(w["low"] for w in windows) - slack
            found, rows, heap = [], 0, [(-sums[0][0] - sums[1][0], 0, 0)]
            while heap:
                negative, i, j = heapq.heappop(heap)
                if -negative < floor or (budget is not None and rows >= budget):
                    break
                if j + 1 < codes:
                    heapq.heappush(heap, (-sums[0][i] - sums[1][j + 1], i, j + 1))
                if j == 0 and i + 1 < codes:
                    heapq.heappush(heap, (-sums[0][i + 1] - sums[1][0], i + 1, 0))
                x, y = int(order[0][i]), int(order[1][j])
                cell = x * codes + y
                if not counts[cell]:
                    continue
                middle = at[0][x] + at[1][y]
                reach = radii[0][cell] * lengths[0] + radii[1][cell] * lengths[1] + slack
                if any(w["low"] <= middle + reach and middle - reach <= w["high"] for w in windows):
                    found.append(cell)
                    rows += int(counts[cell])
            return found

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                matrix = _matrix(batch.column("vector"), size)
                out = {name: [] for name in ("block", "at", "cells", "windows")}
                for at, windows in enumerate(batch.column("windows").to_pylist()):
                    windows = [w | {"low": w["low"] if w["low"] <= w["high"] else math.inf} for w in windows]
                    if all(w["low"] == math.inf for w in windows):
                        continue
                    there: dict[int, list[int]] = {}
                    for cell in cells_of(matrix[at], [w for w in windows if w["low"] < math.inf]):
                        for block in range(first_block[cell], first_block[cell] + parts[cell]):
                            there.setdefault(int(block), []).append(cell)
                    for block, cells in there.items():
                        for name, value in zip(out, (block, at, cells, windows)):
                            out[name].append(value)
                chosen = batch.take(pa.array(out["at"], pa.int64()))
                n = len(out["at"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(out["block"], pa.int32()), pa.array([1] * n, pa.int32()), chosen.column("query"),
                    pa.nulls(n, pa.int64()), chosen.column("label"), pa.nulls(n, pa.int32()), chosen.column("vector"),
                    pa.array([same] * n, pa.bool_()), pa.array(out["cells"], pa.list_(pa.int32())),
                    pa.array(out["windows"], pa.list_(pa.struct([("low", pa.float64()), ("high", pa.float64())])))],
                    names=["block", "kind", "row", "id", "label", "cell", "vector", "same", "cells", "windows"])
        return run


def _scores(size: int, codes: int, most: int):
    """Scores the queries of a block against its rows, which come first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, held = None, [], None
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            kinds = batch.column("kind").to_numpy()
            starts = np.flatnonzero(np.append(True, (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1]))) \
                if len(blocks) else []
            for start, end in zip(starts, [*starts[1:], len(blocks)]):
                if blocks[start] != block:
                    block, rows, held = blocks[start], [], None
                part = batch.slice(start, end - start)
                if kinds[start] == 0:
                    rows.append(part.select(["row", "id", "label", "cell", "vector"]))
                    continue
                if held is None:
                    held = _Held(pa.Table.from_batches(rows), size) if rows else False
                for at in range(0, part.num_rows if held else 0, 256):
                    yield held.best(part.slice(at, 256), codes, most)
    return run


class _Held:
    """The rows of a block."""

    def __init__(self, rows: pa.Table, size: int):
        self.size = size
        self.row, self.id, self.label, self.cell = (rows.column(c).to_numpy() for c in ("row", "id", "label", "cell"))
        self.matrix = _matrix(rows.column("vector").combine_chunks(), size)

    def best(self, queries: pa.RecordBatch, codes: int, most: int) -> pa.RecordBatch:
        scores = _matrix(queries.column("vector"), self.size) @ self.matrix.T
        names, labels, sames = (queries.column(c).to_pylist() for c in ("row", "label", "same"))
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        for at, (cells, windows) in enumerate(zip(queries.column("cells").to_pylist(),
                                                  queries.column("windows").to_pylist())):
            open_cells = np.zeros(codes * codes, dtype=bool)
            open_cells[cells] = True
            fits = open_cells[self.cell] & ((self.label == labels[at]) == sames[at]) & (self.row != names[at])
            places = np.flatnonzero(fits)
            own = scores[at, places]
            for window, bounds in enumerate(windows):
                inside = np.flatnonzero((own >= bounds["low"]) & (own <= bounds["high"]))
                if len(inside) > most:
                    inside = inside[own[inside] >= np.partition(own[inside], -most)[-most]]
                order = np.lexsort((self.row[places[inside]], self.id[places[inside]], -own[inside]))[:most]
                chosen = places[inside[order]]
                for column, values in zip(out, (np.full(len(chosen), names[at]), np.full(len(chosen), window),
                                                scores[at, chosen], self.id[chosen], self.row[chosen])):
                    column.append(values)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(column) if column else np.empty(0)).cast(kind) for column, kind in zip(out, kinds)],
            names=["query", "window", "score", "id", "row"])
