"""Whitening of embeddings through distributed block matrices.

1. Vectors become whole numbers x = floor(scale * c) + offset and are written once under contiguous row numbers.
2. Centred rows (n x - S) / n are gathered into blocks of `block_rows` rows, by row number, as Spark's BlockMatrix (the last block ends with zero rows).
3. Transposed times itself gives the scatter. The product meets only blocks of equal number; the middle dimension is split so that a task holds about
   16 pairs of blocks. A BlockMatrix keeps its block numbers on the driver, so more than `panel_blocks` blocks go panel by panel and the panels' scatters are added up.
4. The covariance (width x width) is decomposed on the driver; the whitening matrix holds the eigenvectors over the roots of their eigenvalues.
5. The centred blocks, laid out as a square grid, times a block-diagonal of the whitening matrix gives the projected rows. (In one tall column of blocks Spark's grid
   partitioner would use only about the root of the number of partitions.)

Defined results: vectors that are null or hold null or non-finite entries take no part; vectors shorter than the longest one have zero entries (x = offset) at the missing
places; null and repeated ids are rows of their own; entries beyond 2**62 are held there; a deviation beyond a long is given as the largest long; components are fewer than
asked for where the vectors are shorter or the covariance has a lower rank (eigenvalues up to width * 2**-52 of the largest count as zero), so one vector, or equal
vectors, give no rows; other columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.llm.vectors import LONG_MAX, exact_type, whole
from riskspark.session import shared_folder

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
BLOCK = T.StructType([
    T.StructField("at", T.StructType([T.StructField("blockRowIndex", T.LongType()), T.StructField("blockColIndex", T.LongType())])),
    T.StructField("subMatrix", MatrixUDT())])
_solid = lambda name, kind: pa.field(name, kind, nullable=False)
_list = lambda kind: pa.list_(_solid("element", kind))
#: Arrow form of Spark's matrix type.
MATRIX = pa.struct([_solid("type", pa.int8()), _solid("numRows", pa.int32()), _solid("numCols", pa.int32()), pa.field("colPtrs", _list(pa.int32())),
                    pa.field("rowIndices", _list(pa.int32())), pa.field("values", _list(pa.float64())), _solid("isTransposed", pa.bool_())])
AT = pa.struct([("blockRowIndex", pa.int64()), ("blockColIndex", pa.int64())])


def numbered(vectors: DataFrame, scale: int, offset: int) -> DataFrame:
    """vec_id, x and contiguous row numbers from 0, written once so that a lost executor cannot change them."""
    spark, folder = vectors.sparkSession, shared_folder(vectors.sparkSession, "numbered-vectors")
    vectors.select("vec_id", whole("embedding", scale, offset).alias("x")).where("x IS NOT NULL").withColumn("id", F.monotonically_increasing_id()).write.parquet(folder)
    rows = spark.read.parquet(folder).withColumns({"part": F.shiftright("id", 33), "place": F.col("id").bitwiseAND((1 << 33) - 1)})
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each written partition
    starts = rows.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, "part").select("vec_id", "x", (F.col("start") + F.col("place")).alias("row"))


def _matrix(rows: np.ndarray) -> dict:
    return {"type": 1, "numRows": rows.shape[0], "numCols": rows.shape[1], "colPtrs": None, "rowIndices": None, "values": rows.ravel(order="F"), "isTransposed": False}


def _array(m: dict) -> np.ndarray:
    shape = (m["numRows"], m["numCols"])
    values = np.asarray(m["values"], np.float64)
    return values.reshape(shape) if m["isTransposed"] else values.reshape(shape, order="F")


class Blocks:
    """Centred rows of a table of whole vectors as block matrices."""

    def __init__(self, rows: DataFrame, n: int, sums: list[int], largest: int, block_rows: int, offset: int):
        self.rows, self.n, self.sums, self.width, self.block_rows, self.offset = rows, n, sums, len(sums), block_rows, offset
        self.kind = exact_type(2 * n * max(largest, 1))
        self.number = -(-n // block_rows)

    def panel(self, first: int, last: int, columns: int) -> tuple[object, int]:
        """Java block matrix of the blocks from `first` to before `last`, `columns` of them side by side, and its number of block rows."""
        n, width, block_rows, kind, fill = self.n, self.width, self.block_rows, self.kind, self.offset
        sums = np.array(self.sums, dtype=object).astype(kind)

        def run(group: pa.Table) -> pa.Table:
            block, x = group.column("block")[0].as_py(), np.full((group.num_rows, width), fill, np.int64)
            lists = group.column("x").combine_chunks()
            length = np.asarray(lists.value_lengths(), np.int64)
            flat = np.asarray(lists.flatten(), np.int64)
            x[np.repeat(np.arange(len(length)), length), np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
            out = np.zeros((block_rows, width))
            place = group.column("row").to_numpy() - block * block_rows
            out[place] = ((n * x.astype(kind) - sums) / n).astype(np.float64)
            i = block - first
            return pa.table({"at": pa.array([{"blockRowIndex": i // columns, "blockColIndex": i % columns}], AT), "subMatrix": pa.array([_matrix(out)], MATRIX)})
        number = F.floor(F.col("row") / block_rows)
        part = self.rows.where(F.col("row").between(first * block_rows, last * block_rows - 1)).withColumn("block", number)
        made = part.groupBy("block").applyInArrow(run, BLOCK)
        height = -(-(last - first) // columns)
        return callMLlibFunc("createBlockMatrix", made, block_rows, width, height * block_rows, columns * width), height

    def scatter(self, panel_blocks: int) -> np.ndarray:
        """Sum of the outer products of the centred rows."""
        total = np.zeros((self.width, self.width))
        for first in range(0, self.number, panel_blocks):
            last = min(self.number, first + panel_blocks)
            tall, _ = self.panel(first, last, 1)
            splits = max(1, -(-(last - first) // 16))
            total += BlockMatrix(tall.transpose().multiply(tall, splits), self.width, self.width).toLocalMatrix().toArray()
        return (total + total.T) / 2

    def project(self, onto: np.ndarray, panel_blocks: int) -> DataFrame:
        """row and w = centred row times `onto`, written to the shared folder."""
        spark: SparkSession = self.rows.sparkSession
        folder, width, block_rows, n = shared_folder(spark, "projected"), self.width, self.block_rows, self.n
        for first in range(0, self.number, panel_blocks):
            last = min(self.number, first + panel_blocks)
            columns = int(np.ceil(np.sqrt(last - first)))
            grid, height = self.panel(first, last, columns)
            one = Matrices.dense(width, onto.shape[1], onto.ravel(order="F").tolist())
            diagonal = spark.sparkContext.parallelize([((j, j), one) for j in range(columns)], 1)
            product = grid.multiply(BlockMatrix(diagonal, width, onto.shape[1], columns * width, columns * onto.shape[1])._java_matrix_wrapper._java_model)

            def run(batches: Iterator[pa.RecordBatch], first: int = first, columns: int = columns) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for k in range(batch.num_rows):
                        i, j, m = (c[k].as_py() for c in batch.columns)
                        start = (first + i * columns + j) * block_rows
                        w = _array(m)[:max(0, min(block_rows, n - start))]
                        yield pa.record_batch({"row": np.arange(start, start + len(w)), "w": pa.ListArray.from_arrays(
                            pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(np.ascontiguousarray(w).ravel()))})
            blocks = callMLlibFunc("getMatrixBlocks", product).toDF("at", "m")
            blocks.select("at._1", "at._2", "m").mapInArrow(run, "row long, w array<double>").write.mode("append").parquet(folder)
        return spark.read.parquet(folder)


def _identity_error(projected: DataFrame, n: int, r: int) -> float:
    """Largest absolute entry of the covariance of w minus the identity."""
    w = [F.col("w")[i] for i in range(r)]
    mean = projected.agg(*[F.avg(x) for x in w]).first()
    pairs = [(i, j) for i in range(r) for j in range(i, r)]
    products = projected.agg(*[F.sum((w[i] - mean[i]) * (w[j] - mean[j])) for i, j in pairs]).first()
    return max(abs(products[k] / n - (i == j)) for k, (i, j) in enumerate(pairs))


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, offset: int = 100_000, block_rows: int = 2048, panel_blocks: int = 1 << 17) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every vector and component."""
    spark = vectors.sparkSession
    rows = numbered(vectors, scale, offset)
    places = rows.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(
        F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("m"), F.min("v").alias("least"), F.max("v").alias("most")).orderBy("d").collect()
    n, width = rows.count(), len(places)
    if not places:
        return spark.createDataFrame([], RESULT)
    sums = [int(p.s) + (n - p.m) * offset for p in places]
    least, most = min([offset] + [p.least for p in places]), max([offset] + [p.most for p in places])
    blocks = Blocks(rows, n, sums, max(abs(least), abs(most)), block_rows, offset)
    covariance = blocks.scatter(panel_blocks) / n
    value, vector = np.linalg.eigh(covariance)
    value, vector = value[::-1], vector[:, ::-1]
    r = int((value[:components] > width * 2.0 ** -52 * max(value[0], 0)).sum())
    if not r:
        return spark.createDataFrame([], RESULT)
    projected = blocks.project(vector[:, :r] / np.sqrt(value[:r]), panel_blocks)
    error = _identity_error(projected, n, r)
    explained = F.array(*[F.lit(float(v / np.trace(covariance))) for v in value[:r]])
    # Longs where a bound proves them wide enough, else decimals.
    kind = "long" if width * (n * (most - least)) ** 2 <= LONG_MAX and n * max(abs(least), abs(most)) <= LONG_MAX else "decimal(38,0)"
    total = F.array(*[F.lit(str(s)).cast(kind) for s in sums])
    x = F.concat("x", F.array_repeat(F.lit(offset).cast("long"), F.lit(width) - F.size("x")))
    away = F.zip_with(x, total, lambda v, s: (F.try_multiply(v.cast(kind), F.lit(str(n)).cast(kind)) - s).cast(kind))
    square = F.aggregate(away, F.lit("0").cast(kind), lambda a, d: F.try_add(a, F.try_multiply(d, d).cast(kind)).cast(kind))
    deviation = F.coalesce(F.least(square, F.lit(str(LONG_MAX)).cast(kind)), F.lit(str(LONG_MAX)).cast(kind)).cast("long")
    each = rows.select("vec_id", "row", deviation.alias("deviation")).join(projected, "row")
    return each.select("vec_id", "deviation", F.posexplode("w").alias("c", "whitened")).select(
        "vec_id", (F.col("c") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("c")).alias("explained"), F.lit(float(error)).alias("identity_error"))
