"""Data sets from Parquet folders, from rows in memory, from h5ad files where the reader is installed, and from the driver's tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from guidewell.model import PerturbData


def open_dataset(spark: SparkSession, path: str) -> PerturbData:
    return read_h5ad(spark, path) if path.endswith(".h5ad") else read_folder(spark, path)


def read_folder(spark: SparkSession, path: str) -> PerturbData:
    """``cells.parquet``, ``genes.parquet`` and ``expr.parquet`` below ``path``; ``expr`` may be partitioned by layer."""
    return PerturbData(*[spark.read.parquet(f"{path.rstrip('/')}/{name}.parquet") for name in ("cells", "genes", "expr")])


def write_folder(data: PerturbData, path: str) -> None:
    for name in ("cells", "genes", "expr"):
        frame = getattr(data, name)
        writer = frame.write.mode("overwrite")
        (writer.partitionBy("layer") if "layer" in frame.columns else writer).parquet(f"{path.rstrip('/')}/{name}.parquet")


def from_rows(spark: SparkSession, matrix: Sequence[Sequence[float]], obs: dict[str, Sequence[Any]], obs_index: Sequence[str] | None = None, gene_names: Sequence[str] | None = None, highly_variable: Sequence[bool] | None = None) -> PerturbData:
    """A small matrix in memory (cells by genes)."""
    n_genes = len(matrix[0]) if len(matrix) else len(gene_names or [])
    index = [str(i) for i in range(len(matrix))] if obs_index is None else list(obs_index)
    names = list(obs)
    cells = spark.createDataFrame([(i, index[i], *[None if obs[c][i] is None else str(obs[c][i]) for c in names]) for i in range(len(matrix))], "row_id long, obs_index string, " + ", ".join(f"`{c}` string" for c in names))
    genes = [(g, gene_names[g] if gene_names else f"g{g + 1}", *([bool(highly_variable[g])] if highly_variable is not None else [])) for g in range(n_genes)]
    genes = spark.createDataFrame(genes, "gene_id int, gene_name string" + (", highly_variable boolean" if highly_variable is not None else ""))
    rows = [(i, [g for g, x in enumerate(r) if x], [float(x) for x in r if x]) for i, r in enumerate(matrix)]
    return PerturbData(cells, genes, spark.createDataFrame(rows, "row_id long, indices array<int>, values array<double>"))


def read_h5ad(spark: SparkSession, path: str, chunk: int = 8192) -> PerturbData:
    """Row ranges of an h5ad file are read by tasks; needs the anndata package on driver and executors."""
    try:
        import anndata
    except ImportError as e:
        raise ImportError("reading .h5ad needs the anndata package; write the data with write_folder instead") from e
    import pandas as pd

    head = anndata.read_h5ad(path, backed="r")
    obs = head.obs.copy()
    obs.insert(0, "obs_index", head.obs_names.astype(str))
    obs.insert(0, "row_id", range(len(obs)))
    var = pd.DataFrame({"gene_id": range(head.n_vars), "gene_name": head.var_names.astype(str)})
    if "highly_variable" in head.var:
        var["highly_variable"] = head.var["highly_variable"].to_numpy(dtype=bool)
    names = [None, *head.layers.keys()]

    def rows(batches):
        import anndata
        from scipy import sparse

        data = anndata.read_h5ad(path, backed="r")
        for pdf in batches:
            for layer, lo in zip(pdf["layer"], pdf["lo"], strict=True):
                part = sparse.csr_matrix((data.X if layer is None else data.layers[layer])[lo : lo + chunk])
                cut = [slice(a, b) for a, b in zip(part.indptr, part.indptr[1:], strict=False)]
                yield pd.DataFrame({"layer": layer, "row_id": range(lo, lo + part.shape[0]), "indices": [part.indices[c] for c in cut], "values": [part.data[c].astype(float) for c in cut]})

    ranges = spark.createDataFrame([(layer, lo) for layer in names for lo in range(0, head.n_obs, chunk)], "layer string, lo long").repartition(max(1, head.n_obs // chunk))
    expr = ranges.mapInPandas(rows, "layer string, row_id long, indices array<int>, values array<double>")
    return PerturbData(spark.createDataFrame(obs), spark.createDataFrame(var), expr)


def order_screen(spark: SparkSession, sf_dir: str) -> PerturbData:
    """The driver's tables as a screen: orders are cells, part brands genes, summed quantities counts.

    Cell attributes: priority (single label), combo (several, joined with +), wide (up to five), segment (cluster).
    """
    read = lambda name, *cols: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)
    orders = read("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    customers = read("customer", "c_custkey", "c_mktsegment")
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    combo = F.when(priority == "5-LOW", "control").when(status == "F", priority).when(status == "O", F.concat(priority, F.lit("+O"))).otherwise(F.lit("O"))
    also = [F.when(status == "O", "O"), *[F.when(F.col("o_custkey") % k == 0, F.lit(name)) for k, name in ((2, "second"), (3, "third"), (5, "fifth"))]]
    wide = F.when(priority == "5-LOW", "control").otherwise(F.concat_ws("+", priority, *also))
    cells = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderkey").cast("string").alias("obs_index"), priority.alias("priority"), combo.alias("combo"), wide.alias("wide"), F.col("c_mktsegment").alias("segment"))
    parts = read("part", "p_partkey", "p_brand")
    genes = parts.select("p_brand").distinct().select((F.row_number().over(Window.orderBy("p_brand")) - 1).alias("gene_id"), F.col("p_brand").alias("gene_name"), (F.substring("p_brand", -1, 1).cast("int") % 2 == 0).alias("highly_variable"))
    brand = parts.join(F.broadcast(genes.select("gene_id", "gene_name")), F.col("p_brand") == F.col("gene_name")).select("p_partkey", "gene_id")
    # one exchange, on the order: both sums below find their rows together
    lines = read("lineitem", "l_orderkey", "l_partkey", "l_quantity").join(brand, F.col("l_partkey") == F.col("p_partkey"))
    counts = lines.select(F.col("l_orderkey").alias("row_id"), "gene_id", "l_quantity").repartition("row_id").groupBy("row_id", "gene_id").agg(F.sum("l_quantity").cast("double").alias("x"))
    expr = counts.where("x <> 0").groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("gene_id", "x"))).alias("e"))
    expr = expr.select("row_id", F.transform("e", lambda e: e["gene_id"]).alias("indices"), F.transform("e", lambda e: e["x"]).alias("values"))
    return PerturbData(cells, genes, expr)


def long_entries(data: PerturbData) -> DataFrame:
    """row_id, gene_id, x of the nonzeros."""
    return data.expr.select("row_id", F.explode(F.arrays_zip("indices", "values")).alias("e")).select("row_id", F.col("e.indices").alias("gene_id"), F.col("e.values").alias("x"))
