"""Labels to perturbations: parsing, selection, guides and clusters. Work is done on distinct labels, then joined to cells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guidewell.functions.expressions import is_missing, stripped
from guidewell.model import broadcast_if_small


@dataclass(frozen=True)
class Parsed:
    """``cells``: the given cells with label, is_control, is_model, active (sorted 1-based perturbation numbers)."""

    cells: DataFrame
    perturbations: list[str]
    table: DataFrame  # p_idx, perturbation


def clean(cells: DataFrame, column: str, what: str, name: str) -> DataFrame:
    """Add ``name``, the column as text; the first missing or empty value by row raises."""
    distinct_values(cells, column, what)
    return cells.withColumn(name, F.col(column).cast("string"))


def distinct_values(cells: DataFrame, column: str, what: str) -> DataFrame:
    """label, first_row: each value of a column as text with its first row, kept in memory; the first missing or empty value by row raises."""
    kind = dict(cells.dtypes)[column]
    value = F.when(is_missing(F.col(column), kind), F.lit(None)).otherwise(F.col(column).cast("string"))
    known = cells.select(value.alias("label"), "row_id").groupBy("label").agg(F.min("row_id").alias("first_row")).persist()
    row = known.where("label is null or label = ''").agg(F.min("first_row")).first()[0]
    if row is not None:
        known.unpersist()
        raise ValueError(f"Missing or empty {what} label at row {row}")
    return known


def label_tokens(known: DataFrame, mode: str, control: str) -> DataFrame:
    """label, first_row, is_control, tokens (distinct, in order; none for the control) per distinct label."""
    known = known.withColumn("is_control", F.col("label") == control)
    raw = F.array("label") if mode == "single" else F.transform(F.split("label", r"\+", -1), stripped)
    known = known.withColumn("raw", F.when(F.col("is_control"), F.array().cast("array<string>")).otherwise(raw))
    if mode == "multilabel":
        rule = F.when(F.exists("raw", lambda t: t == ""), "malformed").when(F.exists("raw", lambda t: t == control), "control")
        bad = known.withColumn("rule", rule).where("rule is not null").agg(F.min(F.struct("first_row", "label", "rule"))).first()[0]
        if bad is not None:
            why = "Malformed perturbation value" if bad["rule"] == "malformed" else "Control label inside a combination"
            raise ValueError(f"{why} {bad['label']!r} at row {bad['first_row']}")
    return known.select("label", "first_row", "is_control", F.array_distinct("raw").alias("tokens"))


def ordered_perturbations(tokens: DataFrame) -> DataFrame:
    """token, first: distinct perturbations in order of first appearance (row, then position in the label)."""
    return tokens.select("first_row", F.posexplode("tokens").alias("pos", "token")).groupBy("token").agg(F.min(F.struct("first_row", "pos")).alias("first"))


def select_perturbations(known: list[str], wanted: list[str] | None) -> list[str]:
    if not known:
        raise ValueError("No non-control perturbation labels found")
    if wanted is None:
        return known
    if len(set(wanted)) != len(wanted):
        raise ValueError("Requested perturbations must be unique")
    if missing := sorted(set(wanted) - set(known)):
        raise ValueError(f"Requested perturbations not present in the labels: {', '.join(missing)}")
    return list(wanted)


def parse(cells: DataFrame, column: str, mode: str, control: str, wanted: list[str] | None = None) -> Parsed:
    """A cell is modelled if it is a control or all its perturbations are selected; others stay with an empty active set."""
    spark = cells.sparkSession
    tokens = label_tokens(distinct_values(cells, column, "perturbation"), mode, control)
    chosen = select_perturbations([r["token"] for r in ordered_perturbations(tokens).orderBy("first").collect()], None if wanted is None else list(wanted))
    table = spark.createDataFrame(list(enumerate(chosen, 1)), "p_idx int, perturbation string")
    near = broadcast_if_small(table, 64 * len(chosen))
    found = tokens.select("label", F.explode("tokens").alias("perturbation"), F.size("tokens").alias("n")).join(near, "perturbation")
    found = found.groupBy("label").agg(F.array_sort(F.collect_list("p_idx")).alias("active"), F.max("n").alias("n")).where(F.size("active") == F.col("n")).drop("n")
    known = tokens.select("label", "is_control").join(found, "label", "left").select("label", "is_control", F.coalesce("active", F.array().cast("array<int>")).alias("active"))
    cells = cells.withColumn("label", F.col(column).cast("string")).join(known, "label").withColumn("is_model", F.col("is_control") | (F.size("active") > 0))
    return Parsed(cells, chosen, table)


def single_codes(cells: DataFrame) -> DataFrame:
    """``cells`` with p_idx: the one perturbation of each cell, 0 for controls and null for cells that are not modelled; a cell of several raises."""
    several = cells.where(F.size("active") > 1).agg(F.min("row_id")).first()[0]
    if several is not None:
        raise ValueError(f"Single mode takes one perturbation a cell, row {several} has more")
    return cells.withColumn("p_idx", F.when(F.col("is_control"), F.lit(0)).otherwise(F.get("active", F.lit(0))))


def guides(cells: DataFrame) -> DataFrame:
    return cells.select("row_id", F.explode("active").alias("p_idx"))


def active_sets(cells: DataFrame) -> DataFrame:
    """Cells of each exact active set."""
    return cells.where(F.size("active") > 0).groupBy("active").agg(F.count("*").alias("n_cells"))


def multiplicity(cells: DataFrame) -> DataFrame:
    """Over all cells: controls and cells that are not modelled have multiplicity 0."""
    k = F.size("active")
    return cells.agg(F.min(k).alias("min"), F.max(k).alias("max"), F.avg(k).alias("mean"), F.count_if(k == 0).alias("zero_count"), F.count_if(k == 1).alias("single_count"), F.count_if(k > 1).alias("multi_count"))


def cluster_codes(cells: DataFrame, column: str) -> DataFrame:
    """cluster, code: clusters in order of first appearance; every cell must have one."""
    named = clean(cells, column, "background cluster", "cluster")
    first = named.groupBy("cluster").agg(F.min("row_id").alias("first_row"))
    return first.select("cluster", (F.row_number().over(Window.orderBy("first_row")) - 1).alias("code"))


def resolve(cells: DataFrame, control: str, wanted: list[str] | None = None, null_labels: tuple[str, ...] = ()) -> list[str]:
    """Distinct labels but the control and null labels, in order; ``wanted`` is taken without its repeats."""
    usable = cells.where(F.col("label").isNotNull() & (F.col("label") != control) & ~F.col("label").isin(*null_labels)) if null_labels else cells.where(F.col("label").isNotNull() & (F.col("label") != control))
    known = [r["label"] for r in usable.groupBy("label").agg(F.min("row_id").alias("f")).orderBy("f").collect()]
    if wanted is None:
        return known
    wanted = list(dict.fromkeys(wanted))
    if missing := sorted(set(wanted) - set(known)):
        raise ValueError(f"Requested perturbations not present in the labels: {', '.join(missing)}")
    return wanted
