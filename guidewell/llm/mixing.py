"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, near_or_exchanged

UNIT = "struct<size:bigint,doc_id:bigint,rid:bigint,p:double>"
DONE = "array<struct<size:bigint,doc_id:bigint,rid:bigint,up:int>>"
ACC = f"struct<cur:{UNIT},out:{DONE}>"
#: Tables of at most so many rows (about 8 MB) are broadcast; larger ones are joined by exchange.
BROADCAST_ROWS = 100_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, max_repeat: float) -> DataFrame:
    """(source, source_size) with ``target``: weights repeat over sources by code point (null last), caps are filled first.

    The level at which no uncapped source is above its cap is found in one ordered pass: sources by cap / weight, of
    which a prefix is capped. It is one row per source, and so small beside the documents.
    """
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(max_repeat)).withColumn("ratio", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every) * float(share)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", level)
    level = F.coalesce(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"], F.lit(float("inf")))
    return s.withColumn("target", F.least("cap", F.col("weight") * level)).select("source", "source_size", "target")


def _unit_interval(seed: int, *columns: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _settled(unit: Column, up: Column | int) -> Column:
    return F.array(F.struct(unit["size"], unit["doc_id"], unit["rid"], F.lit(up).cast("int"))).cast(DONE)


def _merge(seed: int):
    """Fold a unit into what is left: words move between the two, as many as one gives the other takes, until one is certain.

    The unit left can rise by ``up`` (the new one then falls by as many words) or fall by ``down``; drawn with chances
    down : up, so that neither expectation changes. Their words together, size * p, stay as they are.
    """

    def merge(acc: Column, x: Column) -> Column:
        cur = acc["cur"]
        ratio = x["size"] / cur["size"]
        up, down = F.least(1.0 - cur["p"], x["p"] * ratio), F.least(cur["p"], (1.0 - x["p"]) * ratio)
        u = _unit_interval(seed, cur["doc_id"], cur["size"], x["doc_id"], x["size"])
        keep = lambda unit, p: F.struct(unit["size"], unit["doc_id"], unit["rid"], F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))).cast(UNIT)
        state = lambda left, decided: F.struct(left.alias("cur"), F.concat(acc["out"], decided).alias("out")).cast(ACC)
        rises = F.when(1.0 - cur["p"] <= x["p"] * ratio, state(keep(x, x["p"] - up / ratio), _settled(cur, 1))).otherwise(state(keep(cur, cur["p"] + up), _settled(x, 0)))
        falls = F.when(cur["p"] <= (1.0 - x["p"]) * ratio, state(keep(x, x["p"] + down / ratio), _settled(cur, 0))).otherwise(state(keep(cur, cur["p"] - down), _settled(x, 1)))
        first = F.struct(x.cast(UNIT).alias("cur"), acc["out"].alias("out")).cast(ACC)
        return F.when(cur.isNull(), first).when(u * (up + down) < down, rises).otherwise(falls)

    return merge


def _pivot(groups: DataFrame, seed: int) -> DataFrame:
    """``units`` (largest first) of each group: pairs transfer mass until at most one unit is fractional."""
    zero = F.struct(F.lit(None).cast(UNIT).alias("cur"), F.array().cast(DONE).alias("out")).cast(ACC)
    return groups.withColumn("acc", F.aggregate(F.col("units").cast(f"array<{UNIT}>"), zero, _merge(seed))).drop("units")


def _balance(groups: DataFrame, seed: int) -> DataFrame:
    """``units`` (largest first) of each source are decided in turn, each paired with all that come after it together.

    A unit becomes certain either way, with its probability; the words that it gains or gives up are taken from, or spread
    over, the later ones in proportion to what they have, or lack: their probabilities stay within 0 and 1, and all words
    together stay as they are. Where the later ones could only balance one outcome, that one is taken. The later
    probabilities are ``a * p + b``; ``words`` and ``sizes`` sum up size * p and size of those not yet decided.
    """
    kind = f"struct<a:double,b:double,words:double,sizes:double,out:{DONE}>"
    add = lambda value: F.aggregate("units", F.lit(0.0), lambda t, x: t + value(x))
    zero = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), add(lambda x: x["size"] * x["p"]).alias("words"), add(lambda x: x["size"].cast("double")).alias("sizes"), F.array().cast(DONE).alias("out")).cast(kind)

    def decide(acc: Column, x: Column) -> Column:
        p = F.least(F.greatest(acc["a"] * x["p"] + acc["b"], F.lit(0.0)), F.lit(1.0))
        words, sizes = acc["words"] - x["size"] * x["p"], acc["sizes"] - x["size"]
        have = F.greatest(acc["a"] * words + acc["b"] * sizes, F.lit(0.0))
        lack = F.greatest(sizes - have, F.lit(0.0))
        gained, given = x["size"] * (1.0 - p), x["size"] * p
        can_rise, can_fall = gained <= have + 1e-6, given <= lack + 1e-6
        chance = _unit_interval(seed, x["doc_id"], x["size"]) < p
        rises = F.when(can_rise & can_fall, chance).when(can_rise, F.lit(True)).when(can_fall, F.lit(False)).otherwise(chance)
        part = F.least(F.lit(1.0), F.when(rises & (have > 0), gained / have).when(~rises & (lack > 0), given / lack).otherwise(0.0))
        b = acc["b"] * (1.0 - part) + F.when(rises, 0.0).otherwise(part)
        return F.struct((acc["a"] * (1.0 - part)).alias("a"), b.alias("b"), words.alias("words"), sizes.alias("sizes"), F.concat(acc["out"], _settled(x, rises)).alias("out")).cast(kind)

    return groups.withColumn("acc", F.aggregate(F.col("units").cast(f"array<{UNIT}>"), zero, decide)).drop("units")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_repeat: float = 2.0, seed: int = 17, block: int = 64, keep: int = 16, carry: bool = False) -> DataFrame:
    """Decide how often each document is taken so that each source's words come near its target.

    ``docs`` has doc_id, text and source. A source's documents all start from the same expected number of copies,
    target / source words; the whole part is certain and the fraction is rounded by the pivotal method: two fractional
    documents are paired, and words move at random from one to the other, as many as the other gives, until the
    probability of one is 0 or 1; what is left joins the next pair. A reduction tree does so over documents of like size
    (eighths of an octave): each block of ``block`` documents hands one fraction on to the next level, until a size class
    has at most ``keep`` left. These meet last: a source's largest first, each is paired with all later ones together. A
    source's words then miss its target by about its smallest documents, unless a document is so large that
    the others could not balance it; and no task sees more than a block, or ``keep`` documents a size class, however large
    a source is.

    Returns doc_id, size, source_size, target, copies and taken (size * copies) per row; with ``carry``, the columns of
    ``docs`` and copies, of rows taken at least once. Nulls: a null text has size 0, null sources are one source (the last), null ids are allowed.
    Documents of size 0 are taken with the whole part only (0 words either way). Repeated rows are decided one by one.
    An empty table gives no rows. Other columns are ignored unless carried. Draws depend on ids and sizes alone.
    """
    given = docs.columns
    # rows are told apart by their ids where those are unique; else by numbers, for which the whole rows are written once
    unique = carry and docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty()
    sized = docs.withColumns({"__size": word_count(), "__rid": F.col("doc_id").cast("long") if unique else F.monotonically_increasing_id()})
    if unique or not carry:
        sized = sized.select("doc_id", "source", "__size", "__rid")
    sized = cut(sized, "sized")
    rows = sized.select(F.col("__rid").alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("__size").alias("size"))
    rows = rows.withColumn("bin", F.when(F.col("size") > 0, F.floor(F.log2("size") * 8)).otherwise(-1).cast("int"))
    bins = cut(rows.groupBy("source", "bin").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "bins")
    targets = source_targets(bins.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_repeat)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = bins.select(F.col("source").alias("s"), F.col("bin").alias("b"), "n").join(targets, F.col("s").eqNullSafe(F.col("source"))).select(
        "s", "b", "n", "source_size", "target", F.floor(expected).cast("int").alias("whole"), (expected - F.floor(expected)).alias("p"), F.ceil(F.col("n") / block).alias("blocks"))
    plan = cut(plan, "plan")
    blocks, n_rows = plan.agg(F.max(F.when(F.col("p") > 0, F.col("blocks"))), F.count("*")).first()
    near = F.broadcast(plan) if n_rows <= BROADCAST_ROWS else plan
    rows = rows.join(near, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b"))).drop("s", "b")
    rows = rows.withColumn("fractional", (F.col("p") > 0) & (F.col("size") > 0))

    keys = ["source", "bin", "block"]
    unit = F.struct("size", "doc_id", "rid", "p")
    by_id = F.coalesce("doc_id", F.col("rid"))  # the same blocks however the table is split
    few = rows.where("fractional and n <= " + str(keep)).select("source", unit.alias("unit"))
    live = rows.where("fractional and n > " + str(keep))
    spread = F.pmod(F.xxhash64(F.lit(seed), by_id, F.col("size")), F.col("blocks"))
    fullest = live.withColumn("block", spread).groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if fullest > 16 * block:  # one id on very many rows: they are told apart by where they stand
        spread = F.pmod(F.xxhash64(F.lit(seed), by_id, F.col("rid")), F.col("blocks"))
    level = live.withColumn("block", spread).groupBy(*keys).agg(F.sort_array(F.collect_list(unit), False).alias("units"))
    level = cut(_pivot(level, seed), "pivot")
    levels = [level]
    left = lambda t: t.where("acc.cur is not null").select(*[k for k in keys if k in t.columns], F.col("acc.cur").alias("unit"))
    blocks = blocks or 0
    while blocks > keep:
        blocks = -(-blocks // block)
        level = left(level).withColumn("block", F.floor(F.col("block") / block))
        level = level.groupBy(*keys).agg(F.sort_array(F.collect_list("unit"), False).alias("units"))
        level = cut(_pivot(level, seed + len(levels)), "pivot")
        levels.append(level)
    last = left(level).select("source", "unit").unionByName(few).groupBy("source").agg(F.sort_array(F.collect_list("unit"), False).alias("units"))
    levels.append(cut(_balance(last, seed + len(levels)), "pivot"))
    done = reduce(DataFrame.unionByName, [t.select(F.inline("acc.out")).select("rid", "up") for t in levels])
    ups = done.where("up = 1").select(F.col("rid").alias("up_rid"))
    rows = rows.join(ups, F.col("rid") == F.col("up_rid"), "left").withColumn("copies", F.col("whole") + F.when(F.col("up_rid").isNotNull(), 1).otherwise(0))
    if carry:  # whole rows stay where they are while the ids taken are few enough to send
        taken = cut(rows.where("copies > 0").select(F.col("rid").alias("__taken"), "copies"), "taken")
        whole, key = (docs, "doc_id") if unique else (sized, "__rid")
        return whole.join(near_or_exchanged(taken), F.col(key) == F.col("__taken")).select(*given, "copies")
    return rows.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def op6_pivotal_mix(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")
