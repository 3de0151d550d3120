"""The pipeline's stages on the smallest tables: each keeps the columns, works on what the one before kept, and takes effect."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages(spark):
    from guidewell.llm.common import cut, table

    docs = first = table(spark, SF, "documents")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, SF), name)
        seen.append(docs.count())
        if name != "packing":
            assert docs.columns == first.columns and docs.dtypes == first.dtypes
            assert docs.join(before, "doc_id", "left_anti").isEmpty()
    assert seen[1] <= seen[0] and seen[3] <= seen[2] <= seen[1] and seen[5] > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_duplicates", "mixing", "packing"]
    none = first.where("false")
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
        assert none.isEmpty()


def test_near_copies_leave_one(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    rows, grams = [], {}
    for i in range(0, 120, 4):
        words = [f"w{x}" for x in rng.integers(0, 5000, 60 + 4 * i)]
        for j, share in enumerate((0, 0.004, 0.02, 0.2)):  # words replaced
            own = list(words)
            for at in rng.choice(len(own), max(int(j > 0), int(share * len(own))), replace=False):
                own[at] = f"x{i}-{j}-{at}"
            rows.append((i + j, " ".join(own)))
            grams[i + j] = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
    near = {i: {j for j in grams if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])} for i in grams}
    kept = set()
    for i in sorted(grams):
        group, todo = {i}, [i]
        while todo:
            todo = [j for k in todo for j in near[k] if j not in group and not group.add(j)]
        kept.add(min(group))
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert len(kept) < 100 and {r["doc_id"] for r in out.collect()} == kept


def test_crowded_groups_are_dealt_anew(spark):
    """A hundred copies with a few words changed each, and others, linked the same with a limit of five to a group."""
    from guidewell.llm.components import components
    from guidewell.llm.near_copies import near_copies

    base = [f"w{i * 37 % 211}" for i in range(300)]
    rows = [(i, " ".join(f"z{i}-{k}" if (k * 31 + i * 17) % 97 < i % 3 else w for k, w in enumerate(base))) for i in range(100)]
    rows += [(200 + i, " ".join(f"v{i}-{k}" for k in range(60))) for i in range(10)] + [(300, None), (301, ""), (302, "a b"), (303, "A b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [{(r.node, r.component) for r in components(near_copies(docs, crowd=crowd)).collect()} for crowd in (5, 4096)]
    assert found[0] == found[1] and (303, 302) in found[0] and len(found[0]) > 60


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_columns_of_any_name_pass_through(spark):
    """Names that operators give to their own columns, in every stage but the last."""
    from pyspark.sql import functions as F

    clash = ["copies", "ratio", "n_words", "kept", "score", "predicted", "key", "n", "rid", "size", "u", "component_id", "__n", "count"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40").select("doc_id", "text", "source").withColumns({c: F.concat(F.lit("user-"), F.col("doc_id")) for c in clash})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        found = out.collect()
        assert found and all(r[c] == f"user-{r.doc_id}" for r in found for c in clash), name


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_near_duplicates_equal_brute_force(spark):
    from guidewell.llm.common import table
    from guidewell.llm.simhash import fingerprint

    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    grams = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in rows}
    prints = {i: fingerprint(b" ".join(w), 5) for i, w in rows}
    near = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4 or grams[i] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])
    left, kept = {i for i, _ in rows}, set()
    while left:
        group, todo = set(), [min(left)]
        while todo:
            group.update(todo)
            left.difference_update(todo)
            todo = [j for j in left if any(near(i, j) for i in todo)]
        kept.add(min(group))
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert {r.doc_id for r in out.collect()} == kept and out.count() == len(kept) < len(rows)


def test_examples_need_no_rows_of_python(spark, monkeypatch):
    """Such rows start workers of a second kind, which hold an executor's memory beside the operators' own."""
    from pyspark.core.rdd import PipelinedRDD

    from guidewell.llm.features import examples

    docs = spark.range(40).selectExpr("id as doc_id", "concat('text ', id) as text")
    labels = spark.range(40).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    made, first = [], PipelinedRDD.__init__
    monkeypatch.setattr(PipelinedRDD, "__init__", lambda self, *a, **b: made.append(a) or first(self, *a, **b))
    found, totals = examples(docs, labels, "toxic", 8)
    rows = found.collect()
    assert len(rows) == 16 and {(r.y, r.text) for r in rows} == {(r.doc_id % 2, f"text {r.doc_id}") for r in rows} and sum(totals.values()) > 16
    assert found.dtypes == [("doc_id", "bigint"), ("text", "string"), ("y", "int")]
    assert examples(docs, labels.where("false"), "toxic", 8)[0].isEmpty()
    assert not made


def test_stages_send_small_batches(spark):
    """One megabyte at a time, also after an operator has set its own size; a size that the session names stays."""
    from guidewell.llm.common import bounded_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for name, stage in corpus_pipeline.STAGES:
        if name in ("toxicity", "mixing"):  # the one sets it as the others do but needs labels, the other has no Python
            continue
        for before, after in ((None, "1m"), ("4m", "1m"), ("3m", "3m")):
            session = spark.newSession()
            if before == "4m":
                bounded_batches(session)
            elif before:
                session.conf.set(key, before)
            stage(session, session.createDataFrame([(1, "a b c", "x")], "doc_id long, text string, source string"), SF)
            assert session.conf.get(key) == after, (name, before)


def test_a_batch_of_fewer_words_than_a_shingle(spark):
    from guidewell.llm.near_copies import near_copies

    for n in range(7):
        words = " ".join("abcdefg"[:n])
        docs = spark.createDataFrame([(1, words)], "doc_id long, text string")
        assert near_copies(docs).isEmpty(), n
        docs = spark.createDataFrame([(1, words), (2, words.upper())], "doc_id long, text string").coalesce(1)
        assert [(r.u, r.v) for r in near_copies(docs).collect()] == ([(2, 1)] if n else []), n
