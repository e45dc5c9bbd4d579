"""Ordered computations: slices give what windows give, also with one key holding a third of the rows."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators import assess, corpus, numbering
from paperloom.plans import ordered
from paperloom.plans.ordered import running, top_of_group
from paperloom.workload.views import Tables


@pytest.fixture(scope="module")
def skewed(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 11).cast("string"))
    value = F.when(F.col("id") % 4 != 2, F.col("id") % 9)
    return spark.range(3000).select(key.alias("key"), ((F.col("id") * 7919) % 3001).alias("place"), value.alias("v"))


def columns():
    return {"rank": "r", "sums": {"s": F.col("v")}, "lasts": {"l": F.col("v")}, "lags": {"g": F.col("v")}}


def plain(df, keys, order):
    from pyspark.sql import Window as W

    by = W.partitionBy(*keys).orderBy(*order)
    so_far = by.rowsBetween(W.unboundedPreceding, W.currentRow)
    v = F.col("v")
    return df.withColumns({"r": F.row_number().over(by), "s": F.sum(v).over(so_far), "l": F.last(v, True).over(so_far), "g": F.lag(v).over(by)})


def rows_of(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("keys", [["key"], [], ["key", "other"]])
@pytest.mark.parametrize("order", [["place"], ["text", "place"], ["pair"]])
def test_slices_equal_windows(skewed, keys, order):
    """Order by numbers, texts and structs with nulls among them; the null key and the hot one count like others."""
    text = F.when(F.col("place") % 7 != 0, F.concat(F.lit("page "), F.col("place") % 5))
    rows = skewed.withColumns({"other": F.col("v") % 2, "text": text, "pair": F.struct(text.alias("t"), "place")})
    assert rows_of(running(rows, keys, order, **columns())) == rows_of(plain(rows, keys, order))


def test_only_hot_keys_are_cut(skewed):
    cut = ordered.sliced(skewed, ["key"], ["place"])
    slices = {r.key: r.n for r in cut.groupBy("key").agg(F.count_distinct("_slice").alias("n")).collect()}
    assert slices["hot"] > 5 and slices["5"] == 1
    largest = cut.filter("key = 'hot'").groupBy("_slice").count().agg(F.max("count")).first()[0]
    assert largest < 400 and cut.count() == 3000
    hot, cold = (ordered.sliced(skewed, ["key"], ["place"], how) for how in ("inner", "left_anti"))
    assert hot.count() + cold.count() == 3000 and {r.key for r in hot.select("key").distinct().collect()} >= {"hot"}


def test_empty_and_single_rows(skewed):
    for rows in (skewed.filter("false"), skewed.filter("place = 3")):
        assert rows_of(running(rows, ["key"], ["place"], **columns())) == rows_of(plain(rows, ["key"], ["place"]))
        assert rows_of(running(rows, [], ["place"], **columns())) == rows_of(plain(rows, [], ["place"]))


def test_building_starts_no_job(spark, skewed):
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup())
    running(skewed, ["key"], ["place"], **columns())
    running(skewed, [], ["place"], rank="r")
    assert set(tracker.getJobIdsForGroup()) == before


def test_top_of_group_limits_before_the_shuffle(skewed):
    top = top_of_group(skewed, ["key"], ["place"], 2)
    assert top.count() == 2 * skewed.select("key").distinct().count()
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("operator", ["claims", "pages", "pieces", "layout", "playlist"])
def test_operators_in_slices(spark, small, operator, monkeypatch):
    """The operators themselves, with every key cut wherever a row of it is sampled, and with none."""
    t = Tables(spark, small)
    pieces = t.replies.select(
        F.col("session_id").alias("stack"), F.struct("line", "question_id", "supplier", "price", "time_spent_seconds").alias("place"),
        F.col("question_id").alias("width"), F.col("supplier").alias("height"), F.col("line").alias("dx"), (-F.col("line")).alias("dy"),
    )
    pages = t.read("documents").select(F.concat_ws("/", "lang", F.concat("source", F.col("doc_id").cast("string"), F.lit(".png"))).alias("object_key"))
    made = {
        "claims": lambda: assess.reply_claims(assess.question_on_screen(t.updates)),
        "pages": lambda: corpus.number_pages(pages),
        "pieces": lambda: numbering.piece_groups(t.regions),
        "layout": lambda: numbering.stack_layout(pieces),
        "playlist": lambda: assess.playlist(t.questions),
    }[operator]
    monkeypatch.setattr(ordered, "HOT", 10**9)
    whole = rows_of(made())
    for name, value in {"HOT": 1, "THIN": 1, "PER_PARTITION": 400}.items():
        monkeypatch.setattr(ordered, name, value)
    assert rows_of(made()) == whole and whole


def test_checkpoint_folder_comes_from_the_session(spark):
    from paperloom.plans.session import ensure_checkpoint_dir

    assert ensure_checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()


def test_samples(spark):
    from paperloom.operators import draws

    pages = spark.range(500).withColumnRenamed("id", "page")
    one, other = (draws.sample_rows(p, "page", 60, "s").collect() for p in (pages, pages.repartition(7)))
    assert len(one) == 60 and sorted(one) == sorted(other)
    with pytest.raises(ValueError, match="nothing to sample"):
        draws.sample_rows(pages.limit(0), "page", 60, "s")
    assert draws.sample_rows(pages, "page", 9999, "s").count() == 500
