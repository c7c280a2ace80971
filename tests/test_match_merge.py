import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rollmill.operators import nearest
from rollmill.operators.dedup import DuplicateCycleError, check_links, collapse, dedup_links
from rollmill.operators.match import match, number_rows
from rollmill.operators.merge import merge
from rollmill.operators.trigram import nearest_by_trigram, similar_texts, similarity, text_key
from rollmill.spec import MatchSpec, MergeSpec

S = "id long, k string, b string, v int"


def test_first_matching_group_wins_and_nulls_never_match(spark, rows):
    src = spark.createDataFrame([(1, "a", "x", 0), (2, None, "x", 0), (3, None, None, 0), (4, "q", "y", 0)], S)
    tgt = spark.createDataFrame([(10, "a", "z", 0), (11, "a", "z", 0), (12, None, "x", 0), (13, "q", "y", 0)], S)
    got = match(src, tgt, MatchSpec("id", "id").exact("k").exact("b"))
    assert rows(got, "id", "working_target_id", "match_step") == [(1, 10, 0), (2, 12, 1), (3, None, None), (4, 13, 0)]
    assert rows(got, "working_source_id") == [(1,), (2,), (3,), (4,)]


def test_empty_sides_and_clashing_extra_columns(spark, rows):
    src = spark.createDataFrame([(1, "a", "x", 0)], S).withColumn("tid", F.lit(7)).withColumn("sid", F.lit(8)).withColumn("ord", F.lit(9))
    none = spark.createDataFrame([], S)
    spec = MatchSpec("id", "id").exact("k")
    assert rows(match(src, none, spec), "id", "working_target_id", "tid", "sid", "ord") == [(1, None, 7, 8, 9)]
    assert match(none, src, spec).count() == 0
    assert rows(match(src, none, MatchSpec("id", "id")), "match_step") == [(None,)]
    assert rows(match(src, none, spec.fuzzy("k")), "match_step") == [(None,)]


def test_target_without_key_is_refused():
    with pytest.raises(ValueError):
        MatchSpec("", "id")


def test_constraints_do_not_pass_to_nested_matchers(spark, rows):
    src = spark.createDataFrame([(1, "a", "x", 5), (2, "b", "y", 5)], S)
    tgt = spark.createDataFrame([(10, "a", "-", 9), (11, "-", "y", 9)], S)
    spec = MatchSpec("id", "id").constrain("v", "$T < $S").exact("k").nested(MatchSpec("id", "id").exact("b"))
    assert rows(match(src, tgt, spec), "id", "working_target_id", "match_step") == [(1, None, None), (2, 11, 1)]


def test_join_table_restricts_the_step(spark, rows):
    src = spark.createDataFrame([(1, "a", "x", 1)], S)
    tgt = spark.createDataFrame([(10, "a", "p", 1), (11, "a", "q", 1)], S)
    extra = spark.createDataFrame([("q",)], "code string")
    spec = MatchSpec("id", "id").exact("k").join_table("j", extra, "j.code = t.b")
    assert rows(match(src, tgt, spec), "working_target_id") == [(11,)]


def test_fuzzy_pool_shrinks_but_not_by_nested_matches(spark, rows):
    src = spark.createDataFrame([(1, "alpha beta", "x", 0), (2, "alpha betas", "y", 0)], S)
    tgt = spark.createDataFrame([(10, "alpha beta", "n", 0)], S)
    direct = match(src, tgt, MatchSpec("id", "id").exact("k").fuzzy("k"))
    assert rows(direct, "id", "working_target_id") == [(1, 10), (2, None)]
    nested = match(src, tgt, MatchSpec("id", "id").nested(MatchSpec("id", "id").exact("k")).fuzzy("k"))
    assert rows(nested, "id", "working_target_id", "match_step") == [(1, 10, 0), (2, 10, 1)]


def test_similarity_of_the_manual(spark):
    got = spark.sql("SELECT 'word' a, 'two words' b").select(similarity(F.col("a"), F.col("b"))).first()[0]
    assert abs(got - 4 / 11) < 1e-12
    assert spark.sql("SELECT '' a, '--' b").select(similarity(F.col("a"), F.col("b"))).first()[0] is None


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("xyz")), max_size=12), st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("xyz")), max_size=12))
def test_one_pass_cascade_equals_sequential(spark, a, b):
    src = spark.createDataFrame([(i, k, x, 0) for i, (k, x) in enumerate(a)], S)
    tgt = spark.createDataFrame([(100 + i, k, x, 0) for i, (k, x) in enumerate(b)], S)
    got = {r["id"]: r["working_target_id"] for r in match(src, tgt, MatchSpec("id", "id").exact("k", "b").exact("b"), numbered=False).collect()}
    for i, (k, x) in enumerate(a):
        first = [100 + j for j, (l, y) in enumerate(b) if (k, x) == (l, y)] or [100 + j for j, (_, y) in enumerate(b) if x == y]
        assert got[i] == (min(first) if first else None)


@pytest.mark.parametrize("per", [1_000_000, 90])
def test_numbers_follow_the_key_over_many_parts(spark, per):
    df = spark.range(1000).select((1000 - F.col("id")).alias("k")).repartition(7)
    got = number_rows(df, "k", "n", rows_per_part=per).collect()
    assert sorted(r["n"] for r in got) == list(range(1, 1001)) and all(r["n"] == r["k"] for r in got)
    text = df.select(F.when(F.col("k") > 5, F.concat(F.lit("é"), "k")).alias("k"))
    got = sorted(number_rows(text, "k", "n", rows_per_part=per).collect(), key=lambda r: r["n"])
    assert [r["n"] for r in got] == list(range(1, 1001)) and [r["k"] for r in got[5:]] == sorted(r["k"] for r in got[5:]) and {r["k"] for r in got[:5]} == {None}


def test_upsert_rules(spark, rows):
    schema = "id long, name string, balance int, old_balance int, note string"
    tgt = spark.createDataFrame([(1, "a", 10, None, "keep"), (2, "b", 20, None, "keep")], schema)
    src = spark.createDataFrame([(91, "a", 5, None, None, 1), (92, "c", 6, None, "new", None), (93, None, 7, None, "no", None)], schema + ", working_target_id long")
    linked = number_rows(src, "id").withColumn("match_step", F.lit(0))
    rules = MergeSpec(constraints=(("name", "$S IS NOT NULL"), ("balance", "$T > 1"))).preserve("id").move(balance="old_balance").merge_column_as("balance", "$S + $T").insert_column_as("note", "concat($S, '!')")
    got = merge(tgt, linked, rules.return_value("t.balance", "out"), "id", "id")
    assert rows(got.target) == [(1, "a", 15, 10, None), (2, "b", 20, None, "keep"), (92, "c", 6, None, "new!")]
    assert rows(got.source, "id", "out") == [(91, 15), (92, 6), (93, None)]
    assert got.counts() == {"updated": 1, "inserted": 1}
    only = merge(tgt, linked, MergeSpec(update_only=True, insert_only=True), "id", "id").target
    assert rows(only) == rows(tgt)


def test_several_sources_of_one_target_and_generated_keys(spark, rows):
    tgt = spark.createDataFrame([(1, "a")], "id long, name string")
    src = spark.createDataFrame([(5, "x", 1), (4, "y", 1), (9, "new", None), (8, "newer", None)], "id long, name string, working_target_id long")
    linked = number_rows(src, "id").withColumn("match_step", F.lit(0))
    got = merge(tgt, linked, MergeSpec(generate_key=True).preserve("id").return_value("t.id", "key"), "id", "id")
    assert rows(got.target) == [(1, "y"), (2, "newer"), (3, "new")]
    assert rows(got.source, "id", "key") == [(4, 1), (5, None), (8, 2), (9, 3)]


def test_dedup_smallest_key_survives(spark, rows):
    t = spark.createDataFrame([(1, "x", "m", 1), (2, "x", "m", 2), (3, "x", "m", 3), (4, None, "m", 4), (5, "y", "m", 5)], S)
    spec = MatchSpec("id", "id").exact("k")
    links = dedup_links(t, spec)
    assert rows(links, "id", "working_target_id") == [(1, None), (2, 1), (3, 1), (4, None), (5, None)]
    got = collapse(t, links, MergeSpec().merge_column_as("v", "$S + $T"), "id")
    assert rows(got.target, "id", "v") == [(1, 3), (4, 4), (5, 5)]
    assert dedup_links(got.target, spec).where("working_target_id IS NOT NULL").count() == 0


def test_dedup_chain_raises(spark):
    t = spark.createDataFrame([(1, "a", "x", 0), (2, "a", "y", 0), (3, "b", "y", 0)], S)
    links = dedup_links(t, MatchSpec("id", "id").exact("k").exact("b"))
    assert tuple(check_links(links, "id").first()) == (0, 1)
    with pytest.raises(DuplicateCycleError):
        collapse(t, links, MergeSpec(), "id")
    with pytest.raises(ValueError):
        collapse(t, links, MergeSpec(update_only=True), "id")
    with pytest.raises(ValueError):
        dedup_links(t, MatchSpec("id", "id").fuzzy("k"))


def test_dedup_orientation(spark, rows):
    t = spark.createDataFrame([(1, "a", "x", 5), (2, "a", "x", 9), (3, "a", "x", 9)], S)
    links = dedup_links(t, MatchSpec("id", "id").exact("k"), (("v", "$T > $S"),))
    assert rows(links, "id", "working_target_id") == [(1, 2), (2, None), (3, None)]


@pytest.mark.parametrize("hot", [0, 3, 2_000])
def test_similar_texts_against_all_pairs(spark, hot):
    rng = random.Random(9)
    words = "red green blue lamp lamps table tables chair chairs old new oak elm ash 12 7 a".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((1, 2, 3, 4, 30)))) for _ in range(160)] + ["", "--", "x", "x y", "y x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(dict.fromkeys(texts))], "id long, text string").withColumn("k", text_key(F.col("text")))
    a, b = df.where("id % 2 = 0"), df.where("id % 3 < 2")
    got = {(bytes(r["st"]), bytes(r["tt"])): round(r["sim"], 9) for r in similar_texts(a, b, hot).collect()}
    every = a.select(F.col("k").alias("st"), F.col("text").alias("x")).crossJoin(b.select(F.col("k").alias("tt"), F.col("text").alias("y"))).withColumn("sim", similarity(F.col("x"), F.col("y"))).where("sim > 0.5")
    assert got == {(bytes(r["st"]), bytes(r["tt"])): round(r["sim"], 9) for r in every.collect()} and len(got) > 50


def test_constrained_texts_repeat(spark, rows):
    s = spark.createDataFrame([(1, "red lamp", "x"), (2, "red lamp", "y"), (3, "red lamp", None), (4, None, "x"), (5, "red lamps", "x")], "id long, t string, c string")
    t = spark.createDataFrame([(10, "red lamp", "x"), (11, "red lamp", "x"), (12, "red lamps", "y"), (13, "green", "x")], "id long, t string, c string")
    assert rows(nearest_by_trigram(s, t, "id", "id", "t", [("c", "$T = $S")])) == [(1, 10), (2, 12), (5, 10)]
    assert nearest_by_trigram(s.limit(0), t, "id", "id", "t").count() == 0 and nearest_by_trigram(s, t.limit(0), "id", "id", "t").count() == 0


@pytest.mark.parametrize("texts, chars, columns, width, lookups", [(50_000, 24_000_000, 4_096, 4_096, 2_000_000), (13, 900, 7, 8, 40)])
def test_nearest_text_against_all_pairs(texts, chars, columns, width, lookups, monkeypatch):
    rng = random.Random(5)
    words = "red green lamp lamps table tables chairs 12 7 é 日本語 日本 \U0001f600x 𝒳y a".split()
    draw = lambda n: list(dict.fromkeys([" ".join(rng.choice(words) for _ in range(rng.choice((1, 2, 3, 4, 30)))) for _ in range(n)] + ["", "x y", "y x"]))
    source, target = draw(150), draw(170)
    for name, value in (("TEXTS", texts), ("CHARS", chars), ("CHUNK", min(chars, 500)), ("COLUMNS", columns), ("ROWS", 16), ("LOOKUPS", lookups)):
        monkeypatch.setattr(nearest, name, value)
    grams = lambda text: {f"  {w} "[i : i + 3] for w in text.split() for i in range(len(w) + 1)}
    a, b = [grams(x) for x in source], [grams(x) for x in target]
    rank = np.array(rng.sample(range(len(b)), len(b)))
    expected = {}
    for i, x in enumerate(a):
        near = [(-len(x & y) / len(x | y), rank[j]) for j, y in enumerate(b) if x | y and 2 * len(x & y) > len(x | y)]
        if near:
            expected[i] = min(near)
    (sorder, s), (torder, t) = (nearest.joined([nearest.sets_of(side[:9]), nearest.sets_of(side[9:])]) for side in (source, target))
    best, hit = nearest.compare(s, t, rank[torder], width)
    assert {int(sorder[i]): (-best[i], rank[torder[j]]) for i, j in enumerate(hit) if j >= 0} == expected and len(expected) > 50
    packed = list(nearest._pack([pa.RecordBatch.from_arrays([pa.array(target), pa.array(range(len(target)))], names=["text", "key"])]))
    assert sum(len(p["keys"][0]) for p in packed) == len(torder) and (len(packed) > 1) == (texts < len(target))


def shuffled(spark) -> int:
    """Rows that all stages so far wrote to shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, *[getattr(store, f"stageList$default${i}")() for i in (4, 5)])
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_pairs_of_like_texts_do_not_leave_their_task(spark, rows):
    """Shuffled rows grow with the texts, not with the pairs that share over half of all trigrams."""
    phrase = F.lit("the seal is exactly as pictured and the motor feels neat too number ")
    s = spark.range(300).select("id", F.concat(phrase, "id").alias("t"))
    t = spark.range(1000, 1300).select("id", F.concat(phrase, F.col("id") - 1000, F.lit(" x")).alias("t"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = shuffled(spark)
        assert rows(nearest_by_trigram(s, t, "id", "id", "t")) == [(i, 1000 + i) for i in range(300)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled(spark) - before < 10_000


def test_like_titles_of_many_rows_in_several_blocks(spark, rows, monkeypatch):
    """Rows of one title are asked once, and blocks of the target agree on the smallest id."""
    monkeypatch.setattr(nearest, "FEW", 20)
    title = lambda n: F.concat(F.lit("Great Osterby night light T"), 100 + n % 200)
    s = spark.range(1000).select("id", title(F.col("id")).alias("t"))
    t = spark.range(1000).select(F.concat(F.lit("v"), 5000 - F.col("id")).alias("id"), F.concat(title(F.col("id")), F.lit("!")).alias("t"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = shuffled(spark)
        assert rows(nearest_by_trigram(s, t, "id", "id", "t")) == [(i, f"v{5000 - 800 - i % 200}") for i in range(1000)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled(spark) - before < 15_000
