import hashlib

from pyspark.sql import functions as F

from pagesieve.llm import fingerprints as P
from tests.llm import common as C


def edited(texts):
    """Texts in order, each with its last quarter from the next."""
    for i, t in enumerate(texts):
        n = len(t) // 4
        yield t[:len(t) - n] + texts[(i + 1) % len(texts)][:n]


def test_whole_table(spark):
    docs = C.documents(spark)
    source = sorted(C.rows(docs, "doc_id", "text"))
    got = {r["doc_id"]: r for r in P.compare_edited(docs).collect()}
    assert len(got) == len(source)
    by_print = {}
    for (k, t), e in zip(source, edited([t for _, t in source]), strict=True):
        assert got[k]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and got[k]["n_chars"] == len(t)
        by_print.setdefault(got[k]["fingerprint"], set()).add(t)
        assert 0 <= got[k]["near_edited"] <= 1 and 0 <= got[k]["near_next"] <= 1
    assert all(len(v) == 1 for v in by_print.values()) and len(by_print) == len({t for _, t in source})
    long = [r for r in got.values() if r["n_chars"] > 400 and r["near_next"] < 1]
    assert sum(r["near_edited"] > r["near_next"] for r in long) > 0.98 * len(long)


def test_ranges_join_up(spark, monkeypatch):
    monkeypatch.setattr(P, "RANGE_ROWS", 7)
    ids = [(i * i * 37 % 1009, f"text {i}") for i in range(120)] + [(2**62 + i, f"far {i}") for i in range(30)]
    df = spark.createDataFrame(ids, "doc_id long, text string")
    got = {r["doc_id"]: r["edited_sha256"] for r in P.compare_edited(df).collect()}
    source = sorted(set(ids))
    texts = list(edited([t for _, t in source]))
    if len({k for k, _ in source}) == len(source):
        assert got == {k: hashlib.sha256(e.encode()).hexdigest() for (k, _), e in zip(source, texts, strict=True)}
    assert set(got) == {k for k, _ in source}


def test_one_id_over_several_ranges(spark, monkeypatch):
    """The next document does not depend on how many ranges a repeated id spans."""
    df = spark.createDataFrame([(5, f"text {i} of one id") for i in range(200)] + [(i, f"other {i}") for i in range(20)], "doc_id long, text string")
    columns = ["doc_id", "fingerprint", "edited_sha256", "near_next"]
    whole = sorted(C.rows(P.compare_edited(df), *columns))
    monkeypatch.setattr(P, "RANGE_ROWS", 7)
    assert sorted(C.rows(P.compare_edited(df), *columns)) == whole


def test_odd_rows(spark):
    got = P.compare_edited(C.odd_documents(spark)).collect()
    assert len(got) == len(C.ODD_ROWS)
    assert {r["n_chars"] for r in got if r["doc_id"] == 1} == {0}
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (5, 6)}) == 1
    assert P.compare_edited(C.no_documents(spark)).count() == 0
    one = P.compare_edited(C.odd_documents(spark).filter("doc_id = 8")).first()
    assert one["near_next"] == 1.0


def test_order_insertion_and_deletion(spark):
    a, b = "first part of it\nsecond part", "third and last\nfourth"
    df = spark.createDataFrame([(a, b)], "a string, b string")
    whole = P.fingerprint(F.concat("a", F.lit("\n"), "b"))
    swapped = P.fingerprint(F.concat("b", F.lit("\n"), "a"))
    own = P.fingerprint(F.col("a"))
    got = df.select(
        (whole == swapped).alias("order"), (P.inserted(own, F.col("b")) == whole).alias("insert"),
        (P.deleted(whole, F.col("b")) == own).alias("delete"), (own == whole).alias("other"),
        (P.fingerprint(F.lit("x\nx")) == P.fingerprint(F.lit("x"))).alias("twice"),
    ).first()
    assert tuple(got) == (True, True, True, False, False)


def test_deletion_borrows_from_no_lane(spark):
    """Taking out what was never put in is undone by putting it in again."""
    df = spark.createDataFrame([("a\nb", "c d\ne f\ng")], "a string, b string")
    back = P.inserted(P.deleted(P.fingerprint(F.col("a")), F.col("b")), F.col("b"))
    assert df.select(back == P.fingerprint(F.col("a"))).first()[0]


def test_grouped_sums_are_those_of_the_expression(spark):
    rows = spark.createDataFrame([(i, t or "") for i, (_, t) in enumerate(C.ODD_ROWS)], "i long, t string")
    grouped = P.summed(rows, ["i"], "t").join(rows, "i")
    assert grouped.filter(F.col("vector") != P.fingerprint(F.col("t"))).count() == 0 and grouped.count() == len(C.ODD_ROWS)


def test_texts_are_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(P, "RANGE_ROWS", 50)
    text = P.compare_edited(C.documents(spark))._jdf.queryExecution().executedPlan().toString()
    plan = text[text.index("Initial Plan"):] if "Initial Plan" in text else text
    assert plan.count("hashpartitioning(range") == 2  # the rows, and one slim row per range
