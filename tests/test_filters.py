import pytest
from pyspark.sql import functions as F

from lodestone.operators.filters import Bool, Find, Range, Sorter, Term, Terms, by_ids, latest, page, where, without


@pytest.fixture(scope="module")
def df(spark):
    rows = [(1, "cow", 5, 0.5), (2, "kar", None, 1.5), (3, None, 7, 2.5), (4, "cow", 9, None), (5, "o'x", 1, 9.5)]
    return spark.createDataFrame(rows, "id int, bar string, score int, part double").persist()


def ids(rows):
    return [r["id"] for r in rows.orderBy("id").collect()]


@pytest.mark.parametrize(
    ("by", "want"),
    [
        (None, [1, 2, 3, 4, 5]), (Term("bar", "cow"), [1, 4]), (Term("bar", None), []), (Terms("bar", ["cow", "o'x"]), [1, 4, 5]), (Terms("bar", []), []),
        (Range("score", 5), [3, 4]), (Range("score", 5, inclusive_start=True), [1, 3, 4]), (Range("score", stop=7, inclusive_stop=True), [1, 3, 5]), (Range("score"), [1, 2, 3, 4, 5]),
        (Bool(), [1, 2, 3, 4, 5]), (Bool(must=[Term("bar", "cow"), Range("score", 6)]), [4]), (Bool(must=[Term("bar", "cow")], should=[Range("score", 6), Range("part", 9)]), [4]),
        (Bool(must_not=[Term("bar", "cow")]), [2, 5]), (Bool(must_not=[Bool(must=[Term("bar", "cow")], should=[Range("score", 6)])]), [1, 2, 5]),
    ],
)
def test_filters(df, by, want):
    if by == Bool(must_not=[Bool(must=[Term("bar", "cow")], should=[Range("score", 6)])]):
        # not (bar = cow and score > 6): row 3 has no bar but its score passes, so it is unknown
        want = [1, 2, 5]
    assert ids(where(df, by)) == want


def test_deleting_spares_what_is_unknown(df):
    assert ids(without(df, Term("bar", "cow"))) == [2, 3, 5] and ids(without(df, None)) == []


def test_find_and_ids(df):
    found = Find(Range("id", 1), [Sorter("score")], limit=2, offset=1).apply(df).collect()
    assert [r["id"] for r in found] == [3, 5]
    assert [r["id"] for r in Find(sorters=[Sorter("score", False)]).apply(df).collect()] == [5, 1, 3, 4, 2]
    assert ids(by_ids(df, [4, 1, 77])) == [1, 4] and ids(by_ids(df, [])) == []


def test_pages_walk_through_all_rows(spark):
    df = spark.createDataFrame([(i, i // 3) for i in range(11)], "id int, created_at int")
    for descending in (True, False):
        seen, after = [], None
        while True:
            got = page(df, limit=4, after=after, descending=descending).collect()
            got.sort(key=lambda r: (r["created_at"], r["id"]), reverse=descending)
            seen += [r["id"] for r in got]
            if not got or not got[0]["has_more"]:
                break
            after = (got[-1]["created_at"], got[-1]["id"])
        assert seen == sorted(range(11), reverse=descending)
    assert page(df.where("false")).collect() == []


def test_latest(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (2, 0, "c")], "k int, n int, v string")
    assert sorted(map(tuple, latest(df, ["k"], ["n"]).collect())) == [(1, 3, "b"), (2, 0, "c")]
    assert latest(df, ["k"], ["n"]).where(F.col("k") == 9).isEmpty()
