import re

from hypothesis import given, settings
from hypothesis import strategies as st

from loamspark.llm.url_filter import SOFT, STRICT, automaton, hits, url_verdicts

MACHINE = automaton(STRICT, SOFT)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*STRICT, *SOFT, "-", ".", "/", "a", "7", "?q=", "é"]), max_size=8))
def test_against_regular_expressions(parts):
    url = "".join(parts)
    want = [{t for t in terms if re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", url)} for terms in (STRICT, SOFT)]
    assert list(hits(MACHINE, url)) == want


def test_rejects_on_one_strict_or_two_soft(spark):
    rows = [(1, "http://CASINO.example.com/"), (2, "http://casinos.example.com/"), (3, "http://free-bets.example.com"), (4, "http://free.example.com/free/free"), (None, None), (5, ""), (1, "http://CASINO.example.com/"), (6, "http://a.example/" + "x/" * 100_000 + "porn")]
    df = spark.createDataFrame([(*r, 0, "") for r in rows], "page_id long, url string, n_soft int, low string")
    got = sorted((r.page_id or -1, r.reject) for r in url_verdicts(df).collect())
    assert got == [(-1, False), (1, True), (1, True), (2, False), (3, True), (4, False), (5, False), (6, True)]
    assert url_verdicts(df.limit(0)).count() == 0
    assert not any(r.reject for r in url_verdicts(df, (), ()).collect())
