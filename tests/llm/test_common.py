from types import SimpleNamespace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm.common import damerau, deletes, fold, shared_dir, stage


def plain(a, b):
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abcd", max_size=9), st.text("abcd", max_size=9), st.integers(0, 4))
def test_bounded_distance(a, b, limit):
    assert damerau(a, b, limit) == min(plain(a, b), limit + 1)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=3, max_size=8), st.text("abc", min_size=3, max_size=8))
def test_close_words_share_a_deletion(a, b):
    if plain(a, b) <= 1:
        assert deletes(a, 1) & deletes(b, 1)


def test_fold():
    assert fold("Åström ØRSTED Straße") == "astrom orsted strasse"


def test_stage_and_folder(spark):
    df = spark.createDataFrame([(1, None), (2, ["x"])], "a int, b array<string>")
    assert sorted(map(tuple, stage(df).collect())) == sorted(map(tuple, df.collect()))
    context = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda *_: None), master="spark://host:7077", applicationId="x")
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(sparkContext=context))
