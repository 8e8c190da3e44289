"""The store of answers: new texts only, the last good answer, runs that stop."""

import pytest

from watchpanel.operators import scoring as sc
from watchpanel.sources.answers import AnswerStore


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "k int, text string")


class Fixed:
    """Answers from a table of texts; notes on disk what it was asked."""

    def __init__(self, answers, log):
        self.answers, self.log = answers, log

    def __call__(self, texts):
        with open(self.log, "a") as out:
            out.writelines(f"{t}\n" for t in texts)
        return [self.answers[t] for t in texts]


def answers(df):
    return {r.k: r.raw_output for r in df.collect()}


def test_new_texts_only_and_the_last_good_answer(spark, tmp_path):
    store = AnswerStore(spark, f"file://{tmp_path}/store", slices=2)
    good, bad = '{"risk_score": 7}', "no score"

    def run(texts, table):
        log = tmp_path / f"log{len(list(tmp_path.iterdir()))}"
        log.touch()
        found = answers(store.score(frame(spark, texts), lambda: Fixed(table, str(log))))
        return found, sorted(log.read_text().split())

    assert run(["a", "b", "a"], {"a": good, "b": bad}) == ({0: good, 1: bad, 2: good}, ["a", "b"])
    # a is known; b is tried again, and its good answer stays
    assert run(["b", "a", "c"], {"b": good, "c": good}) == ({0: good, 1: good, 2: good}, ["b", "c"])
    assert run(["b", "a", "c"], {}) == ({0: good, 1: good, 2: good}, [])
    assert store.rows().count() == 4 and store.answers().where("good").count() == 3


def test_null_and_empty_texts_are_one(spark, tmp_path):
    store = AnswerStore(spark, f"file://{tmp_path}/store")
    found = answers(store.score(frame(spark, [None, "", "x"]), sc.keyword_answers(("x",))))
    assert found == {0: '{"risk_score": 0}', 1: '{"risk_score": 0}', 2: '{"risk_score": 20}'}
    assert store.rows().count() == 2
    assert store.score(frame(spark, []), sc.keyword_answers()).count() == 0


def test_a_run_that_stops_keeps_its_slices(spark, tmp_path, monkeypatch):
    import watchpanel.sources.answers as module

    store = AnswerStore(spark, f"file://{tmp_path}/store", slices=8)
    texts = [f"t{i}" for i in range(200)]
    real, calls = module.score_texts, []

    def stops(df, *args, **kwargs):
        calls.append(1)
        if len(calls) == 4:
            raise KeyboardInterrupt
        return real(df, *args, **kwargs)

    monkeypatch.setattr(module, "score_texts", stops)
    with pytest.raises(KeyboardInterrupt):
        store.score(frame(spark, texts), sc.keyword_answers())
    kept = store.rows().count()
    assert 0 < kept < 200
    assert store.missing(frame(spark, texts)).count() == 200 - kept
    monkeypatch.setattr(module, "score_texts", real)
    assert len(answers(store.score(frame(spark, texts), sc.keyword_answers()))) == 200
    assert store.rows().count() == 200


def test_expressions_answer_as_the_python_scorers(spark):
    texts = ["", None, "ab abc", "b", "a" * 50, "立案 b"]
    words = ("a", "b", "c", "立案", "ab", "abc", "bc")
    dims = {"x": ("a", "b"), "y": ("立案",)}
    for column, python in (
        (sc.keyword_answers(words), lambda: sc.KeywordScorer(words)),
        (sc.dim_keyword_answers(dims, 60), lambda: sc.DimKeywordScorer(dims, 60)),
    ):
        df = frame(spark, texts)
        assert answers(sc.score_texts(df, column)) == answers(sc.score_texts(df, python))
    plan = sc.score_texts(frame(spark, texts), sc.keyword_answers())._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInPandas" not in plan
