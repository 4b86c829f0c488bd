"""What the pipeline's tasks need of Python: workers live on and keep what they read, so a task has one at a time."""

from __future__ import annotations

import random

import pytest
from strandlake.llm import packing, passages


def nested(plan, above: bool = False) -> bool:
    """Whether rows of one task go through two Python workers."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return nested(plan.initialPlan())
    python = "InArrow" in name or "Python" in name
    if python and above:
        return True
    above = "Exchange" not in name and (above or python)
    return any(nested(plan.children().apply(i), above) for i in range(plan.children().size()))


def leaves(plan) -> set[str]:
    if plan.nodeName() == "AdaptiveSparkPlan":
        return leaves(plan.initialPlan())
    below = [leaves(plan.children().apply(i)) for i in range(plan.children().size())]
    return set().union(*below) if below else {plan.nodeName()}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan()


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rng = random.Random(31)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage = prose(90)
    rows = [(i, f"{prose(60)} {passage} {prose(30)}" if i % 5 == 0 else prose(rng.randrange(5, 400))) for i in range(60)]
    path = str(tmp_path_factory.mktemp("workers") / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    return spark.read.parquet(path)


def test_a_repeat_of_a_worker_is_seen(docs):
    twice = docs.mapInArrow(lambda b: b, docs.schema)
    assert not nested(plan_of(twice)) and not nested(plan_of(twice.repartition(3, "doc_id").mapInArrow(lambda b: b, docs.schema)))
    assert nested(plan_of(twice.where("doc_id > 3").mapInArrow(lambda b: b, docs.schema)))


def test_passages_take_one_worker_a_task(docs):
    found = passages.passages(docs)
    assert not nested(plan_of(found))
    cut = passages.without_passages(docs)
    assert not nested(plan_of(cut))
    at = {r["doc_id"]: (r["begin_word"], r["end_word"]) for r in found.collect()}
    assert at == {i: (60, 150) for i in range(5, 60, 5)}
    before, after = ({r["doc_id"]: r["text"].split() for r in x.collect()} for x in (docs, cut))
    assert after == {i: t[:60] + t[150:] if i in at else t for i, t in before.items()}


def test_packing_sends_no_rows_of_python_objects(docs):
    packed = packing.pack(docs, length=256)
    assert not nested(plan_of(packed))
    assert "Union" in plan_of(packed).toString()  # sequences from the end were taken apart
    assert not any("RDD" in x for x in leaves(plan_of(packed)))
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in packed.collect())
    at: dict[int, int] = {}
    for s, o, n in places:
        assert at.get(s, 0) == o
        at[s] = o + n
    assert max(at.values()) <= 256 and sum(at.values()) == sum(n for _, _, n in places)
