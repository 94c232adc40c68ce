"""What grows with the input is not broadcast in the near-copy stage, also where Spark sizes it too low, as after an explode."""

import pytest

import corpus_pipeline
from trackloom.llm import components, near_copies, simhash


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def settled(monkeypatch):
    """(name, plan, table) of every table that the stage writes."""
    seen = []

    def record(df, name, settle=simhash.settle):
        seen.append((name, plan_of(df), settle(df, name)))
        return seen[-1][2]

    for module in (simhash, near_copies, components):
        monkeypatch.setattr(module, "settle", record)
    return seen


def edited(name, n):
    """Copies of one text with a word replaced each."""
    words = [f"{name}{i}" for i in range(100)]
    return [" ".join([*words[:k], f"new{name}{k}", *words[k + 1 :]]) for k in range(n)]


def test_no_table_of_the_index_or_of_the_groups_is_broadcast(spark, settled):
    texts = [*edited("a", 30), *edited("b", 3), *[f"alone{n} " * 3 + f"{n} {n * n} {n**3}" for n in range(40)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.dissimilar(spark, docs, "")
    plans = {(name, plan) for name, plan, _ in settled if name in ("lists", "members", "links")}
    assert {name for name, _ in plans} == {"lists", "members", "links"}
    assert not [name for name, plan in plans if "Broadcast" in plan]
    assert {r["doc_id"] for r in kept.collect()} == {0, 30, *range(33, 73)}


def test_documents_alone_make_no_edges(spark, settled):
    docs = spark.createDataFrame([(n, " ".join(f"w{n}x{k}" for k in range(40))) for n in range(50)], "doc_id long, text string")
    assert corpus_pipeline.dissimilar(spark, docs, "").count() == 50
    assert [table.count() for name, _, table in settled if name == "links"] == [0, 0, 0]


@pytest.mark.parametrize("max_bits", [3, 4])
def test_values_near_members_are_not_joined(spark, max_bits):
    members = spark.createDataFrame([(0,), (7,), (15,), (1 << 40,)], "fp long")
    edges = simhash.links_by_value(members, max_bits)
    assert "Join" not in plan_of(edges)
    roots = {r["node"]: r["root"] for r in components.smallest_reachable(edges).collect()}
    assert roots == {0: 0, 7: 0, 15: 0, 1 << 40: 0}
