"""Nearest neighbours against brute force, and the pipeline against its stages."""

import numpy as np

import corpus_pipeline
from folionaut.llm import neighbours, toxicity
from folionaut.llm.queries import QUERIES

from . import brute
from .conftest import SMALL


def nearest(ids, x, query, k):
    score = x @ x[query]
    score[query] = -np.inf
    order = np.lexsort((ids, -score))[: min(k, len(ids) - 1)]
    return [(int(ids[i]), float(score[i])) for i in order]


def test_recall_of_the_query(llm):
    got = {}
    for r in QUERIES["op9_balanced_lists"](llm, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    table = sorted((r["vec_id"], r["embedding"]) for r in llm.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect())
    ids, x = np.array([i for i, _ in table]), np.array([v for _, v in table], dtype=np.float64)
    found = 0
    for q in np.flatnonzero(ids % 20 == 0):
        own = got[ids[q]]
        assert [r for r, _, _ in own] == list(range(1, 21)) and ids[q] not in {v for _, v, _ in own}
        assert np.allclose([s for _, _, s in own], [x[np.flatnonzero(ids == v)[0]] @ x[q] for _, v, _ in own], atol=1e-12)
        found += len({v for _, v, _ in own} & {v for v, _ in nearest(ids, x, q, 20)})
    assert found >= 0.9 * 20 * len(got)


def test_recall_where_most_lists_are_not_read(llm, monkeypatch):
    random_ = np.random.default_rng(8)
    x = random_.normal(size=(8000, 16)).round(6)
    frame = llm.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    settings, used = neighbours.Settings(list_size=8, lists=4, breadth=8), []
    calibrate = getattr(neighbours, "calibrate", None)
    if calibrate:
        monkeypatch.setattr(neighbours, "calibrate", lambda index, *rest: (calibrate(index, *rest), used.append(index)))
    got = {}
    for r in neighbours.search(frame, frame.where("vec_id % 20 = 0"), 20, settings).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    found = sum(len(own & {v for v, _ in nearest(np.arange(8000), x, q, 20)}) for q, own in got.items())
    assert len(got) == 400 and found >= 0.9 * 20 * len(got)
    assert 4 < used[0].settings.lists < len(used[0].centroids) / 2


def test_ties_nulls_and_unequal_norms(llm):
    random_ = np.random.default_rng(3)
    rows = [(i, (random_.normal(size=6) * random_.uniform(0.1, 5)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[20][1]) for i in range(60)]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 6), (2003, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2004, [float("nan")] * 6), (2005, [float("inf")] * 6), (None, [1.0] * 6)]
    frame = llm.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    settings = neighbours.Settings(list_size=40, lists=64, list_ratio=100.0, part=50)
    got = {}
    for r in neighbours.search(frame, frame.where("vec_id % 20 = 0"), 20, settings).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for q in np.flatnonzero(ids % 20 == 0):
        assert got[ids[q]] == [v for v, _ in nearest(ids, x, q, 20)]
    few = frame.where("vec_id < 5")
    assert neighbours.search(few, few, 20).count() == 20
    assert neighbours.search(frame.limit(0), frame.limit(0), 20).count() == 0


def test_pipeline_stages(llm):
    docs = llm.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [(r["item_id"], r["text"]) for r in llm.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(llm, docs, SMALL)
        if name == "sequence_packing":
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == set(before)
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "near_duplicates":
            linked = brute.linked(list(before.items()), 5, 80)
            assert set(after) == {d for d, (_, c) in linked.items() if d == c}
        elif name == "benchmark_decontamination":
            share = {d: (n, hit) for d, (n, hit, _) in zip(before, brute.hits(list(before.items()), items))}
            assert set(after) == {d for d, (n, hit) in share.items() if hit <= 0.5 * n}
            assert all((after[d] == before[d]) == (share[d][1] == 0) for d in after)
        elif name == "secret_scan":
            assert set(after) == set(before)
            assert all(("[secret]" in after[d]) == bool(brute.base_secrets(before[d])) or "[secret]" in after[d] for d in after)
        before = after
    assert corpus_pipeline.run(llm, SMALL).count() == docs.count()


def test_pipeline_of_empty_tables(llm, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        llm.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(llm, str(tmp_path)).count() == 0


def test_toxicity_holds_out(llm):
    got = {r["doc_id"]: r for r in QUERIES["op6_toxicity_chain"](llm, "/root/testdata/sf0.1").collect()}
    labels = llm.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    assert all(0 <= r["score"] <= 1 for r in got.values())
    for toxic, least in ((1, 0.85), (0, 0.98)):
        held = [got[r["doc_id"]]["predicted"] == toxic for r in labels if r["toxic"] == toxic and got[r["doc_id"]]["held_out"]]
        assert sum(held) >= least * len(held)


def test_chain_feeds_earlier_categories(llm):
    """The second category is the first one's opposite where a word stands, so it needs the first one's probability."""
    random_ = np.random.default_rng(2)
    docs, labels = [], []
    for i in range(600):
        first, flip = random_.integers(0, 2, 2)
        words = [f"w{x}" for x in random_.integers(0, 30, 12)] + ["badword"] * first + ["flipping"] * flip
        docs.append((i, " ".join(random_.permutation(words))))
        labels.append((i, int(first), int(first and not flip)))
    docs += [(600, None), (601, ""), (602, "badword")]
    frame, known = llm.createDataFrame(docs, "doc_id long, text string"), llm.createDataFrame([*labels, (603, None, 1), (None, 1, 1)], "doc_id long, a int, b int")
    chain = toxicity.learn(frame, known, ("a", "b"))
    got = {r["doc_id"]: (r["a"] >= 0.5, r["b"] >= 0.5) for r in toxicity.scored(frame, chain, ("a", "b")).collect()}
    assert sum(got[i] == (bool(a), bool(b)) for i, a, b in labels) >= 0.97 * len(labels)
    assert len(chain.weights[1][1]) == 1 and len(got) == 603 and got[602][0]


def test_toxicity_edges(llm, edges, nothing):
    labels = llm.createDataFrame([(4, 1), (9, 0), (11, 1), (14, 0), (99, 1)], "doc_id long, toxic int")
    chain = toxicity.learn(edges, labels, ("toxic",))
    assert toxicity.scored(edges, chain, ("toxic",)).where("toxic between 0 and 1").count() == edges.count()
    one = toxicity.learn(edges, labels.where("toxic = 1"), ("toxic",))
    assert toxicity.scored(edges, one, ("toxic",)).where("toxic > 0.99").count() == edges.count()
    assert toxicity.scored(nothing, toxicity.learn(nothing, labels, ("toxic",)), ("toxic",)).count() == 0
    assert toxicity.scored(edges, toxicity.learn(edges, labels.limit(0), ("toxic",)), ("toxic",)).where("toxic = 0.5").count() == edges.count()
