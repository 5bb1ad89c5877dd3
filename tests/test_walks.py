"""Many walks at once against a plain breadth-first search of each seed."""

import random

import pytest

from folionaut.operators import walks

EDGES = "relationship_id string, from_id string, target_id string, source_id string, line_start int, observed_kind string"


def plain(edges, seed, direction, depth, budget):
    reached, taken, level, truncated = {seed: (0, 0)}, {}, [seed], False
    for step in range(1, depth + 1):
        rows = []
        for place, at in enumerate(level):
            if direction != "incoming":
                rows += [((place, 0, "", e[4], e[0]), e[0], e[2], "outgoing") for e in edges if e[1] == at]
            if direction != "outgoing":
                rows += [((place, 1, e[3], e[4], e[0]), e[0], e[1], "incoming") for e in edges if e[2] == at]
        level = []
        for _, edge, target, way in sorted(rows):
            if edge in taken:
                continue
            if len(taken) == budget:
                truncated = True
                break
            taken[edge] = (step, len(taken) + 1, way)
            if target and target not in reached:
                reached[target] = (step, len(taken))
                level.append(target)
        if truncated or not level:
            break
    return reached, taken, truncated


@pytest.mark.parametrize("direction,budget", [("outgoing", 4), ("incoming", 1000), ("both", 7)])
def test_walks_equal_single_searches(spark, direction, budget):
    draw = random.Random(budget)
    edges = []
    for n in range(160):
        # A hub that many point at, loops, repeated edges and edges without target.
        target = "e0" if n % 3 == 0 else None if n % 11 == 0 else f"e{draw.randrange(40)}"
        edges.append((f"r{n:03}", f"e{draw.randrange(40)}", target, f"s{draw.randrange(4)}", draw.randrange(50), "calls"))
    seeds = [f"e{n}" for n in range(0, 40, 2)] + ["nowhere"]
    found = walks.walk_all(
        spark.createDataFrame(edges, EDGES), spark.createDataFrame([(s, s) for s in [*seeds, seeds[0]]] + [(None, "e1")], "seed string, entity_id string"),
        direction, ("calls",), 3, budget,
    )
    reached, taken = {}, {}
    for r in found.reached.collect():
        assert reached.setdefault(r["seed"], {}).setdefault(r["entity_id"], (r["depth"], r["place"])) == (r["depth"], r["place"])
    for r in found.edges.collect():
        taken.setdefault(r["seed"], {})[r["relationship_id"]] = (r["depth"], r["place"], r["orientation"])
    cut = {r["seed"] for r in found.truncated.collect()}
    for seed in seeds:
        expected = plain(edges, seed, direction, 3, budget)
        assert (reached[seed], taken.get(seed, {}), seed in cut) == expected, seed
