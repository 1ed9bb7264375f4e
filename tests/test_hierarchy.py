import datetime
import random

from hypothesis import HealthCheck, given, settings, strategies as st

from marginalia.operators import paths
from marginalia.operators.graph import components
from marginalia.operators.hierarchy import collection_hierarchy, cycle_nodes, hierarchy

SCHEMA = "collection_key string, name string, parent_key string, path string, last_seen_at timestamp, node string, root string"
T = datetime.datetime(2024, 1, 1)


def brute(parents):
    out = {}
    for k in parents:
        chain = [k]
        while parents[chain[-1]] is not None and parents[chain[-1]] not in chain:
            chain.append(parents[chain[-1]])
        out[k] = None if parents[chain[-1]] is not None else chain[::-1]
    return out


def check(spark, parents):
    rows = [(k, p, k.lower()) for k, p in parents.items()]
    df = hierarchy(spark.createDataFrame(rows, "node string, parent string, name string"), block=4)
    found = {r.node: r for r in df.collect()}
    expected = brute(parents)
    assert set(found) == set(expected)
    for k, chain in expected.items():
        r = found[k]
        if chain is None:
            assert (r.root, r.depth, r.path, r.n_descendants, r.cyclic) == ("cycle", -1, "", -1, True)
        else:
            assert (r.root, r.depth, r.path) == (chain[0], len(chain) - 1, "/".join(chain).lower())
            assert list(r.ancestors) == chain[:-1]
            assert r.n_descendants == sum(1 for c in expected.values() if c and k in c[:-1])


def test_forest_with_cycles_and_a_hub(spark):
    rng = random.Random(3)
    parents = {"R": None, "S": None}
    for k in range(60):
        parents[f"H{k}"] = "R"
    for k in range(40):
        parents[f"C{k}"] = f"C{k - 1}" if k else "S"
    for k in range(30):
        parents[f"N{k}"] = rng.choice(list(parents))
    parents |= {"X1": "X2", "X2": "X3", "X3": "X1", "Y": "Y", "Z": "X2", "ZZ": "Z"}
    check(spark, parents)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-1, 11), min_size=1, max_size=12))
def test_any_links(spark, links):
    check(spark, {f"K{k}": None if p < 0 or p >= len(links) else f"K{p}" for k, p in enumerate(links)})


def test_one_node_of_each_cycle(spark):
    edges = [("a", "b"), ("b", "a"), ("c", "c"), ("d", "a"), ("e", "f")]
    found = {r.node for r in cycle_nodes(spark.createDataFrame(edges, "node string, parent string")).collect()}
    assert len(found) == 2 and "c" in found and found & {"a", "b"}


def test_collections_table(spark):
    later = T + datetime.timedelta(days=1)
    rows = [
        (" A ", "old", None, None, T, "x", "y"),
        ("A", "Top/1", "false", None, later, "x", "y"),
        ("B", None, " A", "stale", T, None, None),
        ("B", None, " A", "stale", T, None, None),
        ("C", "", "B\t", None, None, None, None),
        ("D", "d", "GONE", None, T, None, None),
        ("", "no key", "A", None, T, None, None),
        (None, "null key", "A", None, T, None, None),
    ]
    found = {r.node: (r.root, r.depth, r.path, r.n_descendants) for r in collection_hierarchy(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {"A": ("A", 0, "Top/1", 2), "B": ("A", 1, "Top/1/B", 1), "C": ("A", 2, "Top/1/B/C", 0), "D": ("D", 0, "d", 0)}


def test_empty_table(spark):
    assert collection_hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    edges = [(f"n{k:03}", f"n{k + 1:03}") for k in range(50)] + [("x", "y"), ("y", "x"), ("z", "z")] + [("hub", f"h{k}") for k in range(100)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {found[f"n{k:03}"] for k in range(51)} == {"n000"}
    assert found["x"] == found["y"] == "x" and "z" not in found
    assert len({found[f"h{k}"] for k in range(100)}) == 1
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_paths_of_a_long_chain_and_of_cycles(spark):
    """Walking up from every node, against a plain walk; a chain of 10,000 nodes takes rounds by the logarithm."""
    rng = random.Random(8)
    parents = {f"C{k}": f"C{k - 1}" if k else "gone" for k in range(300)}
    parents |= {f"R{k}": f"R{(k + 1) % 5}" for k in range(5)} | {"S": "S", "T": "S", "r": None}
    for k in range(80):
        parents[f"N{k}"] = rng.choice(["R1", "R4", "S", "r", "lost", *list(parents)[300:]])

    def walk(k):
        seen, out = [k], [k.lower()]
        while parents.get(seen[-1]) is not None and parents[seen[-1]] not in seen:
            seen.append(parents[seen[-1]])
            out.append(seen[-1].lower() if seen[-1] in parents else seen[-1])
        return "/".join(out[::-1])

    links = spark.createDataFrame([(k, p, k.lower()) for k, p in parents.items()], "node string, parent string, name string")
    assert {r.node: r.path for r in paths.walk_up(links).collect()} == {k: walk(k) for k in parents}
    long = spark.range(10_000).selectExpr("concat('C', id) AS node", "IF(id = 0, NULL, concat('C', id - 1)) AS parent", "'n' AS name")
    found = hierarchy(long, ancestors=False)
    assert found.agg({"depth": "max"}).first()[0] == 9_999
    assert found.where("node = 'C9999'").first().path == "/".join(["n"] * 10_000)
