"""Resolution of names, communities of communities and reports on small fixtures."""

import difflib
import random
import re

from pyspark.sql import functions as F

from quillon.operators import communities as C
from quillon.operators import entities as N
from quillon.operators import tables as S


def spoiled(r, key):
    for _ in range(r.randrange(4)):
        at = r.randrange(len(key) + 1)
        key = key[:at] + r.choice(["", "a", "b", "9"]) + key[at + r.randrange(2) :]
    return key


def test_alike_is_every_pair(spark):
    r = random.Random(3)
    keys = ["".join(r.choices("abcde12", k=r.choice([1, 5, 8, 14, 20, 31, 60]))) for _ in range(120)]
    names = [k for k in (spoiled(r, r.choice(keys)) for _ in range(300)) if k]
    names += [k[1:] + k[0] for k in keys[:20]]
    found = {(x.name, x.key) for x in N.alike(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    want = {(n, k) for n in names for k in keys if difflib.SequenceMatcher(None, n, k).ratio() >= 0.93}
    assert found == want and any(n != k for n, k in want)


def test_resolve(spark):
    aliases = [("deepmind", "deepmind", "ORG"), ("mixtral8x7b", "mixtral", "MODEL"), ("transformer", "transformer", "TECH"), ("transformers", "library", "LIB"), ("llama31", "llama-3-1", "MODEL"), ("gpt4", "gpt-4", "MODEL")]
    names = [("Deep Mind", None), ("Deepminds", "ORG"), ("Deepminds", "MODEL"), ("gpt5", "MODEL"), ("Transfomer", None), ("Mixtral 8x9B", "MODEL"), ("", None), (None, None), ("Transfomers", "LIB")]
    rows = N.resolve(spark.createDataFrame(names + names[:1], "name string, type string"), spark.createDataFrame(aliases, "key string, entity string, type string")).collect()
    assert len(rows) == len(names)
    found = {(x.name, x.type): (x.entity, x.how) for x in rows}
    none = (None, None)
    assert found == {
        ("Deep Mind", None): ("deepmind", "exact"), ("Deepminds", "ORG"): ("deepmind", "alike"), ("Deepminds", "MODEL"): none, ("gpt5", "MODEL"): none, ("Transfomer", None): ("transformer", "alike"),
        ("Mixtral 8x9B", "MODEL"): none, ("", None): none, (None, None): none, ("Transfomers", "LIB"): ("library", "alike"),
    }


def test_resolution_of_parts_by_hand(spark):
    from quillon import catalogue

    folder = "/root/testdata/sf0.001"
    parts = [r.p_name for r in spark.read.parquet(f"{folder}/part.parquet").select("p_name").distinct().collect()]
    key = lambda name: re.sub("[^a-z0-9+]", "", name.lower())
    brands = {key(r[0]): None for r in spark.read.parquet(f"{folder}/part.parquet").select("p_brand").distinct().collect()}
    known = {key(p) for p in parts} | set(brands)
    for r in catalogue.queries()["entity_resolution"](spark, folder).collect():
        k = key(r.name)
        best = max(((difflib.SequenceMatcher(None, k, x).ratio(), x) for x in known), default=(0, ""))
        want = "exact" if k in known else "alike" if len(k) >= 5 and best[0] >= 0.93 and re.findall(r"\d+", best[1]) == re.findall(r"\d+", k) else None
        assert r.how == want, r
        if want == "alike":
            assert key(r.entity) == best[1] or best[1] in brands


def cliques(n, size):
    edges = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "abcdefgh"[:n] for i in range(size) for j in range(i + 1, size)]
    bridges = [("a0", "b0", 0.9), ("c0", "d0", 0.9), ("e0", "f0", 0.9)][: n // 2]
    return [x for u, v, w in edges + bridges for x in ((u, v, w), (v, u, w))]


def test_two_levels(spark):
    """A ring of 30 triangles: single nodes settle in triangles, and triangles join their neighbours."""
    edges = [(f"{i:02d}{x}", f"{i:02d}{y}") for i in range(30) for x, y in ("ab", "bc", "ac")] + [(f"{i:02d}c", f"{(i + 1) % 30:02d}a") for i in range(30)]
    both = [(u, v, 1.0) for a, b in edges for u, v in ((a, b), (b, a))]
    rows = C.levels(spark.createDataFrame(both, "u string, v string, w double")).collect()
    low, high = ({r.node: r.community for r in rows if r.level == level} for level in (0, 1))
    contracted = {}
    for u, v, w in both:
        row = contracted.setdefault(low[u], {})
        row[low[v]] = row.get(low[v], 0.0) + w
    label = C.moved(contracted, 2.0 * len(edges))
    groups = {}
    for node, c in low.items():
        groups.setdefault(label[c], set()).add(node)
    found = {}
    for node, c in high.items():
        found.setdefault(c, set()).add(node)
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 3)
    assert 1 < len(groups) < len(set(low.values())) and all(c == min(g) for c, g in found.items())


def test_few_communities_have_one_level(spark):
    rows = C.levels(spark.createDataFrame(cliques(2, 4), "u string, v string, w double")).collect()
    assert {r.level for r in rows} == {0} and len(rows) == 8


def test_reports(spark):
    members = spark.createDataFrame([(0, "a", x) for x in "abcd"] + [(0, "x", "x")], "level int, community string, node string")
    nodes = spark.createDataFrame([("a", "Ann", "ORG"), ("b", "Bo", "ORG"), ("c", "Cy", "MODEL"), ("d", "Di", "ORG"), ("x", "Xi", "ORG")], "node string, name string, type string")
    facts = spark.createDataFrame(
        [(1, "a", "b", 0.9, True, "2020-01", "Ann made Bo in 2020."), (2, "a", "c", 1.0, False, None, "Ann left Cy."), (3, "b", "a", 0.8, True, "2021-05", "Ann made  Bo, in 2020!"), (4, "a", "d", 0.4, True, None, "Weak."), (5, "a", "x", 0.9, True, None, "Out."), (6, "a", "d", 0.9, True, None, None)],
        "id int, src string, dst string, conf double, active boolean, valid_from string, sentence string",
    )
    found = {r.community: r for r in C.described(members, nodes, facts).collect()}
    a = found["a"]
    assert (a.n, a.n_facts, a.day, a.title) == (4, 4, "2021-05", "Ann, Bo, Cy +1")
    assert a.report == "Community of 4 related entities (3 org, 1 model). Central entities: Ann, Bo, Cy, Di.\n- Ann made Bo in 2020. (2020-01)\n- Ann left Cy."
    assert (found["x"].n, found["x"].n_facts, found["x"].title) == (1, 0, "Xi")
    again = {r.community: r.id for r in C.described(members.repartition(3, "node"), nodes, facts.orderBy(F.desc("id"))).collect()}
    assert again == {c: r.id for c, r in found.items()}
    assert [r.id for r in C.as_chunks(C.described(members, nodes, facts)).collect()] == [a.id]


def test_facts_come_back(spark):
    schema = "fact int, chunk string, confidence double, valid_from string, observed_at string, first_version int, last_version int, active boolean, valid_until string"
    old = spark.createDataFrame([(1, "c1", 0.5, None, "d1", 1, 1, False, "2020"), (2, "c2", 0.6, "2019", "d1", 1, 1, True, None)], schema)
    new = spark.createDataFrame([(1, "c9", 0.9, "2021", "d2", 2, 2, True, None)], schema)
    rows = {r.fact: r for r in S.put_facts(old, new).collect()}
    assert (rows[1].chunk, rows[1].valid_from, rows[1].observed_at, rows[1].first_version, rows[1].last_version, rows[1].active, rows[1].valid_until) == ("c9", None, "d1", 1, 2, True, None)
    assert (rows[2].chunk, rows[2].active, rows[2].last_version) == ("c2", True, 1)
