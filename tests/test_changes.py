"""Changes between two states of the tables, cycles of replicas and walks over stored edges, against plain Python."""

import random

from pyspark.sql import functions as F

from mnemosea.operators import graph, lifecycle, sync

NODE = "memory_id string, namespace string, body string, authored_at_ms long"


def test_what_changed_between_two_states(spark):
    before = spark.createDataFrame([("a", "n", "x", 1), ("b", "n", None, 2), ("c", "n", "x", 3), ("d", None, "x", 4)], NODE)
    after = spark.createDataFrame([("a", "n", "x", 1), ("b", "n", "", 2), ("d", None, "x", 4), ("e", "n", None, 5)], NODE)
    got = {(r.pk_hint, r.op, r.changed_at_ms) for r in lifecycle.snapshot_changes(before, after, "memory_id", "t", now_ms=99).collect()}
    assert got == {("b", "update", 99), ("c", "delete", 99), ("e", "insert", 5)}
    assert lifecycle.snapshot_changes(after, after, "memory_id", "t", now_ms=99).collect() == []


def test_versions_are_one_row_of_numbers(spark):
    hour = lifecycle.LOG_SPAN_MS
    rows = [("t2", f"k{k}", "insert", k % 7 * hour + k) for k in range(300)] + [("t1", f"m{k}", "update", 10**13) for k in range(500)] + [("t1", "", "delete", 10**13), ("t0", "z", "delete", 10**13)]
    df = spark.createDataFrame(rows, "table_name string, pk_hint string, op string, changed_at_ms long").repartition(5)
    got = sorted((r.db_version, r.op, r.table_name, r.pk_hint) for r in lifecycle.numbered_log(df, 1000).collect())
    order = sorted(rows, key=lambda r: (r[2] != "insert", r[3] if r[2] == "insert" else 0, r[0], r[1]))
    assert got == [(1001 + i, op, table, pk) for i, (table, pk, op, _) in enumerate(order)]


def held(spark, rows):
    """Rows (replica, version, pk, namespace) as changes."""
    return spark.createDataFrame([(r, v, "t", pk, "c", f"{pk}!", "text", 1, r, 1, v, ns) for r, v, pk, ns in rows], "replica string, version long, tbl string, pk string, cid string, val string, kind string, col_version long, site_id string, cl long, db_version long, namespace string")


def test_replicas_converge_along_a_chain(spark, tmp_path):
    names = iter(range(10_000))

    def written(rows):
        path = f"file://{tmp_path}/{next(names)}"
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    rows = [("a", v, f"a{v}", "n" if v % 2 else "m") for v in range(1, 41)] + [("c", 1, "c1", "n")]
    links = spark.createDataFrame([("b", "a", ["n", "m"], ""), ("c", "b", ["n"], ""), ("d", "c", ["n", "m"], ""), ("a", "d", ["n"], ""), ("e", "a", ["n"], "peer is not allowlisted")], "replica string, peer string, namespaces array<string>, reason string")
    counted = {}
    for versions in (100, 7):
        out, rounds = sync.converge(held(spark, rows), links, versions=versions, written=written)
        counted[versions] = rounds
        got = {}
        for r in out.select("replica", "pk", "version").collect():
            assert r.pk not in got.setdefault(r.replica, {})  # no change comes twice
            got[r.replica][r.pk] = r.version
        all_a, odd = {f"a{v}" for v in range(1, 41)}, {f"a{v}" for v in range(1, 41, 2)}
        assert {k: set(v) for k, v in got.items()} == {"a": all_a | {"c1"}, "b": all_a | {"c1"}, "c": odd | {"c1"}, "d": odd | {"c1"}}
        assert all(len(set(v.values())) == len(v) for v in got.values())
    # A limit of versions takes more cycles; without one a change takes a cycle for each link.
    assert 3 <= counted[100] <= 6 < counted[7] <= 14
    nothing, rounds = sync.converge(held(spark, rows).filter(F.lit(False)), links, written=written)
    assert nothing.count() == 0 == rounds


def test_walks_over_stored_edges(spark, tmp_path):
    rng = random.Random(4)
    nodes = [f"n{k}" for k in range(60)]
    edges = [(f"e{k}", rng.choice(nodes), rng.choice([*nodes, "missing"]), rng.choice(["supports", "contradicts"]), 0.5) for k in range(150)]
    edges += [(f"hub{k}", "n0", f"n{k % 60}", "supports", 1.0) for k in range(500)]
    roots = ["n0", "n7", "alone"]

    def by_hand(depth):
        out = []
        for root in roots:
            seen, frontier = {root}, {root}
            for hop in range(1, depth + 1):
                level = [(root, hop, e, a, b, kind == "contradicts") for e, a, b, kind, _ in edges if a in frontier and b in nodes]
                out += level
                frontier = {x[4] for x in level} - seen
                seen |= frontier
        return sorted(out)

    e = spark.createDataFrame(edges, "edge_id string, from_memory_id string, to_memory_id string, relation_type string, weight double").repartition(6)
    n = spark.createDataFrame([(x,) for x in [*nodes, "alone"]], "memory_id string")
    store = graph.EdgeStore.write(e, n, f"file://{tmp_path}/edges")
    r = spark.createDataFrame([(x,) for x in roots], "root_id string")
    columns = ["root_id", "hop", "edge_id", "from_memory_id", "to_memory_id", "contradiction"]
    sizes = {}
    for depth in (1, 2, 20):
        got = store.walk(r, depth, f"file://{tmp_path}/walk{depth}")
        assert sorted(tuple(x) for x in got.select(*columns).collect()) == by_hand(depth)
        sizes[depth] = len(got._jdf.queryExecution().optimizedPlan().toString())
    assert abs(sizes[20] - sizes[2]) < 20 and sorted(tuple(x) for x in graph.trace(e, n, r, 2).select(*columns).collect()) == by_hand(2)
    # A walk ends where nothing new is reached, and reads only the folders of its frontier.
    assert len(list((tmp_path / "walk20" / "hops").iterdir())) < 14
    plan = spark._jvm.PythonSQLUtils.explainString(store.edges([3])._jdf.queryExecution(), "formatted")
    assert "bucket" in plan.split("PartitionFilters")[1].split("\n")[0]
    assert store.walk(r.filter("root_id = 'x'"), 3, f"file://{tmp_path}/none").collect() == []


def test_what_did_not_change_is_in_no_log_however_rows_are_ordered(spark, sf):
    from mnemosea.plans import catalogue
    from mnemosea.sources.bridge import Tables

    class Disordered(Tables):
        """Pages that share URLs; each reading gives the same rows in another order."""

        @property
        def artifacts(self):
            rows = self.spark.range(400).select(*[c.alias(n) for n, c in (("artifact_id", F.concat(F.lit("a"), (F.col("id") % 40).cast("string"))), ("uri", (F.col("id") % 40).cast("string")), ("namespace", F.concat(F.lit("team/"), (F.col("id") % 7).cast("string"))), ("title", F.lit("t")))])

            def run(batches):
                import os

                import numpy as np
                import pyarrow as pa

                rng = np.random.default_rng(int.from_bytes(os.urandom(8), "big"))
                for batch in batches:
                    yield batch.take(pa.array(rng.permutation(batch.num_rows)))

            return rows.coalesce(1).mapInArrow(run, rows.schema)

    kept = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        log = catalogue._captured(Disordered(spark, sf)).filter("table_name = 'artifact_refs'")
        assert {(r.pk_hint, r.op) for r in log.collect()} == {(f"gone-a{k}", "delete") for k in range(40)}
    finally:
        spark.conf.set("spark.sql.exchange.reuse", kept)
