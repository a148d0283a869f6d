"""Specs, contracts, policies, models, quality, matching and graph operators."""

import datetime as dt
import random

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from plumbline import scale
from plumbline.errors import SpecError
from plumbline.operators import catalog, matching, monitoring, policy, quality, spec, star
from plumbline.plans import model


@pytest.fixture(scope="module")
def people(spark):
    data = [(1, "abc", 10.0, "x"), (2, "def", -5.0, "y"), (3, None, 7.0, "x")]
    return spark.createDataFrame(data, "id int, name string, balance double, grp string")


# --- specs and contracts ---------------------------------------------------------------------


@pytest.mark.parametrize(
    "bad",
    [
        spec.QuerySpec(dimensions=["nope"]),
        spec.QuerySpec(measures=[("balance", "median")]),
        spec.QuerySpec(filters=[("id", "or 1=1", 1)]),
        spec.QuerySpec(filters=[("nope", "=", 1)]),
        spec.QuerySpec(dimensions=["id"], order_by=[("nope", "asc")]),
    ],
)
def test_unknown_names_are_rejected(people, bad):
    with pytest.raises(SpecError):
        spec.build_query(people, bad)


def test_value_is_never_read_as_sql(people):
    out = spec.build_query(people, spec.QuerySpec(filters=[("name", "=", "abc' OR '1'='1")]))
    assert out.count() == 0


def test_default_and_highest_limit(people):
    assert [spec.row_limit(n) for n in (None, 5, 99_999)] == [None, 5, 99_999]
    for asked, ceiling in ((0, None), (-1, None), (51, 50)):
        with pytest.raises(SpecError):
            spec.row_limit(asked, ceiling)
    assert spec.build_query(people, spec.QuerySpec()).columns == people.columns


def test_sorted_limit_is_one_operator(people):
    top = spec.build_query(people, spec.QuerySpec(dimensions=["ID"], order_by=[("balance", "desc")], limit=2))
    assert "TakeOrderedAndProject" in plan(top)
    assert [r.ID for r in top.collect()] == [1, 3]


def test_chart_of_raw_projection_and_of_one_dimension(people):
    raw = spec.QuerySpec(dimensions=["name", "balance"])
    assert rows(spec.chart_series(spec.build_query(people, raw), raw)) == [
        ("value", "abc", 10.0), ("value", "def", -5.0), ("value", None, 7.0)
    ]
    two = spec.QuerySpec(dimensions=["grp"], measures=[("balance", "sum"), ("", "count")])
    got = rows(spec.chart_series(spec.build_query(people, two), two))
    assert got == [("count", "x", 2.0), ("count", "y", 1.0), ("sum_balance", "x", 17.0), ("sum_balance", "y", -5.0)]


def test_dashboard_errors_stay_with_their_widget(people):
    widgets = [
        spec.Widget("a", "", spec.QuerySpec("t", ["nope"])),
        spec.Widget("b", "", spec.QuerySpec("t", ["grp"], [("*", "count")])),
    ]
    done = spec.run_dashboard(widgets, lambda _: people)
    assert "nope" in done["a"].error and done["b"].series.count() == 2
    assert list(spec.run_dashboard(widgets, lambda _: people, only_first=True)) == ["a"]


CONTRACT = spec.DataContract(
    {"id": "key", "balance": "amount"},
    [spec.ContractFilter("grp", ["in"], required=True), spec.ContractFilter("balance", [">=", "<"], default="0")],
    max_size=2, sortable=["amount"],
)


def test_contract(people):
    assert rows(spec.serve_contract(people, CONTRACT, {"grp": " x, y,"})) == [(1, 10.0), (3, 7.0)]
    low = spec.serve_contract(people, CONTRACT, {"grp": "x,y", "amount__<": "0"})
    assert rows(low) == [(2, -5.0)]
    best = spec.serve_contract(people, CONTRACT, {"grp": "x", "_sort": "-amount", "_limit": "1"})
    assert rows(best) == [(1, 10.0)]
    for bad in ({}, {"grp": "x", "_sort": "key"}):
        with pytest.raises(SpecError):
            spec.serve_contract(people, CONTRACT, bad)


# --- policies --------------------------------------------------------------------------------


def test_masks(people):
    seen = policy.govern(
        people.select("id", "name", "balance", F.col("name").alias("n2"), F.col("name").alias("n3")),
        policy.Decision(masks=[
            policy.Mask("NAME", "hash"), policy.Mask("balance", "deny"), policy.Mask("n2", "full"),
            policy.Mask("n3", "partial", "concat({col}, '****')"), policy.Mask("id", "none"),
        ]),
    )
    first = seen.filter("id = 1").first()
    assert first.name == "BA7816BF8F01CFEA414140DE5DAE2223B00361A396177A9CB410FF61F20015AD"
    assert (first.balance, first.n2, first.n3) == (None, "***", "abc****")
    assert seen.schema["balance"].dataType.simpleString() == "double"
    with pytest.raises(SpecError):
        policy.govern(people, policy.Decision(masks=[policy.Mask("id", "rot13")]))


def test_caller_cannot_filter_on_clear_values(people):
    seen = policy.govern(people, policy.Decision(["balance > 0"], [policy.Mask("name", "full")]))
    assert seen.filter("name = 'abc'").count() == 0
    assert seen.count() == 2
    assert spec.build_query(seen, spec.QuerySpec(filters=[("name", "=", "abc")])).count() == 0


def test_row_filter_reaches_the_scan(spark, sf):
    seen = policy.govern(spark.read.parquet(f"{sf}/customer.parquet"), policy.Decision(["c_nationkey < 10"]))
    assert "LessThan(c_nationkey,10)" in plan(seen)


def test_no_policy_means_all_visible(spark, sf, people):
    from queries.governed import policies

    for groups in ([], ["unknown"], ["audit"]):
        assert policy.resolve(policies(spark, sf), groups, "customer") == policy.Decision()
    both = policy.resolve(policies(spark, sf), ["quality", "sales"], "customer")
    assert len(both.row_filters) == 3 and len(both.masks) == 4


def test_tenant_and_sensitivity(spark):
    df = spark.createDataFrame([("a", "Public"), ("b", "Restricted"), (None, "odd")], "tenant_id string, label string")
    assert policy.for_tenant(df, "a").count() == 2 and policy.for_tenant(df, "").count() == 3
    assert rows(policy.highest_level(df.withColumn("k", F.lit(1)), ["k"], "label")) == [(1, "Restricted")]
    assert df.filter(policy.releasable(F.col("label"))).count() == 2
    assert df.filter(policy.releasable(F.col("label"), "local")).count() == 3


def test_sample_and_gold_guard(people):
    assert policy.sample(people, "balance > 0", 200).count() == 2
    for asked in (0, 201):
        with pytest.raises(SpecError):
            policy.sample(people, None, asked)
    assert policy.sample(people, None, 1).count() == 1
    policy.require_gold("Gold_quality")
    with pytest.raises(SpecError):
        policy.require_gold("silver_quality")


def test_audit_row(people):
    row = policy.audit_row(people, "alice", "preview").first()
    assert (row.subject_ref, row.raw, row.engine) == ("alice", "preview", "spark") and row.rewritten


# --- models ----------------------------------------------------------------------------------


def test_model_checks_and_routing():
    c = model.ModelColumn
    assert model.ModelTable("t", "gold", "sync", "s", [c("a", "int")]).builder() == "sync"
    assert model.ModelTable("t", "silver", "dim", "s", [c("a", "int")]).builder() == "bronze"
    for bad in (
        model.ModelTable("t", "silver", "dim", "s", [c("a", "int")], scd="scd2"),
        model.ModelTable("t", "gold", "agg", "s", [c("a", "int")]),
        model.ModelTable("t", "gold", "agg", "s", [c("a", "int", measure="system")]),
        model.ModelTable("t", "gold", "chart", "s", [c("a", "int")]),
        model.ModelTable("t", "gold", "fact", "s", []),
    ):
        with pytest.raises(SpecError):
            model.check(bad)


def test_hooks(spark, people):
    c = model.ModelColumn
    agg = model.ModelTable("a", "gold", "agg", "p", [c("grp", "string"), c("balance", "double", measure="sum")])
    hooks = model.Hooks(
        transform={"a": lambda df: df.filter("balance > 0")}, post_agg={"a": lambda df: df.withColumn("z", F.lit(1))},
        pre_sync={"s": lambda df: df.limit(1)},
    )
    out = model.build(agg, {"p": people}, F.current_timestamp(), "2024-01-01", hooks=hooks)
    assert rows(out, "grp", "balance", "z") == [("x", 17.0, 1)]
    sync = model.ModelTable("s", "gold", "sync", "p", [c("id", "string")])
    assert model.build(sync, {"p": people}, F.current_timestamp(), "2024-01-01", hooks=hooks).count() == 1


def test_model_dimension_second_load(people):
    c = model.ModelColumn
    dim = model.ModelTable(
        "d", "silver", "dim", "p",
        [c("id", "int", role="business_key"), c("name", "string", tracked=True)], scd="scd2",
    )
    now = F.current_timestamp()
    first = model.build(dim, {"p": people}, now, "2024-01-01")
    changed = people.withColumn("name", F.when(F.col("id") == 3, "new").otherwise(F.col("name")))
    second = model.build(dim, {"p": changed}, now, "2024-02-01", stored=first)
    assert rows(second.filter("NOT _is_current"), "id", "_effective_to") == [(3, dt.date(2024, 2, 1))]
    assert second.filter("_is_current").count() == 3


# --- lookups and skew ------------------------------------------------------------------------


def test_large_lookup_gives_the_same_rows(spark):
    """A third of all rows carries one key, another part has no key at all."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 != 1, F.col("id") % 50)
    fact = spark.range(3000).select("id", key.alias("k"))
    dim = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("sk"))
    for how in ("left", "inner"):
        small = scale.lookup_join(fact, dim, ["k"], how)
        assert "BroadcastHashJoin" in plan(small)
        want = rows(small)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            assert rows(scale.lookup_join(fact, dim, ["k"], how)) == want
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_lookup_key_is_split_and_the_scan_pruned(spark, tmp_path):
    path = str(tmp_path / "fact")
    spark.range(400_000).select("id", F.lit(1).alias("k"), F.uuid().alias("wide")).write.parquet(path)
    settings = {"autoBroadcastJoinThreshold": "-1", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
                "adaptive.advisoryPartitionSizeInBytes": "64k"}
    for k, v in settings.items():
        spark.conf.set(f"spark.sql.{k}", v)
    try:
        dim = spark.range(3).select(F.col("id").alias("k"), F.lit("x").alias("sk"))
        joined = scale.lookup_join(spark.read.parquet(path).select("id", "k"), dim, ["k"])
        assert len(joined.groupBy(F.spark_partition_id()).agg(F.max("id"), F.max("sk")).collect()) > 2
        assert "wide" not in plan(joined)
    finally:
        for k in settings:
            spark.conf.unset(f"spark.sql.{k}")


def test_star_inference(spark):
    fact = spark.createDataFrame([(1, 2, 3)], "process_key int, date_key int, other_key int")
    dims = {
        "dim_date": spark.createDataFrame([(2, 5)], "date_key int, day int"),
        "dim_processes": spark.createDataFrame([(1, "etch")], "process_sk int, name string"),
    }
    joins = star.infer_joins({"fact_a": fact}, dims)
    assert [(j.fact_field, j.dim, j.dim_field) for j in joins] == [
        ("process_key", "dim_processes", "process_sk"), ("date_key", "dim_date", "date_key")
    ]
    assert star.star_join(fact, dims, joins).first().dim_processes_name == "etch"
    assert dict(star.column_roles(dims["dim_processes"].schema, False)) == {"process_sk": "PK", "name": "str"}


# --- quality and standards -------------------------------------------------------------------


def test_rules(people):
    rules = [
        quality.Rule("named", "not_null", "name", severity="Low"),
        quality.Rule("positive", "range", "balance", 0, 1e9),
        quality.Rule("ids", "unique", "id"),
        quality.Rule("groups", "unique", "grp", block=False),
        quality.Rule("three letters", "custom", assertion="length(name) = 3", severity="Medium"),
    ]
    judged = quality.judge(quality.run_rules(people, rules))
    assert rows(judged, "rule", "failed_rows", "result", "blocks_downstream") == sorted([
        ("named", 1, "Warn", False), ("positive", 1, "Fail", True), ("ids", 0, "Pass", False),
        ("groups", 1, "Fail", False), ("three letters", 1, "Warn", False),
    ])
    assert quality.blocked(judged)


def test_profiles(people):
    assert rows(quality.completeness(people)) == [(3, 92)]
    assert rows(quality.completeness(people.filter("false"))) == [(0, 0)]
    exact = {r.column_name: r for r in quality.column_profile(people, exact=True).collect()}
    assert (exact["grp"].distinct_values, exact["name"].null_share) == (2, pytest.approx(1 / 3))
    near = {r.column_name: r.distinct_values for r in quality.column_profile(people).collect()}
    assert near == {"id": 3, "name": 2, "balance": 3, "grp": 2}


def test_sensitive_fields(spark):
    text = "Mail a.b@c.org, call +49 301 555 1234, card 1111 2222 3333 4444, id 123-45-6789, API_KEY= x, 10.0.0.1"
    df = spark.createDataFrame([(1, text), (2, "nothing here"), (3, None)], "id int, body string")
    found = quality.sensitive_scan(df, "t")
    assert [r.kind for r in found.orderBy("kind").collect()] == sorted(p[0] for p in quality.SENSITIVE_PATTERNS)
    assert all(r.hits == 1 for r in found.collect())
    schema = quality.schema_frame({"t": spark.createDataFrame([], "operator_phone string, s_name string, price double")})
    assert rows(quality.sensitive_names(schema), "column_name", "suggested_level") == [
        ("operator_phone", "Confidential"), ("s_name", "Confidential")
    ]


def test_guards_never_hide_a_match(spark):
    """Every text that a pattern matches passes its cheap test."""
    import re
    import string

    import hypothesis.strategies as st
    from hypothesis import given, settings

    patterns = [(re.compile(rx), guard) for _, rx, _, guard in quality.SENSITIVE_PATTERNS]
    piece = st.sampled_from(["api", "_", "key", "TOKEN", "Secret", "=", ":", "@", ".", "com", "12", "345", "6789", "-", " ", "1"])

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.one_of(piece, st.text(string.printable, max_size=2)), max_size=14).map("".join))
    def check(text):
        for pattern, guard in patterns:
            if pattern.search(text):
                assert any(c.isdigit() for c in text) if guard == quality.DIGITS else any(g in text.lower() for g in guard)

    check()


def test_naming_standards(spark):
    schema = quality.schema_frame({
        "fact_a": spark.createDataFrame([], "ProcessID int, cal_date date"), "sales": spark.createDataFrame([], "x int")
    })
    assert rows(quality.naming_violations(schema)) == [
        ("fact_a", "ProcessID", "lower_snake_case", "Rename to process_id"),
        ("sales", "", "table prefix", "Use one of dim_, fact_"),
    ]


# --- graph, matching, monitoring -------------------------------------------------------------


def test_reachable_handles_cycles_and_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], catalog.EDGE)
    assert rows(catalog.impact(edges, "a")) == [("b", 1), ("c", 2), ("d", 3)]
    assert rows(catalog.impact(edges, "a", 1)) == [("b", 1)]
    assert rows(catalog.one_hop(edges, "c")) == [("a", "downstream"), ("b", "upstream"), ("d", "downstream")]


def companies(spark, *data):
    return spark.createDataFrame(list(data), "id string, name string, city string")


def test_matching(spark):
    left = companies(spark, ("l1", "Acme Corp.", "B"), ("l2", "Beta GmbH", "B"), ("l3", "Gamma", "M"), ("l4", "Gamma", "M"))
    right = companies(spark, ("r1", "ACME corp", "B"), ("r2", "Beta Gmbi", "B"), ("r3", "gamma", "M"), ("r4", "Delta", "M"))
    rules = [[matching.Term("city", "city"), matching.Term("name", "name", "similarity", 0.85)]]
    out = matching.match(left, right, "id", "id", rules)
    assert rows(out, "left_id", "right_id", F.round("confidence", 3), "left_records") == [
        ("l1", "r1", 1.0, 1), ("l2", "r2", 0.875, 1), ("l3", "r3", 1.0, 2)
    ]
    found = rows(matching.conflicts(left, right, "id", "id", rules))
    assert found == [("right", "r3", "one-to-many"), ("right", "r4", "unmatched")]
    with pytest.raises(SpecError):
        matching.match(left, right, "id", "id", [[matching.Term("name", "name", "similarity")]])


def test_two_rules_with_different_partners_are_a_conflict(spark):
    left = companies(spark, ("l1", "one", "B"), ("l2", "two", "M"))
    right = companies(spark, ("r1", "one", "M"))
    rules = [[matching.Term("name", "name")], [matching.Term("city", "city", "normalized")]]
    assert rows(matching.match(left, right, "id", "id", rules), "left_id") == [("l1",), ("l2",)]
    assert ("right", "r1", "one-to-many") in rows(matching.conflicts(left, right, "id", "id", rules))


def test_value_shared_by_many_records_is_not_paired(spark):
    """1000 by 1000 records with one value give 1000 rows, not a million."""
    many = spark.range(1000).select(F.col("id").cast("string"), F.lit("same").alias("name"), F.lit("x").alias("city"))
    out = matching.match(many, many, "id", "id", [[matching.Term("name", "name")]])
    assert out.count() == 1000 and out.first().left_records == 1000


@pytest.mark.parametrize("bound", [0.6, 0.7, 0.85, 0.95])
def test_rare_pairs_find_every_similar_text(spark, bound):
    """All pairs above the threshold, as a plain double loop finds them; texts of all lengths in one block."""
    import random

    rnd = random.Random(int(bound * 100))
    stems = ["", "A", "AB", "ABAB", "AAAAAA", "SUPPLIER0001", "MIXERLINE77", "TANK"]
    names = set()
    for _ in range(150):
        text = list(rnd.choice(stems))
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(len(text) + 1)
            text[at : at + rnd.randrange(2)] = rnd.choice(["A", "B", "7", ""])
        names.add("".join(text))
    left, right = sorted(names)[::2], sorted(names)[1::2]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    def like(a, b):
        return 1.0 if not a and not b else 1 - distance(a, b) / max(len(a), len(b))

    expected = sorted((a, b) for a in left for b in right if like(a, b) >= bound)
    frames = [companies(spark, *[(n, n, "x") for n in side]) for side in (left, right)]
    rules = [[matching.Term("city", "city"), matching.Term("name", "name", "similarity", bound)]]
    assert sorted(rows(matching.match(*frames, "id", "id", rules), "left_id", "right_id")) == expected


def test_no_partner_near(spark):
    left = spark.createDataFrame([(1, dt.date(2024, 1, d)) for d in (1, 5, 9)], "k int, d date")
    right = spark.createDataFrame([(1, dt.date(2024, 1, 2)), (2, dt.date(2024, 1, 5)), (1, dt.date(2024, 1, 11))], "k int, e date")
    assert rows(matching.without_partner_near(left, right, ["k"], "d", "e", 1)) == [
        (1, dt.date(2024, 1, 5)), (1, dt.date(2024, 1, 9))
    ]
    assert rows(matching.without_partner_near(left, right, ["k"], "d", "e", 2)) == [(1, dt.date(2024, 1, 5))]
    assert rows(matching.without_partner_near(left, right, ["k"], "d", "e", 0)) == rows(left)


def test_site_states(spark):
    now = dt.datetime(2024, 1, 1, 12)
    df = spark.createDataFrame([(now,), (now - dt.timedelta(seconds=301),), (None,)], "at timestamp")
    states = df.select(monitoring.site_state(F.col("at"), F.lit(now)).alias("state"))
    assert rows(monitoring.site_totals(states)) == [(3, 1, 1, 1)]


def test_json_lookup(spark):
    df = spark.createDataFrame([('{"log":{"level":"warn"},"msg":"m"}',), ('{"level":"info"}',), ("{}",)], "doc string")
    got = df.select(monitoring.first_json(F.col("doc"), "level", "log.level")).collect()
    assert [r[0] for r in got] == ["warn", "info", ""]


def test_asset_categories(spark):
    df = spark.createDataFrame(
        [("top", 100, 10, 1, 10, 99.0), ("dead", 0, 500, 9, 0, 60.0), ("dear", 20, 900, 80, 2, 70.0)],
        "asset string, usage int, storage int, compute int, dependants int, quality double",
    )
    assert rows(catalog.asset_score(df), "asset", "category") == [("dead", "zombie"), ("dear", "costly"), ("top", "high")]


def test_semantic_entries_are_not_overwritten(spark):
    stored = spark.createDataFrame([("t1", "table", "mine", None, None, "Internal", "desc")], catalog.ENTRY)
    assets = spark.createDataFrame([("t1", "machine", ""), ("t2", None, "Restricted"), ("", "x", "")], "name string, description string, sensitivity string")
    terms = spark.createDataFrame([("m", "def", "a/b")], "name string, definition string, formula string")
    out = catalog.compile_entries(stored, assets, terms)
    assert rows(out, "entity_urn", "nl_description", "sensitivity", "status") == [
        ("m", "def Formula: a/b", "Internal", "desc"), ("t1", "mine", "Internal", "desc"), ("t2", None, "Restricted", "pend")
    ]
    changed = spark.createDataFrame([("t2", "table", "now known", None, None, "", None)], catalog.ENTRY)
    assert ("t2", "now known", "Internal", "desc") in rows(
        catalog.upsert_entries(out, changed), "entity_urn", "nl_description", "sensitivity", "status"
    )


def test_candidates_of_one_block_are_few_of_its_pairs(spark):
    """Names with a common beginning and end in a single block: shared ends are no segments."""

    def candidates(n):
        name = F.concat(F.lit("CUSTOMER"), F.substring(F.sha2(F.concat(F.lit("x"), F.col("id")), 256), 1, 12), F.lit("LTD"))
        texts = spark.range(n).select(F.lit(0).alias("rule"), F.lit("b").alias("key"), F.upper(name).alias("s"), F.lit(0.85).alias("t"), "id")
        ends = matching._shared_ends(texts.select("rule", "key", "s"))
        assert ends.first()["head"] == 8 and ends.first()["tail"] == 3
        rows = texts.join(ends, ["rule", "key"])
        left, right = matching._segments(rows), matching._probes(rows)
        return left.select("token", "id").join(right.select("token", F.col("id").alias("other")), "token").distinct().count()

    assert candidates(2_000) < 2_000 * 2_000 / 100 and candidates(16_000) < 16_000 * 16_000 / 100


def test_low_similarities_are_refused(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id int, city string, name string")
    rules = [[matching.Term("city", "city"), matching.Term("name", "name", "similarity", 0.5)]]
    with pytest.raises(SpecError):
        matching.match(df, df, "id", "id", rules)


# --- reach and links ---------------------------------------------------------------------------


def plain_depths(edges, starts):
    depth, layer, d = {s: 0 for s in starts}, set(starts), 0
    while layer:
        d += 1
        layer = {b for a, b in edges if a in layer and b not in depth}
        depth |= {b: d for b in layer}
    return {n: d for n, d in depth.items() if d}


@pytest.fixture
def rounds(monkeypatch):
    """Counts the steps that are written."""
    made = []
    write = catalog.materialise
    monkeypatch.setattr(catalog, "materialise", lambda df, *how: made.append(1) or write(df, *how))
    return made


def reach(spark, edges, starts, max_depth=None):
    frame = spark.createDataFrame(edges, "src string, dst string")
    nodes = spark.createDataFrame([(s,) for s in starts], "node string")
    return {r.node: r.depth for r in catalog.reachable(frame, nodes, max_depth).collect()}


def test_a_long_chain_takes_few_rounds(spark, rounds):
    """A thousand nodes in a row, with a shortcut, a way back, a ring that nothing leads to, and a second way that joins."""
    edges = [(f"n{i}", f"n{i + 1}") for i in range(1_000)] + [("n100", "n400"), ("n900", "n5"), ("n1000", "n1000")]
    edges += [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [(f"m{i}", f"m{i + 1}") for i in range(90)] + [("m90", "n350"), ("n3", "m0")]
    assert reach(spark, edges, ["n0"]) == plain_depths(edges, ["n0"])
    assert len(rounds) < 35
    assert reach(spark, edges, ["n0"], 120) == {n: d for n, d in plain_depths(edges, ["n0"]).items() if d <= 120}


def test_reach_in_random_graphs(spark):
    rnd = random.Random(4)
    for n, m in ((40, 45), (60, 120), (80, 84)):
        edges = [(f"a{rnd.randrange(n)}", f"a{rnd.randrange(n)}") for _ in range(m)]
        edges += [(f"c{i}", f"c{i + 1}") for i in range(30)] + [("a1", "c0"), ("c30", "a2")]
        assert reach(spark, edges, ["a1", "c7"]) == plain_depths(edges, ["a1", "c7"])


def test_conflicts_link_values_once(spark, monkeypatch):
    made, link = [], matching._links
    monkeypatch.setattr(matching, "_links", lambda *a: made.append(1) or link(*a))
    left = spark.createDataFrame([("l1", "anna smith", "x"), ("l2", "ann smith", "x"), ("l3", "zed", "x"), ("l4", "bo", "y")], "id string, name string, city string")
    right = spark.createDataFrame([("r1", "anna smith", "x"), ("r2", "anna smyth", "x"), ("r3", "bob", "z")], "id string, name string, city string")
    rules = [[matching.Term("city", "city"), matching.Term("name", "name", "similarity", 0.85)]]
    found = rows(matching.conflicts(left, right, "id", "id", rules))
    assert len(made) == 1
    assert found == sorted([("left", "l1", "one-to-many"), ("right", "r1", "one-to-many"), ("left", "l3", "unmatched"), ("left", "l3", "low-confidence"),
                            ("left", "l4", "unmatched"), ("right", "r3", "unmatched")])


def test_parts_of_names(spark):
    from plumbline.functions import cleansing

    texts = ["", None, "a bb cc", "?!", "x.y.z", "urn:a:b:(urn:a:c:hive,db.s.t,PROD)", "urn:a:b:(urn:a:c:hive,t,PROD)", "urn:a:b:(hive,t)"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = df.select(cleansing.longest_token(t).alias("a"), cleansing.last_parts(t).alias("b"), cleansing.urn_parts(t).alias("c")).collect()
    assert [r.a for r in got[:5]] == [None, None, "bb", None, "x"]
    assert [r.b for r in got[:5]] == ["", None, "a bb cc", "?!", "y.z"]
    assert [r.c and tuple(r.c) for r in got] == [None] * 5 + [("hive", "db.s", "t"), ("hive", "", "t"), None]
