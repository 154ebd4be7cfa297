"""Small cases with known answers; names, patterns and expected texts in them are fixed values."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from schemahelm.functions import defaults, jsondiff
from schemahelm.functions import labels as lb
from schemahelm.functions import text as tx
from schemahelm.functions import typing as ty
from schemahelm.operators import access, audit, breaker, diff, merge, metrics, policy, quality, routing
from schemahelm.sources import catalog, documents, registry, targets

FIELD = "tenant_id string, db_id bigint, table_name string, column_name string, data_type string, is_nullable boolean, is_unique boolean, has_default boolean, default_value string, validator string"


def fields(spark, *rows):
    full = [("t", 1, *r, *(False, False, False, None, "")[len(r) - 3 :]) if len(r) >= 3 else r for r in rows]
    return spark.createDataFrame(full, FIELD)


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# --- diff -------------------------------------------------------------------------------------------------


def test_diff_updated_and_added(spark):
    old = fields(spark, ("posts", "name", "varchar"))
    new = fields(spark, ("posts", "name", "text"), ("posts", "age", "int"))
    assert values(diff.diff(old, new), "column_name", "change_type") == [("age", "added"), ("name", "updated")]


def test_diff_deleted(spark):
    old = fields(spark, ("posts", "name", "varchar"))
    assert values(diff.diff(old, old.limit(0)), "column_name", "change_type") == [("name", "deleted")]


def test_diff_same_is_unchanged_and_blank_validator_equals_null(spark):
    old = fields(spark, ("posts", "name", "varchar"))
    new = old.withColumn("validator", F.lit(None).cast("string"))
    assert values(diff.diff(old, new), "change_type") == [("unchanged",)]


def test_report_lines(spark):
    old = fields(spark, ("posts", "name", "varchar", True))
    new = fields(spark, ("posts", "name", "text", False), ("posts", "age", "int"))
    lines = [r[0] for r in diff.diff_report(diff.diff(old, new)).select("line").collect()]
    assert sorted(lines) == ["+ posts.age (int)", "± posts.name type: varchar → text, nullable: true → false"]


def test_reconcile_reports_every_unequal_partner(spark):
    meta = fields(spark, ("posts", "cf1", "text"))
    target = fields(spark, ("posts", "cf1", "int"), ("posts", "cf1", "bool"))
    rows = values(diff.reconcile(meta, target, ["column_name"]), "status", "reason")
    assert rows == [("mismatched", "type: text != bool"), ("mismatched", "type: text != int")]


def test_reconcile_passes_with_one_equal_partner(spark):
    meta = fields(spark, ("posts", "cf1", "text"))
    target = fields(spark, ("posts", "cf1", "int"), ("posts", "cf1", "text"))
    assert diff.reconcile(meta, target, ["column_name"]).count() == 0


def test_reconcile_folds_shared_names(spark):
    wide = lambda typ, n: spark.range(n).select(F.lit("t").alias("tenant_id"), F.col("id").cast("string").alias("table_name"), F.lit("id").alias("column_name"), F.lit(typ).alias("data_type"), *[F.lit(False).alias(c) for c in ("is_nullable", "is_unique", "has_default")], F.lit(None).cast("string").alias("default_value"))
    rows = values(diff.reconcile(wide("int", 3000), wide("text", 2000), ["column_name"]), "status", "reason", "pairs")
    assert rows == [("mismatched", "type: int != text", 6_000_000)]


def test_apply_reaches_the_desired_state_and_repair_leaves_nothing_missing(spark):
    old = fields(spark, ("a", "x", "int"), ("a", "y", "int"), ("b", "z", "text"))
    new = fields(spark, ("a", "x", "text"), ("c", "w", "int"), ("b", "z", "text"))
    done = merge.apply(old, new, "bob")
    again = diff.diff(done.registry, new)
    assert values(again, "change_type") == [("unchanged",)] * 3
    assert values(done.audit, "action", "added_count", "removed_count") == [("add", 10, 0), ("delete", 0, 10), ("update", 1, 1)]
    repaired = diff.repair(old, new)
    assert diff.reconcile(old, repaired).where("status = 'missing_in_target'").count() == 0


def test_apply_refuses_newer_documents(spark):
    old = fields(spark, ("a", "x", "int"))
    with pytest.raises(merge.VersionTooOld):
        merge.apply(old, old, dry_run=True, required_version="0.13.0", current_version="0.3.0")


# --- defaults, types, versions ----------------------------------------------------------------------------

DEFAULT_CASES = [
    (("mysql", "date", "expression", "CURRENT_TIMESTAMP", True), ("expression", "CURRENT_DATE", False, "mapped")),
    (("mysql", "date", "expression", "curdate()", True), ("expression", "CURRENT_DATE", False, "as-is")),
    (("mysql", "varchar", "expression", "NOW()", False), ("none", "", False, "cleared")),
    (("mysql", "time", "literal", "2024-01-02 03:04:05", True), ("literal", "03:04:05", False, "mapped")),
    (("mysql", "time", "expression", "CURTIME()", True), ("expression", "CURRENT_TIME", False, "as-is")),
    (("mysql", "int", "literal", "3", True), ("literal", "3", False, "mapped")),
    (("postgres", "date", "literal", "2024-01-02T03:04:05+09:00", False), ("literal", "2024-01-02", False, "mapped")),
]


@pytest.mark.parametrize("given, expected", DEFAULT_CASES)
def test_normalize_default(spark, given, expected):
    n = defaults.normalize_default(*[F.lit(v) for v in given])
    assert one(spark, n["mode"], n["raw"], n["on_update"], n["action"]) == expected


def test_resolve_default(spark):
    r = defaults.resolve_default(F.lit("postgres"), F.lit("date"), F.lit("literal"), F.lit(" o'x "), F.lit(False))
    assert one(spark, r["clause"], r["norm"]) == (" DEFAULT 'o''x'::timestamp", "'o''x'::timestamp")
    r = defaults.resolve_default(F.lit("mongo"), F.lit("date"), F.lit("expression"), F.lit("NOW()"), F.lit(False))
    assert one(spark, r["has_default"], r["error"]) == (False, "expression default is not supported for MongoDB")


def test_kinds_do_not_strip_lengths_unless_asked(spark):
    assert one(spark, ty.sql_kind(F.lit("varchar(255)")), ty.sql_kind(F.lit("varchar(255)"), strip=True)) == ("any", "string")


@pytest.mark.parametrize("a, b, less", [("0.3.0", "0.13.0", True), ("0.13.0", "0.3.0", False), ("0.1.0", "0.1.1", True), ("invalid", "1.0.0", None), ("1.0.0-rc.1", "1.0.0", True)])
def test_semver_lt(spark, a, b, less):
    assert one(spark, tx.semver_lt(F.lit(a), F.lit(b))) == (less,)


def test_next_semver(spark):
    v = F.lit("1.2.9")
    assert one(spark, *[tx.next_semver(v, b) for b in ("patch", "minor", "major")]) == ("1.2.10", "1.3.0", "2.0.0")
    assert one(spark, tx.next_semver(F.lit("odd"))) == ("odd",)


def test_fnv1a32_matches_bytewise_definition(spark):
    def fnv(text):
        h = 2166136261
        for b in text.encode():
            h = ((h ^ b) * 16777619) % 2**32
        return h

    texts = ["", "a", "tenant:1", "größe", "日本"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.fnv1a32("t").alias("h")).collect()
    assert {r.t: r.h for r in rows} == {t: fnv(t) for t in texts}


# --- JSON diffs -------------------------------------------------------------------------------------------

PAIRS = [
    ('{"x":1}', '{"x":1}', 0, 0),
    ("{}", '{"a":1,"b":1,"c":1,"d":1,"e":1}', 5, 0),
    ('{"a":1,"b":2}', '{"c":3,"d":4,"e":5}', 3, 2),
    ('{"v":1}', '{"v":2}', 1, 1),
    ("{}", '{"a":1,"b":1,"c":1,"d":1,"e":1,"f":1}', 6, 0),
    ('{"a":1}', '{"a":1,"b":2}', 2, 1),
]


def test_audit_pairs(spark):
    df = spark.createDataFrame([p[:2] for p in PAIRS], "b string, a string")
    got = df.select(jsondiff.flat_diff_counts("b", "a").alias("f"), jsondiff.nested_diff_counts("b", "a").alias("n")).collect()
    assert [tuple(r.f) for r in got] == [p[2:] for p in PAIRS] == [tuple(r.n) for r in got]


def test_audit_windows_after_backfill(spark):
    rows = [(i, "t", "u", "update", "posts", "c", b, a, 0, 0, 0) for i, (b, a, _, _) in enumerate(PAIRS[:5])]
    schema = "id bigint, tenant_id string, actor string, action string, table_name string, column_name string, before_json string, after_json string, added_count int, removed_count int, change_count int"
    log = audit.backfill_audit_counts(spark.createDataFrame(rows, schema))
    window = lambda lo, hi: audit.filter_audit(log, min_changes=lo, max_changes=hi).count()
    assert (window(0, 5), window(2, 5), window(0, 0), window(None, None)) == (4, 3, 1, 5)


def test_flat_counts_equal_line_diff_on_random_objects(spark):
    rng = random.Random(5)
    doc = lambda: json.dumps({rng.choice("abcdefgh"): rng.choice([1, 2, "x", None, True, 1.5]) for _ in range(rng.randrange(6))})
    df = spark.createDataFrame([(doc(), doc()) for _ in range(400)], "b string, a string")
    differing = df.where(jsondiff.flat_diff_counts("b", "a") != jsondiff.nested_diff_counts("b", "a"))
    assert differing.count() == 0


# --- labels and routing -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [("a", ["Region=Tokyo", "Env=Prod", "GPU"]), ("b", ["region=Tokyo", "ENV=Stg"]), ("c", ["Region=Osaka", "Deprecated"])]
    df = spark.createDataFrame(rows, "tkey string, labels array<string>")
    return df.withColumn("label_set", lb.label_set("labels"))


@pytest.mark.parametrize(
    "query, keys",
    [
        ("GPU", "a"), ("Region", "abc"), ("REGION=Tokyo,ENV in (Prod,Stg),!Deprecated", "ab"), ("!Deprecated", "ab"),
        ("region=osaka,env=prod", ""), ("GPU|ENV=Prod", "a"), ("", "abc"), ("env in ()", ""),
    ],
)
def test_selectors(labelled, query, keys):
    assert "".join(sorted(r.tkey for r in routing.select_targets(labelled, query).collect())) == keys


def test_labels_from_headers(spark):
    headers = F.create_map(F.lit("x-env"), F.lit(" Prod!"), F.lit("X-Empty"), F.lit("?"))
    mapping = {"X-Env": "Env", "X-Empty": "none", "X-Gone": "gone"}
    got = one(spark, lb.labels_from_map(headers, mapping, {"zone": "A"}, ignore_case=True), lb.labels_from_map(headers, mapping))
    assert got == (["env=prod", "Env", "zone=a", "zone"], [])


def test_find(labelled):
    names = lambda df: "".join(r.tkey for r in df.collect())
    assert names(routing.find_all(labelled, "GPU", "REGION=Tokyo")) == "a"
    assert names(routing.find_any(labelled, "REGION=Tokyo", "REGION=Osaka")) == "abc"
    assert names(routing.find_all(labelled)) == ""


def test_route_strategies(spark):
    rows = [("a", ["group=1"]), ("b", ["group=1", "primary=true"]), ("c", ["group=1"]), ("d", ["group=1"]), ("e", ["group=1"])]
    t = spark.createDataFrame(rows, "tkey string, labels array<string>").withColumn("label_set", lb.label_set("labels"))
    reqs = spark.createDataFrame([(1, "primary=true", "tenant:acme"), (2, "doesnotexist=true", "tenant:beta"), (3, "", "")], "id int, prefer_label string, hash_source string")
    chosen = lambda s: [r.chosen for r in routing.route(reqs, t, s).orderBy("id").collect()]
    assert chosen("first") == ["a", "a", "a"]
    assert chosen("prefer") == ["b", None, "a"]
    hashed = chosen("hash")
    assert hashed[0] != hashed[1] and None not in hashed
    assert routing.route(reqs, t.limit(0), "hash").where("chosen is not null").count() == 0


def test_ordered_index_is_the_sorted_position(spark):
    keys = [f"k{i * 7919 % 3001}" for i in range(3001)]
    df = routing.ordered_index(spark.createDataFrame([(k,) for k in keys], "k string"), "k", slices=8)
    assert {r.k: r.idx for r in df.collect()} == {k: i for i, k in enumerate(sorted(keys))}


def test_candidates_are_complete_and_found_by_rank(spark):
    targets_ = spark.createDataFrame([(f"k{i:02d}", ["gold"] if i % 3 == 0 else ["silver"]) for i in range(9)], "tkey string, label_set array<string>")
    reqs = spark.createDataFrame([(1, "k04", "gold"), (2, None, "gold"), (3, "k03", None), (4, "gone", "tin")], "id bigint, explicit_key string, prefer_label string")
    rows = routing.candidates(reqs, targets_).collect()
    order = lambda primary, want: [r.tkey for r in sorted(rows, key=lambda r: r.position) if (r["primary"], r.want) == (primary, want)]
    keys = [f"k{i:02d}" for i in range(9)]
    gold = keys[::3] + [k for k in keys if k not in keys[::3]]
    assert order("k04", "gold") == ["k04"] + [k for k in gold if k != "k04"]
    assert order(None, "gold") == gold and order("k03", "") == ["k03"] + [k for k in keys if k != "k03"] and order(None, "tin") == keys
    for n in range(1, 11):
        got = {r.id: r.tkey for r in routing.candidate_at(reqs, targets_, F.lit(n)).collect()}
        want = [order("k04", "gold"), order(None, "gold"), order("k03", ""), order(None, "tin")]
        assert [got[i] for i in (1, 2, 3, 4)] == [x[n - 1] if n <= 9 else None for x in want]


# --- scans ------------------------------------------------------------------------------------------------


def test_filter_tables(spark):
    pg = [("pg_catalog", "pg_proc"), ("pg_temp_3", "temp_table"), ("public", "schema_migrations"), ("public", "meta_audit_logs"), ("public", "users"), ("public", "META_custom_fields")]
    df = spark.createDataFrame(pg, "table_schema string, table_name string")
    assert values(catalog.filter_tables(df, "postgres"), "table_name") == [("users",)]
    my = spark.createDataFrame([("schema_migrations",), ("meta_registry_schema_version",), ("users",)], "table_name string")
    assert values(catalog.filter_tables(my, "mysql"), "table_name") == [("users",)]
    assert values(catalog.filter_tables(my.where("table_name = 'users'"), "postgres", prefix=""), "table_name") == [("users",)]


def test_reserved_patterns():
    assert catalog.reserved_patterns(override=" a , b,") == ["a", "b"]
    assert catalog.reserved_patterns(legacy=["x"]) == ["^x$"]
    assert catalog.reserved_patterns("p_")[0] == "^p_audit_logs"


def test_merge_validators_keeps_configured_ones(spark):
    scan = fields(spark, ("posts", "email", "text"), ("posts", "title", "text", False, False, False, None, "uuid"))
    old = fields(spark, ("posts", "email", "text", False, False, False, None, "email"), ("posts", "title", "text", False, False, False, None, "email"))
    assert values(merge.merge_validators(scan, old), "column_name", "validator") == [("email", "email"), ("title", "uuid")]


def test_document_schema_of_a_validated_collection(spark):
    doc = '{"required":["email"],"properties":{"email":{"bsonType":"string"},"age":{"bsonType":["int"]},"nickname":{"bsonType":"string","default":"x"}}}'
    df = documents.fields_from_jsonschema(spark.createDataFrame([("users", doc)], "collection string, validator string"))
    idx = spark.createDataFrame([("users", "i1", "email")], "table_name string, index_name string, column_name string")
    out = catalog.mark_unique(df, idx, add_missing=True)
    assert values(out, "column_name", "data_type", "is_nullable", "is_unique", "has_default") == [
        ("age", "int", True, False, False), ("email", "string", False, True, False), ("nickname", "string", True, False, True),
    ]


def test_registry_versions(spark):
    docs = [
        ('{"version":"0.1","fields":[{"table":"p","column":"e","type":"varchar(255)","placeholder":"ph"}]}',),
        ('{"version":"0.2","fields":[{"table":"p","column":"f","type":"int","default":"7"}]}',),
        ('{"version":"0.3","fields":[{"table":"p","column":"g","type":"int","default":{"enabled":true,"value":"8"}},{"table":"p","column":"h","type":"int","default":{"enabled":false}},{"table":"p","column":"i","type":"int","default":9,"display":{"widget":"number"}}]}',),
    ]
    df = registry.read_registry_docs(spark.createDataFrame(docs, "doc string"))
    got = [tuple(r) for r in df.orderBy("column_name").select("column_name", "widget", "placeholder_key", "has_default", "default_value").collect()]
    assert got == [("e", "text", "ph", False, None), ("f", None, None, True, "7"), ("g", "text", None, True, "8"), ("h", "text", None, False, None), ("i", "number", None, True, "9")]


def test_widget_file_names(spark):
    names = [".w.json", "w.json~", "#w.json#", "x.swp", "ok.json"]
    df = spark.createDataFrame([(n,) for n in names], "n string").where(~targets.ignored_file(F.col("n")))
    assert values(df, "n") == [("ok.json",)]


# --- rules, access, quality -------------------------------------------------------------------------------


def test_rule_order(spark):
    rules = [
        policy.Rule("email", "plugin://email-input", validator=["email"]),
        policy.Rule("date", "plugin://date-input", types=["date"]),
        policy.Rule("fallback", "plugin://text-input"),
    ]
    df = spark.createDataFrame([("d", "date", ""), ("e", "x", "email"), ("u", "unknown", "")], "column_name string, data_type string, validator string")
    assert values(policy.classify(df, rules), "column_name", "resolved") == [("d", "plugin://date-input"), ("e", "plugin://email-input"), ("u", "plugin://text-input")]


def test_suggestions_continue_past_rules_without_stop(spark):
    rules = [policy.Rule(str(i), f"plugin://w{i}", stop=i != 1) for i in range(4)]
    df = spark.createDataFrame([("c", "int", "")], "column_name string, data_type string, validator string")
    assert policy.suggest(df, rules, top=2).first()["suggestions"] == ["core://auto", "plugin://w0", "plugin://w1", "plugin://w2"]


@pytest.mark.parametrize(
    "pattern, path, ok",
    [("/v1/*", "/v1/a/b", True), ("/v1/*", "/v2/a", False), ("/v1/x/:id", "/v1/x/9", True), ("/v1/x/:id", "/v1/x/9/y", False), ("/v1/{id}/a", "/v1/{id}/a", True), ("/*", "/z", True)],
)
def test_path_patterns(spark, pattern, path, ok):
    pol = spark.createDataFrame([(1, pattern, "*")], "role_id bigint, path string, method string")
    res = spark.createDataFrame([(path, "GET")], "path string, method string")
    assert (access.policy_hits(res, pol).count() == 1) is ok


def test_admin_has_standing_access(spark):
    roles = spark.createDataFrame([(9, "admin")], "id bigint, name string")
    none = spark.createDataFrame([], "role_id bigint, path string, method string")
    assert access.with_admin(none, roles).count() == 2


def test_validators(spark):
    with pytest.raises(quality.ValidatorExists):
        quality.register_validator("email", lambda c, p: F.lit(True))
    assert {"none", "email", "number", "uuid", "regex", "uppercase"} <= set(quality.registered_validators())


def test_state_hash_changes_with_any_row(spark):
    rows = [("a", "1", 1), ("b", "2", 2)]
    tag = lambda r: metrics.state_hash(spark.createDataFrame(r, "id string, version string, updated_at int")).first()["etag"]
    assert tag(rows) == tag(rows[::-1]) != tag([("a", "1", 1), ("b", "3", 2)])


def test_commit_leaves_other_partitions_alone(spark, tmp_path):
    key, schema = ["tenant_id", "column_name"], "tenant_id string, column_name string, data_type string"
    path = str(tmp_path / "fields")
    files = lambda t: sorted(p.name for p in (tmp_path / "fields" / f"tenant_id={t}").iterdir() if p.suffix == ".parquet")
    merge.commit_upsert(spark, path, spark.createDataFrame([("a", "x", "int"), ("b", "x", "int"), ("b", "y", "int")], schema), key)
    before = files("a"), files("b")
    for _ in range(2):  # repeating a commit changes nothing
        merge.commit_upsert(spark, path, spark.createDataFrame([("b", "y", "text"), ("c", "z", "int")], schema), key)
        assert values(spark.read.parquet(path), *key, "data_type") == [("a", "x", "int"), ("b", "x", "int"), ("b", "y", "text"), ("c", "z", "int")]
    assert files("a") == before[0] and files("b") != before[1]


def test_profile_is_exact(spark):
    from schemahelm.sources.profile import profile_tables

    rows = [(i, i // 2 * 2 if i < 1998 else i, str(i % 7), None if i % 2 else i, float(i % 1500), [i], -0.0 if i == 0 else 0.0 if i == 1 else float(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "a int, `b``x` int, c string, d int, e double, f array<int>, g double").repartition(7)
    got = {r.column_name: (r.row_count, r.null_count, r.is_unique) for r in profile_tables({"t": df, "none": df.limit(0).select("a")}).where("table_name = 't'").collect()}
    assert got == {"a": (2000, 0, True), "b`x": (2000, 0, False), "c": (2000, 0, False), "d": (2000, 1000, True), "e": (2000, 0, False), "f": (2000, 0, False), "g": (2000, 0, False)}


def test_fingerprint_counts_repeated_rows(spark):
    tag = lambda r: metrics.state_hash(spark.createDataFrame(r, "id string, version string, updated_at int")).first()["etag"]
    a, b = ("a", "1", 1), ("b", "1", 1)
    assert len({tag(rows) for rows in ([a, a], [b, b], [a, b], [a], [a, a, a, a])}) == 5


def test_pages_of_null_keys(spark):
    from schemahelm.operators.paging import keyset_page, numbered_page

    rows = [(i % 4 or None, i if i % 5 else None, i) for i in range(40)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    for order in ([("a", "asc"), ("b", "desc"), ("c", "asc")], [("a", "desc"), ("b", "asc"), ("c", "desc")]):
        seen, after = [], None
        while True:
            page = keyset_page(df, order, after, 3).collect()
            seen += [tuple(r)[:3] for r in page]
            if not page[0].more:
                break
            after = page[-1].asDict()
        assert len(seen) == 40 and set(seen) == set(rows)
        assert [tuple(r) for o in range(0, 40, 7) for r in sorted(numbered_page(df, order, o, 7).collect(), key=lambda r: seen.index(tuple(r)))] == seen


def test_malformed_pattern_is_a_violation(spark):
    df = spark.createDataFrame([(1, "x1", "y"), (2, "zz", "y")], "id int, code string, other string")
    rules = [{"column": "code", "validator": "regex", "pattern": "^x.$"}, {"column": "other", "validator": "regex", "pattern": "(["}]
    got = {(r.row_key, r.column_name, r.rule, r.value) for r in quality.validate_rows(df, rules, ["id"], "t").collect()}
    assert got == {("2", "code", "regex", "zz"), ("", "other", "pattern", "([")}


def test_events_of_one_id_are_told_apart(spark, tmp_path):
    from schemahelm.streaming import events

    batch = spark.createDataFrame([(1, "n", "ok"), (1, "n", "bad"), (1, "n", "bad"), (2, "n", "ok")], "id int, name string, data string").withColumn("ts", F.current_timestamp())
    sink = events.Sink("s", lambda rows, attempt: ["no" if d == "bad" else None for d in rows["data"]])
    for _ in range(2):  # the second time is a replay of the batch
        out = events.deliver(events.numbered_batch(batch, str(tmp_path / "w"), 0), sink, str(tmp_path / "s"), 2, delay=0.0)
        assert sorted((r.id, r.data, r.error) for r in out.collect()) == [(1, "bad", "no"), (1, "bad", "no"), (1, "ok", None), (2, "ok", None)]
    dlq = str(tmp_path / "dlq")
    events.write_dlq(out, "s", dlq, 0)
    assert events.open_letters(spark, dlq).count() == 2
    one_letter = events.open_letters(spark, dlq).agg(F.min("letter")).first()[0]
    events.retry_dlq(spark, dlq, events.Sink("s", lambda rows, attempt: [None if x == one_letter else "no" for x in rows["letter"]]))
    left = events.open_letters(spark, dlq).collect()
    assert len(left) == 1 and left[0].id == 1 and left[0].letter != one_letter and left[0].attempts == 3


def test_a_waiting_sink_does_not_hold_up_others(spark, tmp_path):
    import time

    from schemahelm.streaming import events

    df = spark.createDataFrame([(i, "n", "d") for i in range(4)], "id int, name string, data string").withColumn("ts", F.current_timestamp())
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    sinks = [events.Sink("down", lambda rows, attempt: ["no"] * len(rows)), events.Sink("up", lambda rows, attempt: [None] * len(rows))]
    work = tmp_path / "work"
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    running = events.run_fanout(stream, sinks, str(work), str(tmp_path / "dlq"), str(tmp_path / "cp"), 2, delay=15.0)
    until = time.monotonic() + 60
    done = lambda name: (work / "log" / "batch_id=0" / f"to={name}" / "_SUCCESS").exists()
    while not done("up") and time.monotonic() < until:
        time.sleep(0.2)
    assert done("up") and not done("down")
    running.awaitTermination(60)
    assert done("down") and spark.read.parquet(str(tmp_path / "dlq")).count() == 4


# --- breaker ----------------------------------------------------------------------------------------------


def _reference_states(rows, policy):
    failures, until, out = 0, None, []
    for seq, ts, outcome in rows:
        if until is not None and ts < until:
            out.append((seq, "open", False, "open"))
            continue
        seen = "closed" if until is None else "half_open"
        if outcome == "ok":
            failures, until = 0, None
        elif seen == "half_open" or outcome == "permanent" or failures + 1 >= policy.open_after:
            failures, until = 0, ts + policy.open_seconds
        else:
            failures += 1
        out.append((seq, seen, True, "closed" if until is None else "open"))
    return out


@pytest.mark.parametrize("slices", [1, 9, 200])
def test_breaker_slices_equal_one_pass(spark, slices):
    rng = random.Random(11)
    policy_ = breaker.BreakerPolicy(open_after=2, open_seconds=20, slices=slices)
    rows, ts = [], 0
    for seq in range(1500):
        ts += rng.choice([0, 1, 3, 9, 40])
        rows.append((seq, ts, rng.choices(["ok", "transient", "permanent"], [5, 4, 1])[0]))
    df = spark.createDataFrame([(s, "k", t, o) for s, t, o in rows], "seq bigint, tkey string, t bigint, outcome string")
    df = df.withColumn("ts", F.timestamp_seconds("t"))
    got = breaker.breaker_states(df, policy_)[0].orderBy("seq").select("seq", "seen", "made", "state").collect()
    assert [tuple(r) for r in got] == _reference_states(rows, policy_)


def test_breaker_opens_and_probes(spark):
    policy_ = breaker.BreakerPolicy(open_after=1, open_seconds=20)
    df = spark.createDataFrame([(1, "p", 0, "transient"), (2, "p", 10, "ok"), (3, "p", 25, "ok")], "seq bigint, tkey string, t bigint, outcome string")
    rows = breaker.breaker_states(df.withColumn("ts", F.timestamp_seconds("t")), policy_)[0].orderBy("seq").select("seen", "made").collect()
    assert [tuple(r) for r in rows] == [("closed", True), ("open", False), ("half_open", True)]


def test_backoff(spark):
    waits = one(spark, *[routing.backoff_ms(F.lit(n), 100, 350) for n in (0, 1, 2, 3, 9)])
    assert waits == (0, 100, 200, 350, 350)


# --- paging -----------------------------------------------------------------------------------------------


def test_pages_cover_the_filtered_set(spark):
    from schemahelm.operators.paging import keyset_page

    df = spark.range(23).select((F.col("id") % 5).alias("a"), F.col("id").alias("b"))
    order, seen, after = [("a", "desc"), ("b", "asc")], [], None
    while True:
        page = keyset_page(df, order, after, 4).orderBy(F.desc("a"), "b").collect()
        seen += [(r.a, r.b) for r in page]
        if not page[0].more:
            break
        after = {"a": page[-1].a, "b": page[-1].b}
    assert seen == sorted(((i % 5, i) for i in range(23)), key=lambda p: (-p[0], p[1]))


# --- streams in several micro-batches ---------------------------------------------------------------------


def _split_source(spark, df, order, n, tmp_path):
    """Files in order, one micro-batch each."""
    path = str(tmp_path / "in")
    cuts = df.approxQuantile(order, [i / n for i in range(1, n)], 0.0)
    bounds = [float("-inf"), *cuts, float("inf")]
    for lo, hi in zip(bounds, bounds[1:]):
        df.where((F.col(order) > lo) & (F.col(order) <= hi)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_breaker_stream_carries_state(spark, tmp_path):
    from schemahelm.streaming import state

    rng = random.Random(3)
    rows, ts = [], 0
    for seq in range(400):
        ts += rng.choice([1, 3, 9])
        rows.append((seq, "k" if seq % 3 else "other", ts, rng.choice(["ok", "transient", "transient"])))
    df = spark.createDataFrame(rows, "seq bigint, tkey string, t bigint, outcome string").withColumn("ts", F.timestamp_seconds("t"))
    policy_ = breaker.BreakerPolicy(open_after=2, open_seconds=15, slices=7)
    out = str(tmp_path / "out")
    state.breaker_stream(_split_source(spark, df, "seq", 4, tmp_path), policy_, out, str(tmp_path / "cp")).awaitTermination(90)
    streamed = spark.read.parquet(out + "/rows")
    told, streamed = streamed.where("seq IS NULL"), streamed.where("seq IS NOT NULL")
    assert all(r["state"] == "half_open" and r["seen"] == "open" and r["us"] % 1_000_000 == 0 for r in told.collect())
    batch = breaker.breaker_states(df, policy_)[0]
    assert values(streamed, "seq", "seen", "made", "state") == values(batch, "seq", "seen", "made", "state")


def test_breaker_timer_tells_of_half_open(spark, tmp_path):
    from schemahelm.streaming import state

    # "quiet" is opened in the first batch and never asked again; "busy" is asked too early, then probed.
    rows = [(1, "quiet", 0, "permanent"), (2, "busy", 0, "permanent"), (3, "busy", 5, "ok"), (4, "busy", 30, "ok"), (5, "other", 40, "ok")]
    df = spark.createDataFrame(rows, "seq bigint, tkey string, t bigint, outcome string").withColumn("ts", F.timestamp_seconds(F.col("t") + 1000))
    out = str(tmp_path / "out")
    policy_ = breaker.BreakerPolicy(open_after=2, open_seconds=15)
    state.breaker_stream(_split_source(spark, df, "seq", 3, tmp_path), policy_, out, str(tmp_path / "cp"), late="0 seconds").awaitTermination(90)
    rows = spark.read.parquet(out + "/rows").select("seq", "tkey", "us", "seen", "made", "state").collect()
    assert ("quiet", 1_015_000_000, "half_open") in {(r.tkey, r.us, r.state) for r in rows if r.seq is None}
    assert [(r.seq, r.seen, r.made) for r in sorted(rows, key=lambda r: r.seq or 0) if r.seq] == [
        (1, "closed", True), (2, "closed", True), (3, "open", False), (4, "half_open", True), (5, "closed", True)]


def test_widget_state_over_batches(spark, tmp_path):
    from schemahelm.streaming import state

    rows = [(1, "a", "upsert", "1"), (2, "b", "upsert", "1"), (3, "a", "remove", None), (4, "c", "bogus", "9"), (5, "b", "upsert", "2"), (6, "a", "upsert", "3"), (7, "b", "remove", None)]
    df = spark.createDataFrame(rows, "seq bigint, id string, change_type string, version string")
    out = str(tmp_path / "out")
    state.widget_state(_split_source(spark, df, "seq", 3, tmp_path), out, str(tmp_path / "cp")).awaitTermination()
    base = spark.createDataFrame([("z", "0")], "id string, version string")
    assert values(state.current_widgets(base, spark.read.parquet(out)), "id", "version") == [("a", "3"), ("z", "0")]
    # A base with some batches applied and the later changes are the same registry.
    newer = state.compact_widgets(spark, base, out, 0)
    assert values(state.current_widgets(newer, state.changes_after(spark, out, 0)), "id", "version") == [("a", "3"), ("z", "0")]


def test_stable_text_is_the_same_on_both_paths(spark):
    docs = ['{"b":1,"a":"x"}', '{"z":null,"é":true,"y":false}', "{}", '{"a":1.0}', '{"a":1.50,"b":2}', '{"a":"q\\"uote"}', '{"a\\n":1}', '{"a":{"b":1}}', '{"a":[1]}',
            "[1]", "no json", "", None, '{"a":12345678901234567890}', '{"a":1e3}', '{"a":"tab\\t"}', '{"a":"/"}', '{"a":-0}', '{"a":1,"a":2}', ' {"k" : "v" } ']
    got = [r[0] for r in spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string").orderBy("i").select(jsondiff.normalize_json("d")).collect()]
    assert got == [None if d is None else jsondiff._stable(d) for d in docs]


def test_fanout_is_idempotent_per_batch(spark, tmp_path):
    from schemahelm.streaming import events

    calls = spark.createDataFrame([(i, "n", "{}", i % 4) for i in range(40)], "id bigint, name string, data string, failing_attempts bigint")
    calls = calls.withColumn("time", F.lit("t"))
    sent = tmp_path / "sent"
    sent.mkdir()

    def send(rows, attempt):
        for i in rows["id"]:
            (sent / f"{i}-{attempt}-{uuid.uuid4().hex}").touch()
        return ["no" if n >= attempt else None for n in rows["failing_attempts"]]

    sink = events.Sink("s", send)
    for run in range(2):
        out = events.deliver(calls, sink, str(tmp_path / "w"), 3, delay=0.0)
        assert out.count() == 40
        assert values(out.groupBy("attempts").agg(F.count_if(F.col("error").isNotNull()).alias("failed"), F.count("id").alias("n")), "attempts", "failed", "n") == [(1, 0, 10), (2, 0, 10), (3, 10, 20)]
        events.write_dlq(out, "s", str(tmp_path / "dlq"), 0)
        # A repeated batch sends only what was not delivered.
        assert len(list(sent.iterdir())) == 40 + 30 + 20 + run * 30
    assert spark.read.parquet(str(tmp_path / "dlq")).count() == 10


def test_retried_letters_leave_the_store(spark, tmp_path):
    from schemahelm.streaming import events

    dlq = str(tmp_path / "dlq")
    spark.createDataFrame([("s", i, "n", "{}", 3, "x") for i in range(6)], "sink string, id bigint, name string, payload string, attempts bigint, last_error string").write.parquet(dlq)
    sink = events.Sink("s", lambda rows, attempt: [None if i % 2 else "no" for i in rows["id"]])
    left, done = events.retry_dlq(spark, dlq, sink)
    assert values(left, "id", "attempts") == [(0, 4), (2, 4), (4, 4)] and values(done, "id") == [(1,), (3,), (5,)]
    assert values(events.open_letters(spark, dlq), "id", "attempts", "last_error") == [(0, 4, "no"), (2, 4, "no"), (4, 4, "no")]
    left, done = events.retry_dlq(spark, dlq, sink)
    assert values(left, "id", "attempts") == [(0, 5), (2, 5), (4, 5)] and done.count() == 0


def test_unreadable_state_is_an_error(spark, tmp_path):
    from schemahelm.streaming import state

    assert state.stored_version(spark, str(tmp_path / "none")) is None
    (tmp_path / "bad" / "applied").mkdir(parents=True)
    (tmp_path / "bad" / "applied" / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        state.stored_version(spark, str(tmp_path / "bad"))


def test_directory_poll(spark, tmp_path):
    from schemahelm.streaming import state

    folder = tmp_path / "d"
    folder.mkdir()
    (folder / "a.json").write_text('{"id":"a","name":"n","type":"widget"}')
    empty = spark.createDataFrame([], state.LISTING)
    changed, removed, listing = state.directory_changes(spark, str(folder), empty)
    seen = spark.createDataFrame(listing.collect(), listing.schema)
    assert values(changed, "id") == [("a",)] and removed.count() == 0
    (folder / "b.json").write_text('{"id":"b","name":"n","type":"widget"}')
    (folder / "a.json").write_text('{"id":"a","name":"longer","type":"widget"}')
    gone = spark.createDataFrame([("/x/gone.json", None, 1, "gone"), ("/x/twin.json", None, 1, "a")], seen.schema)
    changed, removed, _ = state.directory_changes(spark, str(folder), seen.unionByName(gone))
    assert values(changed, "id", "name") == [("a", "longer"), ("b", "n")]
    assert values(removed, "id") == [("gone",)]


def test_addresses_are_checked_once_a_database(spark):
    dbs = spark.createDataFrame([("t", 1, "postgres", "postgres://h/d"), ("t", 2, "postgres", "postgres://h"), (None, 3, "other", None)], "tenant_id string, db_id bigint, driver string, dsn string")
    rows = [("t", d, f"t{i}", "c", v) for d, i, v in ((1, 1, None), (1, 2, ""), (1, 2, ""), (2, 1, ""))]
    scanned = spark.createDataFrame(rows, "tenant_id string, db_id bigint, table_name string, column_name string, validator string")
    existing = spark.createDataFrame([("t", 1, "t1", "c", "email"), ("t", 1, "t1", "c", None)], scanned.schema)
    done = merge.scan_all(dbs, scanned, existing, ["email"])
    assert values(done.summary, "db_id", "tables", "inserted", "updated", "skipped") == [(1, 2, 2, 1, 0)]
    assert values(done.fields, "table_name", "validator") == [("t1", "email"), ("t2", ""), ("t2", "")]
    assert done.errors.count() == 2
    # The checks do not move into the scans of the catalog and the registry.
    assert "dbname=" not in done.summary._jdf.queryExecution().optimizedPlan().toString()


def test_widget_files_keep_every_row(spark):
    from schemahelm.plans.scans import write_widget_files
    from schemahelm.sources import targets

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None), (None, "n")], "k bigint, id string").coalesce(1)
    path = write_widget_files(rows)
    held = {r["f"]: r["value"] for r in spark.read.text(path, wholetext=True).selectExpr("value", "_metadata.file_name AS f").collect()}
    line = lambda i: f'{{"id":"{i}","name":"n","type":"widget"}}\n'
    assert held == {"1.json": line("a"), "2.json": line("b") * 2, "3.json": '{"name":"n","type":"widget"}\n', "none.json": line("n")}
    widgets, errors = targets.load_widgets(spark, path)
    assert values(widgets, "id") == [("a",), ("n",)] and values(errors, "file") == [("2.json",), ("2.json",), ("3.json",)]


def test_files_are_read_by_tasks(spark, tmp_path):
    from schemahelm.streaming import state

    paths = [tmp_path / n for n in ("a.json", "b c%20.json", "none.json")]
    for path in paths:
        path.write_bytes(b"" if path.stem == "none" else b"x\ny \xc3\xa4\r\n\n")
    listed = spark.createDataFrame([(f"file:{paths[0]}",), (f"file://{paths[1]}",), (str(paths[0]),), (str(paths[2]),)], "file_path string")
    assert sorted(r["value"] for r in state.read_files(listed).collect()) == [""] * 3 + ["x"] * 3 + ["y \u00e4"] * 3


def test_apply_materialized_equals_lazy(spark):
    old = fields(spark, ("a", "x", "int"), ("a", "y", "int"))
    new = fields(spark, ("a", "x", "text"))
    lazy, stored = merge.apply(old, new), merge.apply(old, new, materialize=True)
    assert values(lazy.registry, "column_name", "data_type") == values(stored.registry, "column_name", "data_type") == [("x", "text")]


def test_watch_dir_polls_until_stopped(spark, tmp_path):
    import time

    from schemahelm.streaming import state

    folder = tmp_path / "w"
    folder.mkdir()
    (folder / "a.json").write_text('{"id":"a","name":"n","type":"widget"}')
    seen = []

    def on_change(changed, removed, batch_id):
        seen.append((batch_id, [r.id for r in changed.select("id").collect()], removed.count()))

    running = state.watch_dir(spark, str(folder), on_change, str(tmp_path / "s"), str(tmp_path / "cp"))
    deadline = time.time() + 60
    while len(seen) < 2 and time.time() < deadline and running.isActive:
        time.sleep(0.5)
    running.stop()
    assert seen[0][1:] == (["a"], 0) and seen[1][1:] == ([], 0)
