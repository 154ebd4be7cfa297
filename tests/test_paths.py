"""Path patterns and permission classes against plain versions."""

import itertools
import random

from pyspark.sql import functions as F

from schemahelm.operators import access, paths


def plain_match(path: str, pattern: str) -> bool:
    def walk(p, q):
        if not q:
            return not p
        if q[0] == "*":
            return any(walk(p[i:], q[1:]) for i in range(1, len(p) + 1))
        if not p:
            return False
        colon = q[0].find(":")
        if 0 <= colon < len(q[0]) - 1:
            return len(p[0]) > colon and p[0].startswith(q[0][:colon]) and walk(p[1:], q[1:])
        return p[0] == q[0] and walk(p[1:], q[1:])

    return walk(path.split("/"), pattern.split("/"))


def check(spark, all_paths, patterns):
    df = spark.createDataFrame([(p,) for p in all_paths], "path string")
    rules = spark.createDataFrame([(p,) for p in patterns], "path string")
    nodes = {}
    for r in rules.select("path", paths.pattern_node("path").alias("node")).collect():
        nodes.setdefault(r["node"], []).append(r["path"])
    got = {(r["path"], pattern) for r in paths.matches(df, rules).collect() for pattern in nodes[r["node"]]}
    want = {(p, q) for p in all_paths if p is not None for q in patterns if q is not None and plain_match(p, q)}
    assert got == want


def test_special_characters_stand_for_themselves(spark):
    patterns = ["/v1/(x", "/v1/a.b", "/v1/[z", "/v1/q+", "/v1/{id}", "/v1/a*", "/v1/:", "/v1/\\d", "/v1/$", "/v1/^x|y", None]
    check(spark, ["/v1/(x", "/v1/a.b", "/v1/aXb", "/v1/[z", "/v1/q+", "/v1/qq", "/v1/{id}", "/v1/a*", "/v1/aa", "/v1/:", "/v1/7", "/v1/\\d", "/v1/$", "/v1/^x|y", "/v1", None, ""], patterns)


def test_random_patterns(spark):
    rng = random.Random(1)
    parts, steps = ["a", "b", "ab", "v7", ""], ["a", "b", "ab", "*", ":x", "v:n", "a:y", "ab:z", ""]
    made = lambda words, most: "/" * rng.randrange(2) + "/".join(rng.choice(words) for _ in range(rng.randrange(1, most)))
    check(spark, sorted({made(parts, 6) for _ in range(300)}), sorted({made(steps, 5) for _ in range(150)}))


def test_deep_patterns_and_paths(spark):
    deep = "/".join(["s"] * 20)
    check(spark, [deep, deep + "/s", "x/" + deep + "/y", "x/y"], [deep, "x/*/y", "*", "s/:a/" + "/".join(["s"] * 18), ":r/*"])


def test_nothing_to_match(spark):
    none, one = spark.createDataFrame([], "path string"), spark.createDataFrame([("/a",)], "path string")
    assert paths.matches(none, one).count() == paths.matches(one, none).count() == 0


def test_classes_give_each_users_permissions(spark):
    rng = random.Random(2)
    held = [(u, r) for u in range(60) for r in range(6) if rng.random() < 0.4] + [(3, 1), (3, 1), (None, 2)]
    policies = [(r, f"/p{rng.randrange(9)}", rng.choice(["GET", "*"])) for r in range(6) for _ in range(4)]
    own = [(u, f"/p{rng.randrange(3)}", "GET") for u in range(0, 80, 3)]
    want = {(u, p, m) for u, r in held for r2, p, m in policies if r == r2 and u is not None} | set(own)
    held_df, policies_df = spark.createDataFrame(held, "user_id int, role_id int"), spark.createDataFrame(policies, "role_id int, path string, method string")
    members, grants = access.effective_permissions(held_df.where("user_id IS NOT NULL"), policies_df, spark.createDataFrame(own, "user_id int, path string, method string"))
    joined = members.join(grants, ["via", "class_id"]).select("user_id", "path", "method").distinct().collect()
    assert {tuple(r) for r in joined} == want
    sets = {}
    for u, r in held:
        sets.setdefault(u, set()).add(r)
    classes = {frozenset(s) for u, s in sets.items() if u is not None}
    assert members.where("via = 'roles'").select("class_id").distinct().count() == len(classes)
    counted = {(r["path"], r["method"]): r["users"] for r in access.users_of_permissions(members, grants).collect()}
    assert counted == {k: len(list(g)) for k, g in itertools.groupby(sorted((p, m) for _, p, m in want))}


def test_every_permission_of_every_user(spark):
    rng = random.Random(4)
    held = [(u, r) for u in range(40) for r in range(5) if rng.random() < 0.4] + [(3, 1), (3, 1)]
    policies = [(r, f"/p{rng.randrange(6)}", rng.choice(["GET", "*", None])) for r in range(5) for _ in range(4)] + [(9, "/only", "GET")]
    own = [(u, f"/p{rng.randrange(3)}", rng.choice(["GET", None])) for u in range(0, 60, 2)] + [(5, "/p1", "GET")] * 2
    frames = lambda *rows: [spark.createDataFrame(r, f"{c} string, method string" if "path" in c else c) for r, c in zip(rows, ("user_id int, role_id int", "role_id int, path", "user_id int, path"))]
    # The NULL user is alone in its class, then in one with others.
    for more in ([(None, 9), (None, 1)], [(None, 2), (77, 2)]):
        want = {(u, p, m) for u, r in held + more for r2, p, m in policies if r == r2} | set(own) | {(None, "/own", "GET")}
        got = access.user_permissions(*access.effective_permissions(*frames(held + more, policies, own + [(None, "/own", "GET")]))).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_tiles_give_every_permission_once(spark):
    rng = random.Random(5)
    held = [(u, r) for u in [None, *range(150)] for r in range(3) if rng.random() < 0.6]
    policies = [(r, rng.choice([None, "", f"/p{rng.randrange(40)}", f"/v1/{'x' * 30}/{rng.randrange(9)}"]), rng.choice(["GET", "*", None])) for r in [0, 1] for _ in range(40)]
    own = [(u, f"/p{rng.randrange(40)}", "GET") for u in [None, *range(0, 200, 7)]]
    want = {(u, p, m) for u, r in held for r2, p, m in policies if r == r2} | set(own)
    frames = [spark.createDataFrame(r, c) for r, c in ((held, "user_id int, role_id int"), (policies, "role_id int, path string, method string"), (own, "user_id int, path string, method string"))]
    # Many tiles, lists shorter than eight and runs that are left; then all in one.
    for sizes in ((5, 100, 8), (30, 60, 16), (2016, 1 << 17, 504)):
        got = access.user_permissions(*access.effective_permissions(*frames), *sizes).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_many_permissions_of_many_users_take_little_disk(spark, tmp_path):
    # More text of paths than one Parquet dictionary holds.
    held = spark.range(800).select(F.col("id").alias("user_id"), F.lit(1).alias("role_id"))
    policies = spark.range(5000).select(F.lit(1).alias("role_id"), F.repeat(F.concat(F.lit("/"), F.md5(F.col("id").cast("string"))), F.lit(8)).alias("path"), F.lit("GET").alias("method"))
    access.user_permissions(*access.effective_permissions(held, policies)).write.parquet(f"{tmp_path}/all")
    rows = spark.read.parquet(f"{tmp_path}/all")
    assert rows.count() == 800 * 5000 and rows.groupBy("path").agg(F.count_distinct("user_id").alias("n")).where("n = 800").count() == 5000
    # Less than half a byte a row, the texts of the paths included.
    size = sum(f.stat().st_size for f in (tmp_path / "all").glob("*.parquet"))
    assert size < 2_000_000, size


def test_requests_of_a_hot_path(spark):
    held = spark.range(500).select(F.col("id").alias("user_id"), (F.col("id") % 4).alias("role_id"))
    policies = spark.createDataFrame([(1, "/hot", "*"), (2, "/hot/:x", "GET"), (3, "/(", "GET")], "role_id long, path string, method string")
    asked = spark.range(1000).select(F.col("id").alias("request_id"), (F.col("id") % 600).alias("user_id"), F.lit("GET").alias("method"), F.lit("/hot").alias("path"))
    rows = access.enforce_log(asked, held, policies).collect()
    assert len(rows) == 1000 and all(r["allowed"] == (r["user_id"] < 500 and r["user_id"] % 4 == 1) for r in rows)
