"""Roles, permissions and lookups.

Policy paths are patterns; distinct resources meet them in a trie of segments (:mod:`schemahelm.operators.paths`).
Users who hold the same set of roles form a class, named by its smallest user. Permissions and requests are resolved
once for each class, and users meet their class at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemahelm.operators.paths import matches, pattern_node
from schemahelm.schemas import FIELD_KEY
from schemahelm.session import cut_lineage

# --- fixed values -----------------------------------------------------------------------------------------
# access that the admin role always has
ADMIN_POLICIES = [("/v1/*", "*"), ("/admin/*", "*")]
# capability -> path and method it needs
CAPABILITIES = [
    ("users:list", "/v1/rbac/users", "GET"),
    ("users:create", "/v1/rbac/users", "POST"),
    ("roles:list", "/v1/rbac/roles", "GET"),
    ("roles:members:read", "/v1/rbac/roles/{id}/members", "GET"),
    ("roles:members:write", "/v1/rbac/roles/{id}/members", "PUT"),
    ("rules:list", "/v1/authz/rules", "GET"),
    ("rules:write", "/v1/authz/rules", "POST"),
    ("audit:list", "/v1/audit-logs", "GET"),
    ("audit:diff", "/v1/audit-logs/{id}/diff", "GET"),
    ("metadata:tables", "/v1/metadata/tables", "GET"),
    ("custom_fields:list", "/v1/custom-fields", "GET"),
    ("custom_fields:create", "/v1/custom-fields", "POST"),
    ("custom_fields:update", "/v1/custom-fields", "PUT"),
    ("custom_fields:delete", "/v1/custom-fields", "DELETE"),
    ("plugins:list", "/v1/plugins", "GET"),
    ("plugins:write", "/v1/plugins", "POST"),
    ("widgets:list", "/v1/metadata/widgets", "GET"),
    ("widgets:write", "/v1/metadata/widgets/*", "PATCH"),
    ("snapshots:list", "/v1/snapshots", "GET"),
    ("snapshots:create", "/v1/snapshots", "POST"),
    ("snapshots:apply", "/v1/snapshots/{ver}/apply", "POST"),
    ("databases:list", "/v1/databases", "GET"),
    ("databases:create", "/v1/databases", "POST"),
    ("databases:update", "/v1/databases/{id}", "PUT"),
    ("databases:delete", "/v1/databases/{id}", "DELETE"),
    ("databases:scan", "/v1/databases/{id}/scan", "POST"),
    ("databases:capabilities", "/v1/databases/{id}/capabilities", "GET"),
    ("targets:list", "/admin/targets", "GET"),
    ("targets:create", "/admin/targets", "POST"),
    ("targets:update", "/admin/targets/{key}", "PUT"),
    ("targets:patch", "/admin/targets/{key}", "PATCH"),
    ("targets:delete", "/admin/targets/{key}", "DELETE"),
    ("targets:set-default", "/admin/targets/{key}/default", "POST"),
    ("targets:get-version", "/admin/targets/version", "GET"),
    ("targets:bump-version", "/admin/targets/version/bump", "POST"),
]
# --- end of fixed values ----------------------------------------------------------------------------------


def with_admin(policies: DataFrame, roles: DataFrame) -> DataFrame:
    """Policies plus the standing access of the role named ``admin``."""
    rows = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(m).alias("method")) for p, m in ADMIN_POLICIES])
    admin = roles.where(F.col("name") == "admin").select(F.col("id").alias("role_id"), F.explode(rows).alias("_p"))
    return policies.select("role_id", "path", "method").unionByName(admin.select("role_id", "_p.*"))


def policy_hits(resources: DataFrame, policies: DataFrame, subject: str = "role_id", keep: Sequence[str] = ()) -> DataFrame:
    """Distinct (path, method, subject): which subjects may use which resources."""
    pol = policies.select(subject, F.col("method").alias("_act"), pattern_node("path").alias("node")).distinct()
    res = resources.select("path", "method", *keep).distinct()
    hit = matches(res, policies).join(pol, "node").join(res, "path")
    return hit.where((F.col("_act") == "*") | (F.col("_act") == F.col("method"))).select("path", "method", *keep, subject).distinct()


def set_classes(members: DataFrame, items: Sequence[str], user: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """Interned sets: (user, item) rows -> (user, class_id) and (class_id, items), users with equal sets in one class.

    A class is named by its smallest user. Sets are compared by their size and two 64-bit fingerprints, so no set is gathered
    in one place; the sets themselves are the rows of the users that name a class.
    """
    rows = members.select(F.col(user).alias("user_id"), *items).distinct()
    prints = [F.bit_xor(F.xxhash64(*items, F.lit(seed))) for seed in (0, 1)]
    sets = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"), prints[0].alias("_a"), prints[1].alias("_b"))
    names = sets.groupBy("_n", "_a", "_b").agg(F.min("user_id").alias("class_id"))
    of = sets.join(names, ["_n", "_a", "_b"]).select(F.col("user_id").alias(user), "class_id")
    # A user may be NULL and the only one of a class.
    return of, rows.join(names.select("class_id"), F.col("user_id").eqNullSafe(F.col("class_id"))).select("class_id", *items)


def effective_permissions(user_roles: DataFrame, policies: DataFrame, direct: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What each user may do, as two tables: (user_id, via, class_id) and distinct (via, class_id, path, method).

    ``direct`` holds policies of users themselves: ``user_id, path, method``. A user belongs to a class of users with the same
    roles (via ``roles``) and to one of users with the same policies of their own (via ``direct``); their permissions are those of
    both classes. Paths stay patterns: :func:`policy_hits` tells which roles may use which resources, :func:`enforce_log`
    answers concrete requests.
    """
    of, roles = set_classes(user_roles, ["role_id"])
    grants = roles.join(policies.select("role_id", "path", "method").distinct(), "role_id").select("class_id", "path", "method").distinct()
    of, grants = (x.withColumn("via", F.lit("roles")) for x in (of, grants))
    if direct is not None:
        own_of, own = set_classes(direct, ["path", "method"])
        of, grants = (x.unionByName(y.withColumn("via", F.lit("direct"))) for x, y in ((of, own_of), (grants, own)))
    return of.select("user_id", "via", "class_id"), grants.select("via", "class_id", "path", "method")


def in_lists(rows: DataFrame, sizes: DataFrame, parts: str, items: Sequence[str]) -> DataFrame:
    """(class_id, rows): the rows of a class as sorted structs of ``items``, dealt into as many lists as ``parts`` of ``sizes`` says."""
    sizes = sizes.select(F.col("class_id").alias("_class"), F.col(parts).alias("_parts"))
    dealt = rows.join(sizes, F.col("class_id").eqNullSafe(F.col("_class"))).withColumn("_part", F.pmod(F.xxhash64(*items), F.col("_parts")))
    return dealt.groupBy("class_id", "_part").agg(F.sort_array(F.collect_list(F.struct(*items))).alias("rows")).select("class_id", "rows")


def user_permissions(members: DataFrame, permissions: DataFrame, users: int = 2016, path_bytes: int = 128 << 10, run: int = 504) -> DataFrame:
    """Distinct (user_id, path, method): every permission of every user, from the two tables of :func:`effective_permissions`.

    A permission that both classes of a user give is left out of the direct ones first, which are the fewer, so the product of
    members and permissions is streamed and never sorted or made distinct. The product is dealt in tiles, two to a task: about
    ``users`` members of a class times those of its permissions whose paths have about ``path_bytes``. In a tile each permission is
    said for the same ``run`` members in turn. So a file has few distinct values in long runs and short cycles, and Parquet's dictionaries
    and compression leave a fraction of a byte of a row.
    """
    members, permissions = cut_lineage(members, "members"), cut_lineage(permissions, "permissions")
    via = lambda rows, name: rows.where(F.col("via") == name)
    roles = via(members, "roles").select("user_id", F.col("class_id").alias("_of"), F.lit(True).alias("_has"))
    granted = via(permissions, "roles").select(F.col("class_id").alias("_class"), "path", "method")
    own = via(permissions, "direct").select(F.col("class_id").alias("_own"), "path", "method")
    mine = via(members, "direct").select(F.col("user_id").alias("_user"), "class_id").join(own, F.col("class_id").eqNullSafe(F.col("_own")))
    mine = mine.join(roles, F.col("_user").eqNullSafe(F.col("user_id")), "left").select(F.col("_user").alias("user_id"), "path", "method", "_of", "_has")
    twice = granted.toDF("_class", "_path", "_method")
    same = [F.col(x).eqNullSafe(F.col(y)) for x, y in (("_of", "_class"), ("path", "_path"), ("method", "_method"))]
    mine = mine.join(twice, F.col("_has") & same[0] & same[1] & same[2], "left_anti").select("user_id", "path", "method")
    held, given = via(members, "roles").select("class_id", "user_id"), via(permissions, "roles").select("class_id", "path", "method")
    octets = given.select("class_id", F.lit(0).alias("_m"), (F.coalesce(F.octet_length("path"), F.lit(0)) + 4).alias("_n"))
    sizes = held.select("class_id", F.lit(1).alias("_m"), F.lit(0).alias("_n")).unionAll(octets).groupBy("class_id")
    sizes = sizes.agg(F.ceil(F.sum("_m") / users).alias("users"), F.ceil(F.sum("_n") / path_bytes).alias("grants"))
    tiles = sizes.agg(F.sum(F.col("users") * F.col("grants"))).first()[0] or 1
    who = in_lists(held, sizes, "users", ["user_id"]).select(F.col("class_id").alias("_of"), F.col("rows.user_id").alias("_users"))
    what = in_lists(given, sizes, "grants", ["path", "method"]).withColumnRenamed("rows", "_grants")
    tile = who.join(what, F.col("_of").eqNullSafe(F.col("class_id"))).select("_users", "_grants").repartition(max(1, -(-tiles // 2)))
    # Runs are whole eights, as Parquet packs values by eights; the up to seven members that are left are a run of their own.
    left = F.size("_users") % 8
    eights = lambda i: F.least(F.lit(run), F.greatest(F.lit(0), F.size("_users") - left + 1 - i))
    runs = F.transform(F.sequence(F.lit(1), F.size("_users"), F.lit(run)), lambda i: F.slice("_users", i, eights(i)))
    runs = F.concat(runs, F.array(F.slice("_users", F.size("_users") - left + 1, left)))
    # Compiled, nested explodes hold the whole product of an input row in memory; a transform keeps the outer ones out of the last.
    apart = F.transform("_grants", lambda g: F.struct(g["path"].alias("path"), g["method"].alias("method")))
    each = tile.select(F.explode(runs).alias("_run"), "_grants").select("_run", F.inline(apart))
    return each.select(F.explode("_run").alias("user_id"), "path", "method").unionByName(mine)


def users_of_permissions(members: DataFrame, permissions: DataFrame) -> DataFrame:
    """How many users have each (path, method), from the two tables of :func:`effective_permissions`.

    Users are counted by the pair of their classes first; a permission that both classes of a pair give counts once.
    """
    of = lambda via: F.max(F.when(F.col("via") == via, F.col("class_id")))
    pairs = members.groupBy("user_id").agg(of("roles").alias("roles"), of("direct").alias("direct")).groupBy("roles", "direct").agg(F.count(F.lit(1)).alias("users"))
    classes = F.array(*(F.struct(F.lit(v).alias("via"), F.col(v).alias("class_id")) for v in ("roles", "direct")))
    each = pairs.select("roles", "direct", "users", F.inline(classes)).join(permissions, ["via", "class_id"])
    return each.select("roles", "direct", "users", "path", "method").distinct().groupBy("path", "method").agg(F.sum("users").alias("users"))


def allowed_requests(asked: DataFrame, user_roles: DataFrame, policies: DataFrame) -> DataFrame:
    """Those of the distinct (user_id, method, path) that a role of the user permits.

    Requests are reduced to (class, method, path); a class asks with each of its roles, so a path that everybody uses
    costs a row for each role of each class, whatever the number of users.
    """
    of, roles = set_classes(user_roles, ["role_id"])
    hits = policy_hits(asked, policies)
    asked = asked.select("user_id", "method", "path").distinct().join(of, "user_id")
    by_class = asked.select("class_id", "method", "path").distinct()
    granted = by_class.join(roles, "class_id").join(hits, ["path", "method", "role_id"], "left_semi").select("class_id", "method", "path").distinct()
    return asked.join(granted, ["class_id", "method", "path"], "left_semi").select("user_id", "method", "path")


def capabilities(users: DataFrame, user_roles: DataFrame, policies: DataFrame, matrix: Sequence[tuple[str, str, str]] = CAPABILITIES) -> DataFrame:
    """Per user, each capability of the matrix and whether it is allowed.

    A role's capabilities are bit masks, one long for every 63 of them, so the per-user fold is a ``bit_or`` of as
    many longs as the matrix needs.
    """
    spark = users.sparkSession
    words = range(-(-len(matrix) // 63))
    table = spark.createDataFrame([(i // 63, i % 63, p, m) for i, (_, p, m) in enumerate(matrix)], "word int, bit int, path string, method string")
    bits = policy_hits(table, policies, keep=["word", "bit"])
    flag = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))
    role_masks = bits.groupBy("role_id").agg(*[F.bit_or(F.when(F.col("word") == w, flag)).alias(f"_m{w}") for w in words])
    user_masks = user_roles.join(role_masks, "role_id").groupBy(F.col("user_id").alias("id")).agg(*[F.bit_or(f"_m{w}").alias(f"_m{w}") for w in words])
    entries = F.array(*[F.struct(F.lit(k).alias("capability"), F.lit(i // 63).alias("word"), F.lit(i % 63).alias("bit")) for i, (k, _, _) in enumerate(matrix)])
    masks = F.array(*[F.coalesce(f"_m{w}", F.lit(0).cast("bigint")) for w in words])
    rows = users.join(user_masks, "id", "left").select("id", masks.alias("_masks"), F.explode(entries).alias("_c"))
    allowed = F.call_function("shiftright", F.get("_masks", F.col("_c.word")), F.col("_c.bit")).bitwiseAND(F.lit(1)) == 1
    return rows.select(F.col("id").alias("user_id"), F.col("_c.capability").alias("capability"), allowed.alias("allowed"))


def enforce_log(requests: DataFrame, user_roles: DataFrame, policies: DataFrame) -> DataFrame:
    """Access log with ``allowed``: is the request permitted through any role of the user?

    Users are resolved by their classes; patterns see distinct resources only.
    """
    triple = ["user_id", "method", "path"]
    allowed = allowed_requests(requests, user_roles, policies).withColumn("allowed", F.lit(True))
    return requests.join(allowed, triple, "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def mask_secrets(databases: DataFrame, user_roles: DataFrame, policies: DataFrame, secrets: Sequence[str] = ("dsn",)) -> DataFrame:
    """Blank the connection columns of rows (viewer ``user_id``, database ``id``) unless the viewer may
    create databases, or update or delete this one."""
    base = "/v1/databases"
    probe = lambda path, method: F.struct(path.alias("path"), F.lit(method).alias("method"))
    own = F.concat(F.lit(base + "/"), F.col("id").cast("string"))
    probes = F.array(probe(F.lit(base), "POST"), probe(own, "PUT"), probe(own, "DELETE"))
    asked = databases.select("user_id", "id", F.explode(probes).alias("_p")).select("user_id", "id", "_p.*")
    granted = allowed_requests(asked, user_roles, policies)
    writable = asked.join(granted, ["user_id", "method", "path"], "left_semi").select("user_id", "id").distinct().withColumn("_write", F.lit(True))
    df = databases.join(writable, ["user_id", "id"], "left")
    for name in secrets:
        df = df.withColumn(name, F.when(F.col("_write"), F.col(name)).otherwise(F.lit("")))
    return df.drop("_write")


# --- roles and members ------------------------------------------------------------------------------------


def role_policies(roles: DataFrame, policies: DataFrame) -> DataFrame:
    named = roles.select(F.col("id").alias("role_id"), F.col("name").alias("role"))
    return named.join(policies, "role_id").select("role", "path", "method")


def roles_of(users: DataFrame, user_roles: DataFrame, roles: DataFrame, tenant: str | None = None, user: str | None = None) -> DataFrame:
    """User -> role names; ``user`` is a numeric id or a user name."""
    rows = users if tenant is None else users.where(F.col("tenant_id") == tenant)
    if user is not None:
        rows = rows.where(F.col("id") == int(user) if user.isdigit() else F.col("username") == user)
    named = roles.select(F.col("id").alias("role_id"), F.col("name").alias("role"))
    held = rows.select(F.col("id").alias("user_id"), "tenant_id", "username").join(user_roles, "user_id")
    return held.join(named, "role_id").select("tenant_id", "user_id", "username", "role")


def users_without_role(users: DataFrame, user_roles: DataFrame, role_id: int) -> DataFrame:
    holders = user_roles.where(F.col("role_id") == role_id).select(F.col("user_id").alias("id"))
    return users.join(holders, "id", "left_anti")


def role_members(users: DataFrame, user_roles: DataFrame, role_id: int, tenant: str) -> DataFrame:
    """Members of a role within a tenant, by user name."""
    held = user_roles.where(F.col("role_id") == role_id).select(F.col("user_id").alias("id"))
    return users.where(F.col("tenant_id") == tenant).join(held, "id").select("id", "username").orderBy("username")


def role_member_counts(users: DataFrame, user_roles: DataFrame, by: Sequence[str] = ("tenant_id", "role_id")) -> DataFrame:
    members = user_roles.join(users.select(F.col("id").alias("user_id"), "tenant_id"), "user_id")
    return members.groupBy(*by).agg(F.count(F.lit(1)).alias("members"))


def list_roles(roles: DataFrame, policies: DataFrame, users: DataFrame, user_roles: DataFrame, tenant: str) -> DataFrame:
    """Roles with their policies and member counts in a tenant.

    One row per (role, policy), a single row with NULLs for a role without any: the nested list of a role is
    the rows that share its id, so no role's policies have to fit one task.
    """
    counts = role_member_counts(users.where(F.col("tenant_id") == tenant), user_roles, ["role_id"])
    named = roles.select(F.col("id").alias("role_id"), F.col("name").alias("role"))
    return (
        named.join(policies.select("role_id", "path", "method"), "role_id", "left")
        .join(counts, "role_id", "left")
        .withColumn("members", F.coalesce("members", F.lit(0).cast("bigint")))
        .select("role_id", "role", "path", "method", "members")
    )


def deletable_roles(roles: DataFrame, policies: DataFrame, user_roles: DataFrame) -> DataFrame:
    """Roles without members and without policies."""
    held = lambda df: df.select(F.col("role_id").alias("id"))
    return roles.join(held(user_roles), "id", "left_anti").join(held(policies), "id", "left_anti")


def lookup_fields(facts: DataFrame, fields: DataFrame, keys: Sequence[str] = ("tenant_id", "table_name", "column_name"), keep: Sequence[str] = ("data_type",)) -> DataFrame:
    """Facts enriched from the registry by tenant, table and column; ``hit`` tells found from missing.

    Where several databases of a tenant define a key and ``keys`` leaves the database out, the definition of the
    lowest database counts.
    """
    keys = list(keys)
    rest = [c for c in (*FIELD_KEY, *keep) if c not in keys and c in fields.columns]
    found = fields.groupBy(*keys).agg(F.min(F.struct(*dict.fromkeys(rest))).alias("_f"))
    found = found.select(*keys, *[F.col(f"_f.{c}").alias(c) for c in keep], F.lit(True).alias("hit"))
    return facts.join(found, keys, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
