"""Path patterns as a trie of segments, matched level by level with equality joins.

A segment of a pattern is ``*`` (any rest: one or more segments), ``prefix:name`` (one segment that begins with the prefix and
goes on) or literal text, whatever characters it has: no text from the data ever becomes a regular expression.

Every leading part of a pattern is a node, named by its segments. A path walks down by naming the nodes that its next segment
could lead to: the literal child, the wildcard children (a node knows the lengths of their prefixes) and the rest; an
equality join with the nodes keeps those that exist. The number of joins is the depth of the patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemahelm.functions.typing import col_of
from schemahelm.session import cut_lineage

#: Levels between two cuts of the lineage.
_CUT = 8


def segments(path: Column | str) -> Column:
    return F.split(col_of(path), "/", -1)


def _step(segment: Column) -> Column:
    """Name of a pattern's segment: R, O and its prefix, or L and its text."""
    colon = F.instr(segment, ":")
    named = (colon > 0) & (colon < F.length(segment))
    prefix = F.left(segment, colon - 1)
    return F.when(segment == "*", F.lit("R")).when(named, F.concat(F.lit("O"), prefix)).otherwise(F.concat(F.lit("L"), segment))


def pattern_node(path: Column | str) -> Column:
    """The node where a pattern ends. Patterns that match the same paths for their form have the same node."""
    return F.array_join(F.transform(segments(path), _step), "/")


def _nodes(patterns: DataFrame) -> DataFrame:
    """Patterns (path) -> node, ends (a pattern ends here), goes_on, ones (lengths of the prefixes of wildcard children), rest."""
    steps = patterns.select(F.transform(segments("path"), _step).alias("s"))
    each = steps.select("s", F.explode(F.sequence(F.lit(0), F.size("s"))).alias("i"))
    child = F.get("s", F.col("i"))
    facts = each.select(
        F.array_join(F.when(F.col("i") > 0, F.slice("s", 1, F.col("i"))).otherwise(F.array()), "/").alias("node"),
        (F.col("i") == F.size("s")).alias("ends"),
        F.when(F.left(child, F.lit(1)) == "O", F.length(child) - 1).alias("one"),
        (F.coalesce(child, F.lit("")) == "R").alias("rest"),
    )
    return facts.groupBy("node").agg(
        F.bool_or("ends").alias("ends"), F.bool_or(~F.col("ends")).alias("goes_on"), F.collect_set("one").alias("ones"), F.bool_or("rest").alias("rest")
    )


def matches(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """Paths (path) and patterns (path) -> distinct (path, node): the nodes of all patterns that match a path.

    Null paths and patterns match nothing.
    """
    spark = paths.sparkSession
    # Written once: every level reads it, and where the files are small Spark broadcasts them, so that no level shuffles.
    nodes = cut_lineage(_nodes(patterns.select("path").where(F.col("path").isNotNull())), "path_nodes")
    root = F.max(F.when(F.col("node") == "", F.struct("ones", "rest")))
    depth, start = nodes.agg(F.max(F.when(F.col("node") != "", F.size(F.split("node", "/")))), root).first()
    if depth is None:
        return spark.createDataFrame([], "path string, node string")
    walk = paths.select("path").where(F.col("path").isNotNull()).distinct().withColumn("s", segments("path"))
    ones = F.array(*map(F.lit, start["ones"])).cast("array<int>")
    walk = walk.select("path", "s", F.lit("").alias("node"), F.lit(0).alias("pos"), ones.alias("ones"), F.lit(start["rest"]).alias("rest"), F.lit(False).alias("done"))
    in_rest = (F.col("node") == "R") | F.col("node").endswith("/R")
    for i in range(depth):
        lead = F.concat("node", F.lit("/")) if i else F.lit("")

        def children(p: Column) -> Column:
            segment = F.get("s", p)
            wild = F.transform(F.filter("ones", lambda n: n < F.length(segment)), lambda n: F.concat(lead, F.lit("O"), F.left(segment, n)))  # noqa: B023
            named = F.concat(F.array_compact(F.array(F.concat(lead, F.lit("L"), segment), F.when(F.col("rest"), F.concat(lead, F.lit("R"))))), wild)  # noqa: B023
            return F.transform(named, lambda x: F.struct(x.alias("node"), (p + 1).alias("pos")))

        # A rest may end at any later segment, so what follows it is looked for at all of them at once.
        at = F.when(in_rest, F.sequence("pos", F.size("s") - 1)).otherwise(F.array("pos"))
        next_ = F.when(F.col("done"), F.array(F.struct("node", "pos"))).otherwise(F.flatten(F.transform(at, children)))
        walk = walk.select("path", "s", "done", F.inline(next_)).join(nodes, "node")
        last = F.size("s") == F.col("pos")
        found = F.col("done") | (F.col("ends") & (last | in_rest))
        onward = ~F.col("done") & ~last & F.col("goes_on")
        states = F.array_compact(F.array(F.when(found, F.lit(True)), F.when(onward, F.lit(False))))
        walk = walk.select("path", "s", "node", "pos", "ones", "rest", F.explode(states).alias("done"))
        if (i + 1) % _CUT == 0 and i + 1 < depth:
            walk = cut_lineage(walk.distinct(), "walk")
    return walk.where("done").select("path", "node").distinct()
