"""Families of sessions: which session started which, and what a whole family used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S, variants as V
from ..session import store

# Fixed value: path of a session that no other session started.
ROOT_PATH = "/root"


def session_nodes(rows: DataFrame) -> DataFrame:
    """First session record of each file. ``rows``: path, line, v (VARIANT)."""
    spawn = "payload.source.subagent.thread_spawn"
    metas = rows.where(V.text_at("v", "type") == "session_meta").select(
        "path", "line",
        F.coalesce(V.trimmed_at("v", "payload.id"), V.trimmed_at("v", "payload.session_id")).alias("id"),
        V.trimmed_at("v", f"{spawn}.parent_thread_id").alias("parent"),
        F.greatest(F.coalesce(V.long_at("v", f"{spawn}.depth"), F.lit(0).cast("bigint")), F.lit(0).cast("bigint")).alias("depth"),
        F.coalesce(V.trimmed_at("v", f"{spawn}.agent_path"), F.lit(ROOT_PATH)).alias("agent_path"),
        V.trimmed_at("v", f"{spawn}.agent_nickname").alias("nickname"),
        V.trimmed_at("v", f"{spawn}.agent_role").alias("role"),
    )
    names = ("id", "parent", "depth", "agent_path", "nickname", "role")
    first = metas.groupBy("path").agg(F.min_by(F.struct(*names), "line").alias("n"))
    return first.select("path", "n.*").where("id IS NOT NULL")


def resolve_roots(nodes: DataFrame) -> DataFrame:
    """[id, root, hops, trail] for all nodes ``[id, parent, label]`` at once, by doubling.

    Every round joins each unfinished node with the node it points at, so a chain of length n
    takes log2(n) rounds, and finished nodes leave the left side. ``trail`` lists
    struct(label, id) from the root down. A node on or below a cycle meets an id twice, stops
    there and is returned with a NULL root. Each round is stored: plans stay short and
    survive lost executors. ``id`` must be unique.
    """
    columns = ("id", "next", "last", "hops", "trail")
    here = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("_here"))
    known = nodes.join(here, ["parent"], "left")
    up = F.when(F.col("_here"), F.col("parent"))
    state = store(
        known.select(
            "id", up.alias("next"), F.when(up.isNull(), F.col("id")).alias("last"),
            up.isNotNull().cast("bigint").alias("hops"), F.array(F.struct("label", "id")).alias("trail"),
        ),
        "roots",
    )
    done = state.where("next IS NULL")
    active = state.where("next IS NOT NULL")
    while not active.isEmpty():
        ahead = done.unionByName(active).select(*[F.col(c).alias(f"_{c}") for c in columns])
        stepped = active.join(ahead, F.col("next") == F.col("_id")).select(
            "id", F.col("_next").alias("next"), F.col("_last").alias("last"),
            (F.col("hops") + F.col("_hops")).alias("hops"), F.concat("_trail", "trail").alias("trail"),
        )
        loops = F.size(F.array_distinct(F.transform("trail", lambda x: x["id"]))) < F.size("trail")
        stepped = store(
            stepped.withColumn("_loops", loops).select(
                "id", F.when(~F.col("_loops"), F.col("next")).alias("next"),
                F.when(~F.col("_loops"), F.col("last")).alias("last"), "hops", "trail",
            ),
            "roots",
        )
        done = done.unionByName(stepped.where("next IS NULL"))
        active = stepped.where("next IS NOT NULL")
    return done.select("id", F.col("last").alias("root"), "hops", "trail")


def resolve_ends(nodes: DataFrame) -> DataFrame:
    """[id, root, hops, at] for all nodes ``[id, parent]``: like :func:`resolve_roots` without trails, so a
    round holds one row per node whatever the length of the chains.

    A node that has not ended after more hops than there are nodes is on or below a cycle; its root is NULL, and ``at`` is where it stands on it.
    """
    here = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("_here"))
    up = F.when(F.col("_here"), F.col("parent"))
    state = nodes.join(here, ["parent"], "left").select(
        "id", up.alias("next"), F.when(up.isNull(), F.col("id")).alias("root"), up.isNotNull().cast("bigint").alias("hops"))
    state, reach = store(state, "ends"), 1
    size = state.count()
    while reach <= size and not state.where("next IS NOT NULL").isEmpty():
        ahead = state.select(*[F.col(c).alias(f"_{c}") for c in state.columns])
        stepped = state.where("next IS NOT NULL").join(ahead, F.col("next") == F.col("_id")).select(
            "id", F.col("_next").alias("next"), F.col("_root").alias("root"), (F.col("hops") + F.col("_hops")).alias("hops"))
        state, reach = store(state.where("next IS NULL").unionByName(stepped), "ends"), 2 * reach
    return state.select("id", "root", "hops", F.col("next").alias("at"))


def session_forest(nodes: DataFrame) -> DataFrame:
    """Every session with its family's root, its depth below it and its depth-first place.

    ``place`` sorts a family depth-first with siblings in path order: a parent's key is a
    prefix of its children's keys.
    """
    label = F.struct(F.split("agent_path", "/").alias("parts"), F.col("path").alias("path"), F.col("id").alias("id"))
    names = [c for c in nodes.columns if c != "id"]
    once = nodes.groupBy("id").agg(F.min_by(F.struct(*names), label).alias("_n")).select("id", "_n.*")
    found = resolve_roots(once.select("id", "parent", label.alias("label")))
    return once.join(found, ["id"]).withColumnRenamed("trail", "place")


def session_tree(nodes: DataFrame, selected_path: str) -> DataFrame:
    """The family of the session in ``selected_path``: climb to the root, take all below it,
    depths counted from the shallowest. Cycles end where the climb meets itself."""
    picked = nodes.where(F.col("path") == selected_path).select("id").first()
    if picked is None:
        return nodes.limit(0).withColumn("position", F.lit(0).cast("bigint"))
    forest = store(session_forest(nodes), "forest")
    root = forest.where(F.col("id") == picked["id"]).select("root").first()["root"]
    if root is None:
        family = _cycle_family(nodes, picked["id"])
    else:
        family = forest.where(F.col("root") == root)
    lowest = family.agg(F.min("depth").alias("_low"))
    based = family.withColumn("_k", F.lit(1)).join(lowest.withColumn("_k", F.lit(1)), "_k", "left")
    return based.withColumn("depth", F.col("depth") - F.col("_low")).drop("_k", "_low").orderBy("place")


def _cycle_family(nodes: DataFrame, start: str) -> DataFrame:
    """Family of a session on or under a parent cycle: everything below the first session the climb reaches twice.

    Whoever never ends stands on a cycle after as many hops as there are nodes. With the cycles cut, the climb ends at its
    first session on one; with the family's root cut off, the family is a tree like any other. All by doubling.
    """
    edges = nodes.groupBy("id").agg(F.min_by("parent", F.struct("agent_path", "path")).alias("parent"))
    circling = resolve_ends(edges).where("root IS NULL").select(F.col("at").alias("id"), F.lit(True).alias("_on")).dropDuplicates()
    cut = edges.join(circling, ["id"], "left").select("id", F.when(F.col("_on").isNull(), F.col("parent")).alias("parent"))
    top = resolve_ends(cut).where(F.col("id") == start).select("root").first()["root"]
    loose = nodes.withColumn("_parent", F.col("parent")).withColumn("parent", F.when(F.col("id") != top, F.col("parent")))
    family = session_forest(loose).where(F.col("root") == top)
    return family.drop("parent").withColumnRenamed("_parent", "parent")


def family_cost(tree: DataFrame, priced: DataFrame) -> DataFrame:
    """Tokens and cost per session of a family and per family; no event means unknown, not 0."""
    total = S.total_tokens()
    unpriced = F.count_if(F.col("cost").isNull())
    sums = priced.groupBy(F.col("session").alias("id")).agg(
        S.saturating_sum(total).alias("tokens"), F.sum("cost").alias("_known"), unpriced.alias("_unpriced"),
    )
    per = tree.join(sums, ["id"], "left")
    cost: Column = F.when(F.col("_unpriced") == 0, F.col("_known"))
    return per.withColumn("cost", cost).drop("_known", "_unpriced")


def family_totals(costs: DataFrame) -> DataFrame:
    known = F.count("cost") == F.count(F.lit(1))
    return costs.groupBy("root").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("tokens").alias("tokens"),
        F.when(known, F.sum("cost")).alias("cost"),
    )
