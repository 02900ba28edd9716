"""Project trees and the contracts that projects see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable

#: Ancestors that readers follow at most.
MAX_DEPTH = 8
#: Visible contracts: holders of a contract that its rows carry, contracts of a tile that an id skips by a list, ids and
#: contracts of a tile, pairs a task, and tasks at most.
MOST_HOLDERS, MOST_GONE, TILE_IDS, TILE_CONTRACTS, TASK_PAIRS, MOST_TASKS = 64, 64, 4096, 2048, 16_000_000, 20_000


def leaves(projects: DataFrame) -> DataFrame:
    """Projects with a parent, and those that are nobody's parent within ``projects`` (filter first: the rule looks at
    the given rows only, so a container whose children are filtered out is a leaf)."""
    parents = projects.where("parent_id is not null").select(F.col("parent_id").alias("_p")).distinct()
    flagged = projects.join(parents, projects["id"] == F.col("_p"), "left")
    return flagged.where("parent_id is not null or _p is null").drop("_p")


def ancestors(projects: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """id, ancestor_id, level: every project itself (level 0) and up to ``depth`` ancestors.

    Ids and parents are written once and joined to themselves until a step finds nobody, so the data's own depth decides.
    A cycle in dirty data ends at the bound, and repeated pairs are merged to their least level.
    """
    edges = durable(projects.select(F.col("id").alias("_id"), F.col("parent_id").alias("_parent")), "parents")
    step = edges.select(F.col("_id").alias("id"), F.col("_id").alias("ancestor_id"), F.lit(0).cast("long").alias("level"))
    found = step
    for level in range(1, depth + 1):
        above = edges.where("_parent is not null")
        step = step.join(above, F.col("ancestor_id") == F.col("_id")).select("id", F.col("_parent").alias("ancestor_id"), F.lit(level).cast("long").alias("level"))
        if step.isEmpty():
            break
        found = found.union(step)
    return found.groupBy("id", "ancestor_id").agg(F.min("level").alias("level"))


def visible_contracts(projects: DataFrame, links: DataFrame, depth: int = MAX_DEPTH, of: DataFrame | None = None) -> DataFrame:
    """project_id, contract_id: own contracts and those of all ancestors, each once; for the ids in ``of`` (id) only, if given.

    The rows may be many times the input (all descendants of a container see all its contracts), so they are never shuffled:
    a pair comes from the nearest ancestor that holds the contract. Own contracts are given as they are. An ancestor's
    followers and contracts are dealt out in tiles, so no task makes all the pairs of one container. A tile's contracts are
    one array, which each follower spreads but for those that a nearer ancestor of it holds, told by a short list; where these
    are more than MOST_GONE in a tile, pairs are held one by one against their contracts' holders. Contracts of more than
    MOST_HOLDERS holders, and null ones, are made distinct by a shuffle.
    """
    up = ancestors(projects, depth)
    up = durable(up if of is None else up.join(of.select("id").distinct(), "id", "left_semi"), "ancestors")
    held = durable(links.select("project_id", "contract_id").distinct(), "links")
    holders = held.where("contract_id is not null").groupBy("contract_id").agg(F.count(F.lit(1)).alias("_n"))
    held = durable(held.join(holders, "contract_id", "left"), "holders")
    few = held.where(F.col("_n") <= MOST_HOLDERS).select(F.col("project_id").alias("ancestor_id"), "contract_id")
    own = few.join(up.where("level = 0").select("ancestor_id"), "ancestor_id").select(F.col("ancestor_id").alias("project_id"), "contract_id")

    followers = up.where("level > 0").groupBy("ancestor_id").agg(F.count(F.lit(1)).alias("ids"))
    sizes = followers.join(held.groupBy(F.col("project_id").alias("ancestor_id")).agg(F.count(F.lit(1)).alias("contracts")), "ancestor_id")
    tiles = durable(sizes.select("ancestor_id", F.ceil(F.col("ids") / TILE_IDS).alias("_groups"), F.ceil(F.col("contracts") / TILE_CONTRACTS).alias("_blocks"), (F.col("ids") * F.col("contracts")).alias("pairs")), "tiles")
    pairs = tiles.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("n")).first()["n"]
    tasks = min(MOST_TASKS, max(int(up.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs // TASK_PAIRS))
    place = lambda key, count: F.pmod(F.xxhash64(key), F.col(count))
    places = lambda count: F.sequence(F.lit(0).cast("long"), F.col(count) - 1)
    tile = ["ancestor_id", "_group", "_block"]

    shared = held.where(F.col("_n").between(2, MOST_HOLDERS)).groupBy("contract_id").agg(F.collect_set("project_id").alias("_holders"))
    contracts = few.join(tiles, "ancestor_id").withColumn("_block", place("contract_id", "_blocks")).drop("_blocks", "pairs")
    contracts = durable(contracts.join(shared, "contract_id", "left"), "contracts")
    common = contracts.where("_holders is not null").select("ancestor_id", "_block", "contract_id", F.explode("_holders").alias("_near")).where("_near <> ancestor_id")
    common = common.groupBy("ancestor_id", "_near", "_block").agg(F.collect_list("contract_id").alias("_same"), F.count(F.lit(1)).alias("_n"))
    nearer = F.collect_list("ancestor_id").over(Window.partitionBy("id").orderBy("level", "ancestor_id").rowsBetween(Window.unboundedPreceding, -1))
    ids = durable(up.select("id", "ancestor_id", "level", nearer.alias("_nearer")).where("level > 0").drop("level"), "nearer")
    # By block of an ancestor the contracts that a nearer one holds too; null where they are many.
    met = ids.select("id", "ancestor_id", F.explode("_nearer").alias("_near")).join(common, ["ancestor_id", "_near"])
    gone = F.when(F.sum("_n") <= MOST_GONE, F.flatten(F.collect_list(F.when(F.col("_n") <= MOST_GONE, F.col("_same")))))
    met = met.groupBy("id", "ancestor_id", "_block").agg(gone.alias("_gone")).groupBy("id", "ancestor_id").agg(F.collect_list(F.struct("_block", "_gone")).alias("_met"))
    ids = durable(ids.join(met, ["id", "ancestor_id"], "left").join(tiles, "ancestor_id").withColumn("_group", place("id", "_groups")), "followers")

    def spread(rows: DataFrame, contract: Column) -> DataFrame:
        """``rows`` of tiles with each contract of their tile."""
        blocks = contracts.groupBy("ancestor_id", "_groups", "_block").agg(F.collect_list(contract).alias("_contracts"))
        blocks = blocks.withColumn("_group", F.explode(places("_groups"))).select(*tile, "_contracts")
        return rows.repartition(tasks, *tile).join(blocks.repartition(tasks, *tile), tile).withColumn("_contract", F.explode("_contracts"))

    free = ids.select("id", *tile[:2], "_met", F.explode(places("_blocks")).alias("_block"))
    free = free.withColumn("_met", F.get(F.filter("_met", lambda m: m["_block"] == F.col("_block")), F.lit(0))).where("_met is null or _met._gone is not null")
    free = spread(free.select("id", *tile, "_met._gone"), F.col("contract_id")).where(F.col("_gone").isNull() | ~F.array_contains("_gone", F.col("_contract")))
    tested = ids.select("id", *tile[:2], "_nearer", F.explode("_met").alias("_met")).where("_met._gone is null").select("id", *tile[:2], "_met._block", "_nearer")
    tested = spread(tested, F.struct("contract_id", "_holders")).where(F.col("_contract._holders").isNull() | ~F.arrays_overlap("_nearer", "_contract._holders"))
    rest = held.where("_n is null").unionByName(held.where(F.col("_n") > MOST_HOLDERS)).select(F.col("project_id").alias("ancestor_id"), "contract_id")
    rest = up.join(rest, "ancestor_id").select(F.col("id").alias("project_id"), "contract_id").distinct()
    free = free.select(F.col("id").alias("project_id"), F.col("_contract").alias("contract_id"))
    return free.unionByName(tested.select(F.col("id").alias("project_id"), F.col("_contract.contract_id").alias("contract_id"))).unionByName(own).unionByName(rest)


def seen_sums(projects: DataFrame, links: DataFrame, amounts: DataFrame | None = None, depth: int = MAX_DEPTH) -> DataFrame:
    """id and, summed up over the contracts that a project sees, the columns of ``amounts`` (contract_id once, numbers);
    without amounts the number of those contracts as n.

    Ancestors' sums are added up, so the pairs are never made. A contract held several times along a path to the root counts
    once: each holder takes off what the next one above it holds too. This needs one parent an id; for ids with several, or
    below such ones, and for those only, the pairs are made after all.
    """
    columns = ["n"] if amounts is None else [c for c in amounts.columns if c != "contract_id"]
    held = links.where("contract_id is not null").select("project_id", "contract_id").distinct()
    held = durable(held.withColumn("n", F.lit(1).cast("long")) if amounts is None else held.join(amounts, "contract_id"), "held")
    every = up = durable(ancestors(projects, depth), "ancestors")
    summed = lambda rows, *keys: rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns])
    forked = up.where("level = 1").groupBy("id").count().where("count > 1").select(F.col("id").alias("ancestor_id"))
    forked, by_pairs = durable(up.join(forked, "ancestor_id", "left_semi").select("id").distinct(), "forked"), None
    if not forked.isEmpty():
        rows = visible_contracts(projects, links, depth, forked).join(held.drop("project_id").distinct(), "contract_id")
        by_pairs = summed(rows.withColumnRenamed("project_id", "id"), "id")
        up = up.join(forked, "id", "left_anti")
    plus = up.join(summed(held, "project_id").withColumnRenamed("project_id", "ancestor_id"), "ancestor_id").select("id", *columns)
    several = held.groupBy("contract_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("contract_id")
    shared = durable(held.join(several, "contract_id", "left_semi"), "shared")
    above = every.where("level > 0").select(F.col("id").alias("project_id"), F.col("ancestor_id").alias("_next"), F.col("level").alias("_gap"))
    met = shared.join(above, "project_id").join(shared.select(F.col("project_id").alias("_next"), "contract_id"), ["_next", "contract_id"], "left_semi")
    first = met.groupBy("project_id", "contract_id").agg(F.min(F.struct("_gap", "_next")).alias("_x"), *[F.first(c).alias(c) for c in columns])
    twice = summed(first.select(F.col("project_id").alias("ancestor_id"), "_x.*", *columns), "ancestor_id", "_next", "_gap")
    further = up.select("id", F.col("ancestor_id").alias("_next"), F.col("level").alias("_further"))
    minus = up.join(twice, "ancestor_id").join(further, ["id", "_next"]).where(F.col("_further") == F.col("level") + F.col("_gap"))
    sums = summed(plus.unionByName(minus.select("id", *[(-F.col(c)).alias(c) for c in columns])), "id")
    return sums if by_pairs is None else sums.unionByName(by_pairs)


def subtree_sizes(projects: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """id, n: how many rows a cascade from each project touches (itself and its descendants)."""
    return ancestors(projects, depth).groupBy(F.col("ancestor_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))


def on_cycle(projects: DataFrame) -> DataFrame:
    """Ids that reach themselves over any number of parents. An id has one parent at most; with several it is an error.

    Pointer doubling: every round doubles the hops and keeps the ids that something reaches, until all ids are reached.
    The hops then permute the ids, so each is on a cycle.
    """
    kept = lambda rows: durable(rows, "hops")
    pairs = kept(projects.where("parent_id is not null").select("id", F.col("parent_id").alias("at")).distinct())
    if pairs.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("an id has several parents")
    left = pairs.count()
    while True:
        reached = kept(pairs.join(pairs.select(F.col("at").alias("id")).distinct().hint("merge"), "id", "left_semi"))
        before, left = left, reached.count()
        if left == before:
            return reached.select("id")
        onward = reached.select(F.col("id").alias("_id"), F.col("at").alias("_at"))
        pairs = kept(reached.join(onward.hint("merge"), F.col("at") == F.col("_id")).select("id", F.col("_at").alias("at")))
        left = pairs.count()


def rolled_up(rows: DataFrame, amount: str = "amount") -> DataFrame:
    """id, amount of a forest (id, parent_id, amount): a leaf has its own, any other row the sum of all leaves below it and
    nothing of its own. An id on a cycle has no sum (null); what hangs below it has. Parents that are no row are none.

    Pointer doubling: after round k a row holds its leaves at a distance below 2 ** k, and points to its ancestor at that
    distance, to which it adds what it holds. So a tree of a thousand levels takes ten rounds, and a row's sums move once
    a round. An id has one row.
    """
    edges = durable(rows.select("id", "parent_id", F.col(amount).alias("own")), "forest")
    inner = edges.where("parent_id is not null").select(F.col("parent_id").alias("id")).distinct().select("id", F.lit(True).alias("inner"))
    held = F.when(F.col("inner"), F.lit(0)).otherwise(F.coalesce("own", F.lit(0))).cast("decimal(38,2)")
    start = edges.join(inner.hint("merge"), "id", "left").select("id", F.col("parent_id").alias("up"), held.alias("held"), F.lit(False).alias("cyclic"))
    state = _doubled(start, edges.count())
    if state is None:  # there are cycles; their ids pass nothing on
        known = edges.select(F.col("id").alias("parent_id"))
        cyclic = on_cycle(edges.join(known.hint("merge"), "parent_id", "left_semi").select("id", "parent_id")).select("id", F.lit(True).alias("found"))
        cut = start.join(durable(cyclic, "cyclic").hint("merge"), "id", "left")
        state = _doubled(cut.select("id", F.when(F.col("found").isNull(), F.col("up")).alias("up"), "held", F.coalesce("found", F.lit(False)).alias("cyclic")), edges.count())
    return state.select("id", F.when(~F.col("cyclic"), F.col("held")).alias(amount))


def _doubled(state: DataFrame, rows: int) -> DataFrame | None:
    """(id, up, held, cyclic) once no row points any further; None if some do after as many rounds as ``rows`` can need."""
    state = durable(state, "rolled")
    for _ in range(max(1, rows).bit_length() + 1):
        if not state.where("up is not null").limit(1).count():
            return state
        arriving = state.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("held").alias("more"))
        onward = state.select(F.col("id").alias("up"), F.col("up").alias("further"))
        moved = state.join(arriving.hint("merge"), "id", "left").join(onward.hint("merge"), "up", "left")
        state = durable(moved.select("id", F.col("further").alias("up"), (F.col("held") + F.coalesce("more", F.lit(0))).cast("decimal(38,2)").alias("held"), "cyclic"), "rolled")
    return None if state.where("up is not null").limit(1).count() else state


def primary_contract(links: DataFrame, contracts: DataFrame) -> DataFrame:
    """project_id, contract_id: the first MAIN contract by id, else the lowest id."""
    rows = links.join(contracts.select(F.col("id").alias("contract_id"), "contract_type"), "contract_id")
    rank = F.struct((F.col("contract_type") != "MAIN").alias("r"), F.col("contract_id"))
    return rows.groupBy("project_id").agg(F.min(rank)["contract_id"].alias("contract_id"))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that comes last in ``order`` (unique within a key)."""
    window = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in order])
    return rows.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")
