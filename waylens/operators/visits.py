"""Visit chains: referrers, navigation depth and redirect runs.

Links between visits are followed by pointer doubling: each round joins every visit to the ancestor it points at and
doubles the distance, so twelve rounds reach 4,096 hops and the number of joins doesn't grow with the chains' number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waylens.operators.ordering import ranked
from waylens.plans.scratch import cut

MAX_HOPS = 4096


def _by_id(visits: DataFrame, last: bool) -> DataFrame:
    """One row for each profile and visit id: its last occurrence, or its first."""
    pick = F.max_by if last else F.min_by
    return visits.where("visit_id IS NOT NULL").groupBy("profile", "visit_id").agg(pick(F.struct("seq", "url", F.coalesce("from_visit", F.lit(0)).alias("from_visit"), "is_redirect"), "seq").alias("v"))


def referrer_chains(visits: DataFrame) -> DataFrame:
    """Adds ``referrer_url`` and ``nav_depth``, the resolved hops back to a root (0 for roots and dangling links)."""
    parents = _by_id(visits, last=True).select("profile", "visit_id", "v.url", "v.from_visit")
    known = parents.select(F.col("profile").alias("p"), F.col("visit_id").alias("id"))
    links = parents.join(known, (F.col("profile") == F.col("p")) & (F.col("from_visit") == F.col("id")), "left")
    up = F.when(F.col("id").isNotNull() & (F.col("from_visit") != 0), F.col("from_visit")).otherwise(0)
    steps = cut(links.select("profile", F.col("visit_id").alias("id"), up.alias("up")), "links")
    walked, looped = _hops(steps)
    if not looped.isEmpty():
        walked = walked.unionByName(_looped_hops(steps, looped))
    hops = walked.select(F.col("profile").alias("p"), F.col("id").alias("at"), F.least(F.col("hops"), F.lit(MAX_HOPS - 1)).alias("hops"))
    urls = parents.select(F.col("profile").alias("p"), F.col("visit_id").alias("at"), F.col("url").alias("referrer_url")).join(hops, ["p", "at"])
    start = F.when(F.col("from_visit") != 0, F.col("from_visit"))
    out = visits.withColumn("__from", start).join(urls, (F.col("profile") == F.col("p")) & (F.col("__from") == F.col("at")), "left")
    return out.withColumn("nav_depth", F.coalesce(F.col("hops") + 1, F.lit(0))).drop("__from", "p", "at", "hops")


def referrers(visits: DataFrame) -> DataFrame:
    """Adds ``referrer_url`` as ``referrer_chains`` does; without depths no chain has to be followed."""
    parents = _by_id(visits, last=True).select(F.col("profile").alias("p"), F.col("visit_id").alias("at"), F.col("v.url").alias("referrer_url"))
    start = F.when(F.col("from_visit") != 0, F.col("from_visit"))
    return visits.withColumn("__from", start).join(parents, (F.col("profile") == F.col("p")) & (F.col("__from") == F.col("at")), "left").drop("__from", "p", "at")


def _hops(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hops from each ``profile, id`` to a root, over the links ``up`` (0 at roots), and the rows that run into a cycle.

    Rows that have reached a root aren't joined or written again; the others point twice as far in each round.
    """
    done = [steps.where("up = 0").select("profile", "id", F.lit(0).cast("long").alias("hops"))]
    open_rows = steps.where("up <> 0").withColumn("hops", F.lit(1).cast("long"))
    for _ in range(MAX_HOPS.bit_length()):
        if open_rows.isEmpty():
            break
        ended = done[0]
        for d in done[1:]:
            ended = ended.unionByName(d)
        ahead = ended.select("profile", "id", F.lit(0).cast("long").alias("up"), "hops").unionByName(open_rows.select("profile", "id", "up", "hops"))
        ahead = ahead.select(F.col("profile").alias("p"), F.col("id").alias("at"), F.col("up").alias("next"), F.col("hops").alias("more"))
        joined = open_rows.join(ahead, (F.col("profile") == F.col("p")) & (F.col("up") == F.col("at")), "left")
        moved = cut(joined.select("profile", "id", F.coalesce("next", F.lit(0)).alias("up"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")), "hops")
        done.append(moved.where("up = 0").select("profile", "id", "hops"))
        open_rows = moved.where("up <> 0")
    ended = done[0]
    for d in done[1:]:
        ended = ended.unionByName(d)
    return ended, open_rows.select("profile", "id", "up")


def _looped_hops(steps: DataFrame, looped: DataFrame) -> DataFrame:
    """Hops of visits whose links run into a cycle: the distinct visits on their way, less the first.

    After many doublings a row points into its cycle, and the visits of a cycle point at all of it, so what is pointed at
    are the cycles.
    Each cycle's smallest id, spread by doubling, names it, and its size is a count; the way to the cycle is the hops to
    its visits as roots.
    """
    links = cut(looped.select("profile", "id").join(steps, ["profile", "id"]), "loops")
    far = looped.select("profile", "id", F.col("up").alias("far"))
    places = cut(looped.select("profile", F.col("up").alias("id")).distinct(), "ring")
    while True:  # once more where ways to a cycle are longer than the doublings reached
        further = cut(places.join(far, ["profile", "id"]).select("profile", F.col("far").alias("id")).distinct(), "ring")
        if further.count() == places.count():
            break
        places = further
    ring = links.join(places, ["profile", "id"])
    named = ring.select("profile", "id", F.col("up").alias("far"), F.least("id", "up").alias("name"))
    for _ in range(63):
        ahead = named.select(F.col("profile").alias("p"), F.col("id").alias("at"), F.col("far").alias("next"), F.col("name").alias("other"))
        new = cut(named.join(ahead, (F.col("profile") == F.col("p")) & (F.col("far") == F.col("at"))).select("profile", "id", F.col("next").alias("far"), F.least("name", "other").alias("name"), (F.col("other") < F.col("name")).alias("changed")), "cycle-names")
        named = new.drop("changed")
        if new.where("changed").isEmpty():
            break
    sizes = named.groupBy("profile", "name").agg(F.count("*").alias("size"))
    cycles = cut(named.join(sizes, ["profile", "name"]).select("profile", "id", "size"), "cycles")
    rooted = links.join(cycles, ["profile", "id"], "left").select("profile", "id", F.when(F.col("size").isNull(), F.col("up")).otherwise(F.lit(0)).alias("up"))
    rooted = cut(rooted, "rooted")
    entry = _entries(rooted)
    sized = entry.join(cycles.select("profile", F.col("id").alias("entry"), "size"), ["profile", "entry"])
    return sized.select("profile", "id", F.when(F.col("hops") == 0, F.col("size") - 1).otherwise(F.col("hops") - 1 + F.col("size")).alias("hops"))


def _entries(rooted: DataFrame) -> DataFrame:
    """``profile, id, entry, hops``: the root that each row of a forest leads to, and how far it is."""
    walk = rooted.select("profile", "id", F.when(F.col("up") == 0, F.col("id")).otherwise(F.col("up")).alias("entry"), (F.col("up") != 0).cast("long").alias("hops"))
    for _ in range(63):
        ahead = walk.select(F.col("profile").alias("p"), F.col("id").alias("at"), F.col("entry").alias("next"), F.col("hops").alias("more"))
        joined = walk.join(ahead, (F.col("profile") == F.col("p")) & (F.col("entry") == F.col("at")))
        new = cut(joined.select("profile", "id", F.col("next").alias("entry"), (F.col("hops") + F.col("more")).alias("hops"), (F.col("more") > 0).alias("moved")), "entries")
        walk = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    return walk


def redirect_chains(visits: DataFrame) -> DataFrame:
    """A row for each hop: ``profile, chain_id, position, visit_id, url, kind, role``.

    A chain starts at a redirect whose parent isn't one, follows the first redirect child (by ``seq``) of each hop, and has
    the parent in front if it is known. Chains are numbered in the order of their heads, over all profiles. A visit id
    that several artifacts report is several events: each may head a chain, and each leads to the id's first child.
    """
    index = _by_id(visits, last=False).select(F.col("profile").alias("p"), F.col("visit_id").alias("parent"), F.col("v.is_redirect").alias("parent_redirects"), F.col("v.url").alias("parent_url"))
    redirects = visits.where("is_redirect").select("seq", "profile", "visit_id", "from_visit", "url", "redirect_kind")
    known = cut(redirects.join(index, (F.col("profile") == F.col("p")) & (F.col("from_visit") == F.col("parent")), "left"), "redirects")
    follows = F.coalesce("parent_redirects", F.lit(False))
    heads = known.where(~follows)
    ids = redirects.select(F.col("profile").alias("rp"), F.col("visit_id").alias("rid")).distinct()
    followers = known.join(ids, (F.col("profile") == F.col("rp")) & (F.col("from_visit") == F.col("rid")), "left_semi")
    firsts = followers.groupBy("profile", "from_visit").agg(F.min_by(F.struct("seq", "visit_id"), "seq").alias("c")).select("profile", "from_visit", "c.*")
    tails = firsts.where("from_visit <> visit_id")
    # the way from each hop back to its head, doubled in each round
    none = F.lit(None).cast("long")
    walk = heads.select("profile", "seq", "visit_id", F.lit(0).cast("long").alias("up"), F.lit(0).cast("long").alias("hops"), F.col("seq").alias("head"))
    walk = cut(walk.union(tails.select("profile", "seq", "visit_id", "from_visit", F.lit(1).cast("long"), none)), "runs")
    for _ in range(MAX_HOPS.bit_length()):
        if walk.where("up <> 0").isEmpty():
            break
        ahead = walk.select(F.col("profile").alias("p"), F.col("visit_id").alias("at"), F.col("up").alias("next"), F.col("hops").alias("more"), F.col("head").alias("new"))
        moving = walk.where("up <> 0").join(ahead, (F.col("profile") == F.col("p")) & (F.col("up") == F.col("at")))
        moved = moving.select("profile", "seq", "visit_id", F.col("next").alias("up"), (F.col("hops") + F.col("more")).alias("hops"), F.col("new").alias("head"))
        walk = cut(walk.where("up = 0").unionByName(moved), "runs")
    runs = walk.where("up = 0").join(known.select("seq", "url", F.col("redirect_kind").alias("kind")), "seq")
    origin = heads.where("parent IS NOT NULL").select("profile", F.col("seq").alias("head"), "parent", "parent_url")
    placed = runs.join(origin.select("head", F.lit(1).alias("shift")), "head", "left").select("profile", "head", (F.col("hops") + F.coalesce("shift", F.lit(0))).alias("position"), "visit_id", "url", "kind")
    hops = placed.unionByName(origin.select("profile", "head", F.lit(0).cast("long").alias("position"), F.col("parent").alias("visit_id"), F.col("parent_url").alias("url"), F.lit(None).cast("string").alias("kind")))
    total = F.count("*").over(Window.partitionBy("head"))
    role = F.when(F.col("position") == total - 1, "landing").when(F.col("position") == 0, "start").otherwise("hop")
    numbers = ranked(heads.select(F.col("seq").alias("head")), "head").select("head", F.col("rank").alias("chain_id"))
    return hops.withColumn("role", role).join(numbers, "head").select("profile", "chain_id", "position", "visit_id", "url", "kind", "role")


def redirect_tags(visits: DataFrame) -> DataFrame:
    """``redirect_chain_id`` and ``redirect_role`` of each visit in a chain; of several chains the last one counts."""
    chains = redirect_chains(visits).groupBy("profile", "visit_id").agg(F.max(F.struct("chain_id", "role")).alias("t"))
    return visits.join(chains, ["profile", "visit_id"], "left").withColumn("redirect_chain_id", F.col("t.chain_id")).withColumn("redirect_role", F.col("t.role")).drop("t")
