"""Links and components over candidate buckets, all in DataFrames: no pairs of a whole bucket, no group in one task, nothing on the driver but counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, holds, may_hold, small_side

#: A bucket is searched pair by pair if its pairs of different components are at most so many times its members; beyond that by a prefix filter. Both miss none.
PAIRS_A_MEMBER = 4
#: Members of a bucket that link_sketched searches pair by pair at once.
SMALL = 4
#: Keys that a task of shared_keys counts, few enough for the processor's cache; as long as PARTS tasks will do, for more the shuffle costs more than it saves. Beyond that MANY_KEYS a task.
CACHED_KEYS, PARTS, MANY_KEYS = 180_000, 200, 2_000_000
#: Most sketches that `remaining` broadcasts.
LATE_SKETCHES = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for each id in edges (a, b); comp is the smallest id reachable. Alternates large and small stars until each id has one edge, to its component's smallest."""
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    while True:
        sides = e.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("low")).union(e.select("b", F.lit(0), F.lit(1)))
        if not holds(sides.groupBy("id").agg(F.sum("up").alias("up"), F.max("low").alias("low")).filter("up > 1 OR up = 1 AND low = 1")):
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").union(least.select("a", F.col("m").alias("b"))).distinct()
        last, e = e, cut(small, "edges")
        drop(last)
    out = cut(e.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(e.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct()), "components")
    drop(e)
    return out


def shared_keys(entries: DataFrame, count: int | None = None) -> DataFrame:
    """entries (key, id and more), each pair of key and id once, with n, the times that the key occurs; those whose key occurs once are left out.

    Without count, keys are counted by partial aggregation, so a hot key is a row a task. With count, about the number of entries, nearly all of different keys, their keys are dealt
    first, for a partial aggregation would combine next to nothing in large hash tables; a hot key's rows, of 8 bytes each, then meet in one task.
    Before entries are shuffled to the shared keys, most of those whose key is alone are dropped.
    """
    alone = entries.select("key")
    if count is not None:
        alone = alone.repartition(max(min(count // CACHED_KEYS + 1, PARTS), count // MANY_KEYS), "key")
    keys = cut(alone.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared-keys")
    out = cut(may_hold(entries, "key", keys, "key").join(keys, "key"), "buckets")
    drop(keys)
    return out


def link_components(
    buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], tokens: Callable[[DataFrame], DataFrame], percent: int, alike: Callable[[str, str], Column] | None = None, pairs_a_member: int = PAIRS_A_MEMBER
) -> DataFrame:
    """(id, comp) of the links among ids that share a bucket; ids without a link may be missing. Reads buckets (key, id, n: members of the key) and drops it.

    verify: the pairs (a, b) whose sets have a Jaccard similarity of percent or more. tokens: (id, size, token) of ids (id), each set's elements once.
    alike: whether two sketches (columns) may belong to such a pair; buckets then have a column sketch, a long, and other pairs aren't made.

    First every member of a bucket is compared with the bucket's centre, its member that meets most others over all buckets. In a group of near copies that is a copy
    with few changes, the same one in most buckets, so nearly all links are found by a few comparisons a member. What is left are members of different components
    that still share a bucket and weren't compared. Buckets in which these are few are searched pair by pair, which is linear in their members; the members of the others
    are searched by `remaining`, which misses no link among them. So links are exact over all pairs that share a bucket.
    """
    if alike is None:
        buckets, alike = buckets.withColumn("sketch", F.lit(0).cast("long")), lambda a, b: F.lit(True)
    central = buckets.groupBy("id").agg(F.sum(F.col("n") - 1).alias("meets"))
    ranked = cut(buckets.select("key", "id", "sketch").join(central, "id"), "ranked")
    if hasattr(buckets, "_cut_path"):
        drop(buckets)
    centres = cut(ranked.groupBy("key").agg(F.max(F.struct("meets", "id", "sketch")).alias("c")).select("key", F.col("c.id").alias("centre"), F.col("c.sketch").alias("of_centre")), "centres")
    others = cut(ranked.select("key", "id", "sketch").join(centres, "key").filter("id != centre"), "others")
    drop(ranked, centres)
    pairs = cut(others.filter(alike("sketch", "of_centre")).select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct(), "pairs")
    comp = components(verify(pairs))
    named = cut(others.select("key", "id", "sketch").join(comp, "id", "left").select("key", "id", "sketch", F.coalesce("comp", "id").alias("comp")), "named")
    drop(others, pairs)
    sizes = named.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("members"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.count("*").alias("k"))
    open_keys = cut(sizes.filter("k > 1").select("key", F.expr(f"members * members - squares <= {2 * pairs_a_member} * members").alias("few")), "open-keys")
    held = cut(named.join(open_keys, "key"), "open-buckets")
    drop(named, open_keys)
    if not holds(held):
        drop(held)
        return comp
    few = held.filter("few")
    near = few.alias("x").join(few.alias("y"), F.expr("x.key = y.key AND x.id < y.id AND x.comp != y.comp") & alike("x.sketch", "y.sketch")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    rest = cut(held.filter("NOT few").select("id", "comp", "sketch").distinct(), "rest")
    if holds(rest):
        near = near.union(remaining(rest, tokens, percent, alike))
    comp = with_links(comp, verify(near))
    drop(held, rest)
    return comp


def with_links(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, comp) joined by further links (a, b). Drops comp if there are any, and links if cut."""
    more = links if hasattr(links, "_cut_path") else cut(links, "more-links")
    if holds(more):
        own = lambda c: comp.select(F.col("id").alias(c), F.col("comp").alias(f"c{c}"))
        between = more.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        # each id's edge to the smallest of its component stands for the links found before
        joined = components(between)
        every = comp.union(between.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(comp.select("id"), "id", "left_anti").select("id", F.col("id").alias("comp")))
        over = joined.select(F.col("id").alias("comp"), F.col("comp").alias("upper"))
        out = cut(every.join(over, "comp", "left").select("id", F.coalesce("upper", "comp").alias("comp")), "components")
        drop(comp, joined)
        comp = out
    drop(more)
    return comp


def link_sketched(
    buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], tokens: Callable[[DataFrame], DataFrame], percent: int, alike: Callable[[str, str], Column], pairs_a_member: int = PAIRS_A_MEMBER, small: int = SMALL,
    prepare: Callable[[DataFrame], None] | None = None, finer: Callable[[DataFrame], DataFrame] | None = None, nearer: Callable[[str, str], Column] | None = None,
) -> DataFrame:
    """As link_components, over buckets (key, id, sketch, n) whose sketches tell most pairs apart: pairs that aren't alike aren't made. Reads buckets and drops it.

    Buckets of `small` members or fewer, which are nearly all and meet mostly by chance, are searched pair by pair. Of the others each member is compared with one centre, that of
    its largest bucket, so nothing but the keys of open buckets is joined to their entries: an id is a row that holds its keys. What is then open is searched as there.

    prepare: called once, before any verify, with ids (some repeated) among which are all that verify, tokens and finer will be asked for.
    finer, nearer: (id, sketch) of ids (id), and alike for these sketches. They replace the first ones in the last search, for members that the first ones leave there.
    """
    few_members = buckets.filter(F.col("n") <= small).select("key", "id", "sketch")
    chance = pairs_in(few_members, F.expr("x.key = y.key AND x.id < y.id"), alike)
    ranked = cut(buckets.filter(F.col("n") > small).groupBy("id").agg(F.sum(F.col("n") - 1).alias("meets"), F.first("sketch").alias("sketch"), F.max(F.struct("n", "key"))["key"].alias("most"), F.collect_list("key").alias("keys")), "ranked")
    entries = ranked.select("id", "sketch", "meets", F.explode("keys").alias("key"))
    centres = cut(entries.groupBy("key").agg(F.max(F.struct("meets", "id", "sketch")).alias("c")).select("key", F.col("c.id").alias("centre"), F.col("c.sketch").alias("of_centre")), "centres")
    near = ranked.select(F.col("most").alias("key"), "id", "sketch").join(centres, "key").filter("id != centre").filter(alike("sketch", "of_centre")).select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"))
    pairs = cut(chance.union(near).distinct(), "pairs")
    drop(buckets, centres)
    if prepare is not None:
        prepare(pairs.select(F.explode(F.array("a", "b")).alias("id")).union(ranked.select("id")))
    found = verify(pairs)
    comp = components(found)
    if hasattr(found, "_cut_path"):
        drop(found)
    held = open_entries(ranked, comp, pairs_a_member)
    if holds(held):
        # in each open bucket the first of every component meets that of the one with most members
        firsts = cut(held.groupBy("key", "comp").agg(F.count("*").alias("c"), F.max(F.struct("meets", "id", "sketch")).alias("first")), "firsts")
        main = firsts.groupBy("key").agg(F.max(F.struct("c", "comp", "first")).alias("m")).select("key", F.col("m.comp").alias("of"), F.col("m.first.id").alias("centre"), F.col("m.first.sketch").alias("of_centre"))
        met = firsts.select("key", "comp", "first.id", "first.sketch").join(main, "key").filter("comp != of").filter(alike("sketch", "of_centre"))
        met = met.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
        comp = with_links(comp, verify(met))
        drop(firsts, held)
        held = open_entries(ranked, comp, pairs_a_member)
    if finer is not None and holds(held):
        # members that are alike none of their buckets need no finer sketch and have no pair
        few, every = held.filter("few"), held
        met = few.alias("x").join(few.alias("y"), F.expr("x.key = y.key AND x.comp != y.comp") & alike("x.sketch", "y.sketch"), "left_semi").select("id")
        ids = cut(met.union(held.filter("NOT few").select("id")).distinct(), "open-ids")
        fine = cut(finer(ids), "fine")
        held = cut(every.drop("sketch").join(small_side(fine), "id").select(*every.columns), "open-buckets")
        alike = nearer
        drop(ids, fine, every)
    if holds(held):
        more = pairs_in(held.filter("few"), F.expr("x.key = y.key AND x.id < y.id AND x.comp != y.comp"), alike).distinct()
        rest = cut(held.filter("NOT few").select("id", "comp", "sketch").distinct(), "rest")
        if holds(rest):
            more = more.union(remaining(rest, tokens, percent, alike))
        comp = with_links(comp, verify(more.join(pairs, ["a", "b"], "left_anti").distinct()))
        drop(rest)
    drop(ranked)
    drop(held, pairs)
    return comp


def open_entries(ranked: DataFrame, comp: DataFrame, pairs_a_member: int) -> DataFrame:
    """(key, id, sketch, meets, comp, few) of the buckets that hold several components; few: whether the pairs between these are few."""
    named = cut(ranked.select("id", "sketch", "meets", "keys").join(comp, "id", "left").select("id", "sketch", "meets", F.coalesce("comp", "id").alias("comp"), "keys"), "named")
    entries = named.select("id", "sketch", "meets", "comp", F.explode("keys").alias("key"))
    sizes = entries.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("members"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.count("*").alias("k"))
    open_keys = cut(sizes.filter("k > 1").select("key", F.expr(f"members * members - squares <= {2 * pairs_a_member} * members").alias("few")), "open-keys")
    held = cut(may_hold(entries, "key", open_keys, "key").join(open_keys, "key"), "open-buckets")
    drop(named, open_keys)
    return held


def pairs_in(entries: DataFrame, where: Column, alike: Callable[[str, str], Column]) -> DataFrame:
    return entries.alias("x").join(entries.alias("y"), where & alike("x.sketch", "y.sketch")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def remaining(rest: DataFrame, tokens: Callable[[DataFrame], DataFrame], percent: int, alike: Callable[[str, str], Column]) -> DataFrame:
    """Pairs (a, b) of ids of different components in rest (id, comp, sketch) whose sketches are alike, among them all whose sets have a Jaccard similarity of percent or more. rest is cut.

    A prefix filter: tokens are ordered by how many of these sets hold them, the rarest first. Two similar sets have a token in common among the first
    size - percent * size + 1 of each, and at their first common token enough tokens must follow on both sides. A set whose rarest tokens are its own is
    dropped without meeting any other. Sides of one component never meet: of each token's list, only what lies outside its most frequent component is matched with it.
    """
    each = cut(tokens(rest.select("id")).select("id", "size", "token"), "tokens")
    often = each.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    held = each.join(often, "token").groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("held"))
    alone = F.col("size") - F.size("held")
    keep = F.col("size") - F.expr(f"({percent} * size + 99) div 100") + 1 - alone
    first = held.select("id", "size", alone.alias("alone"), F.slice("held", F.lit(1), F.greatest(keep, F.lit(0)).cast("int")).alias("first"))
    # sketches that can be broadcast are joined to the pairs that meet, so no list carries them
    sketches = F.broadcast(rest.select("id", "sketch")) if rest.count() <= LATE_SKETCHES else None
    own = ["id", "comp"] if sketches is not None else ["id", "comp", "sketch"]
    first = first.join(small_side(rest).select(*own), "id")
    prefix = cut(first.select(*own, "size", "alone", F.posexplode("first").alias("at", "t")).select(*own, "size", (F.col("alone") + F.col("at")).alias("at"), F.col("t.token").alias("token")), "prefixes")
    by = prefix.groupBy("token", "comp").agg(F.count("*").alias("n"))
    lists = by.groupBy("token").agg(F.count("*").alias("k"), F.max(F.struct("n", "comp"))["comp"].alias("main")).filter("k > 1").select("token", "main")
    met = cut(prefix.join(lists, "token"), "lists")
    left, right = met.filter("comp != main").alias("x"), met.alias("y")
    fits = f"100 * least(x.size, y.size) >= {percent} * greatest(x.size, y.size)"
    enough = f"{100 + percent} * least(x.size - x.at, y.size - y.at) >= {percent} * (x.size + y.size)"
    where = F.expr(f"x.token = y.token AND x.comp != y.comp AND (y.comp = x.main OR x.id < y.id) AND {fits} AND {enough}")
    found = left.join(right, where if sketches is not None else where & alike("x.sketch", "y.sketch")).select(F.col("x.id").alias("xi"), F.col("y.id").alias("yi"))
    if sketches is not None:
        side = lambda c: sketches.select(F.col("id").alias(f"{c}i"), F.col("sketch").alias(f"{c}s"))
        found = found.join(side("x"), "xi").join(side("y"), "yi").filter(alike("xs", "ys"))
    out = cut(found.select(F.least("xi", "yi").alias("a"), F.greatest("xi", "yi").alias("b")).distinct(), "remaining")
    drop(each, prefix, met)
    return out
