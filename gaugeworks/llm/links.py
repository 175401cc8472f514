"""Exact set-similarity links between distinct sets, from prefix tokens to components.

A set is an id, its size and its prefix: the first tokens in one global order (rarest
first). Two sets of Jaccard similarity ``num / den`` or more share a prefix token. Only
connectivity is wanted, so each inverted list is first compared with its first
members (hubs). Where a list still holds members of different components, its other
pairs are compared by bit signatures, whose distance never exceeds the number of tokens
that only one of the sets has, and those that may reach the similarity are listed. No
pair that reaches it is dropped, and a group of copies costs a multiple of its size, not
its square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.functions.plans import evaluated_once
from gaugeworks.llm.common import components, finished, stage

HUBS = 3
SIGN_WORDS = 8
"""Longs of a bit signature; a power of two."""
BROADCAST_KEYS = 1_000_000
"""Most 64-bit keys that are broadcast as a filter; beyond, the same join shuffles."""


def small_keys(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def long_enough(a: str, b: str, num: int, den: int) -> Column:
    """Sizes that allow the similarity."""
    return den * F.least(F.col(a), F.col(b)) >= num * F.greatest(F.col(a), F.col(b))


def reachable(na: Column, pa: Column, nb: Column, pb: Column, num: int, den: int) -> Column:
    """Whether sets whose first common token stands at ``pa`` and ``pb`` can still overlap enough."""
    return (num + den) * (1 + F.least(na - 1 - pa, nb - 1 - pb)) >= num * (na + nb)


def compatible(na: Column, pa: Column, nb: Column, pb: Column, num: int, den: int) -> Column:
    """Whether sets with any common token at ``pa`` and ``pb`` can overlap enough; earlier tokens may be common too."""
    return (num + den) * (F.least(pa, pb) + 1 + F.least(na - 1 - pa, nb - 1 - pb)) >= num * (na + nb)


def shared_postings(sets: DataFrame, name: str) -> DataFrame:
    """``token, id, n, pos, copies`` for the prefix tokens that at least two different sets have.

    ``sets`` (``id, n, prefix``) may repeat sets; counting has a map-side step and lists
    of one set never leave their task when the shared tokens are few.
    """
    each = sets.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    tokens = stage(each.groupBy("token").agg(F.min("id").alias("low"), F.max("id").alias("high"))
                   .where("low < high").select("token"), f"{name}-tokens")
    lists = each.join(small_keys(tokens), "token").groupBy("token", "id", "n", "pos").agg(F.count("*").alias("copies"))
    return stage(lists, f"{name}-lists")


def hub_pairs(lists: DataFrame, num: int, den: int, hubs: int = HUBS) -> DataFrame:
    """Each posting beside the first ``hubs`` members of its list: ``a`` (hub), ``b``, sizes, places, ``token``.

    First are the sets with the most copies, then those in which the token stands first:
    an original is copied more often than its variants are, and has fewer rare tokens.
    """
    first = Window.partitionBy("token").orderBy(F.desc("copies"), "pos", "id")
    heads = (lists.withColumn("r", F.row_number().over(first)).where(F.col("r") <= hubs)
             .select("token", F.col("id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("copies").alias("ca")))
    return (lists.select("token", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("copies").alias("cb"))
            .join(heads, "token")
            .where((F.struct(-F.col("ca"), "pa", "a") < F.struct(-F.col("cb"), "pb", "b")) & long_enough("na", "nb", num, den)))


def signatures(sets: DataFrame) -> DataFrame:
    """``id, sign`` from ``id, tokens``: each token flips one bit of the signature, chosen by its low bits."""
    word = "aggregate(filter(tokens, t -> (shiftright(t, 6) & {last}) = {k}), 0L, (s, t) -> s ^ shiftleft(1L, cast(t & 63 as int)))"
    return sets.select("id", F.array(*[F.expr(word.format(last=SIGN_WORDS - 1, k=k)) for k in range(SIGN_WORDS)]).alias("sign"))


def near_signatures(na: str, sa: str, nb: str, sb: str, num: int, den: int) -> Column:
    """Whether two signatures leave the similarity possible.

    A bit differs only where an odd number of tokens of one set alone fall on it, so there
    are at least as many such tokens as differing bits; the similarity bounds their number.
    """
    apart = sum((F.bit_count(F.col(sa)[k].bitwiseXOR(F.col(sb)[k])) for k in range(1, SIGN_WORDS)),
                F.bit_count(F.col(sa)[0].bitwiseXOR(F.col(sb)[0])))
    return (num + den) * apart <= (den - num) * (F.col(na) + F.col(nb))


def open_lists(lists: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """The postings, with ``root``, of lists whose members lie in different components."""
    known = small_keys(roots.select(F.col("node").alias("id"), "root"))
    rooted = lists.join(known, "id", "left").withColumn("root", F.coalesce("root", "id"))
    tokens = stage(rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"))
                   .where("low < high").select("token"), f"{name}-open-tokens")
    return stage(rooted.join(small_keys(tokens), "token").select("token", "id", "n", "pos", "root"), f"{name}-open")


def rest_pairs(left: DataFrame, signs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of open lists in different components that their signatures leave possible, once per token that both have.

    A pair that reaches the similarity keeps all its tokens, so they can be counted.
    """
    left = left.join(signs, "id")
    one, two = (left.select("token", F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}"),
                            F.col("root").alias(f"r{x}"), F.col("sign").alias(f"s{x}")) for x in "ab")
    return one.join(two, "token").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb"))
                                        & long_enough("na", "nb", num, den)
                                        & compatible(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"), num, den)
                                        & near_signatures("na", "sa", "nb", "sb", num, den)).drop("sa", "sb")


def asked(pairs: DataFrame) -> DataFrame:
    """``id`` of the sets that a pair asks for."""
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()


def linked(sets: DataFrame, candidates: Callable[[DataFrame], DataFrame], tokens: Callable[[DataFrame], DataFrame],
           verify: Callable[[DataFrame, DataFrame], DataFrame], num: int, den: int, name: str) -> DataFrame:
    """``node, root`` for every set with a link.

    ``candidates`` reduces listed pairs to distinct ``a, b``, losing none that reaches the
    similarity; ``tokens`` gives ``id, tokens`` (all of a set) for a frame of ids; ``verify``
    keeps the pairs whose tokens reach the similarity.
    """
    spark = sets.sparkSession
    lists = shared_postings(sets, name)
    tried = stage(candidates(hub_pairs(lists, num, den)).select("a", "b"), f"{name}-tried")

    def first() -> DataFrame:
        wanted = stage(asked(tried), f"{name}-wanted")
        return verify(tried, stage(tokens(wanted), f"{name}-sets")).select("a", "b")

    def rest() -> DataFrame:
        left = open_lists(lists, roots, name)
        wanted = stage(left.select("id").distinct(), f"{name}-wanted")
        signs = stage(signatures(evaluated_once(tokens(wanted))), f"{name}-signs")  # the tokens of all open lists are not stored
        known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = candidates(rest_pairs(left, signs, num, den)).select("a", "b")
        more = stage(pairs.join(known, ["a", "b"], "left_anti"), f"{name}-more")
        paired = stage(asked(more), f"{name}-wanted")
        return verify(more, stage(tokens(paired), f"{name}-sets")).select("a", "b")

    found = finished(spark, first, f"{name}-found")
    roots = finished(spark, lambda: components(found, name), f"{name}-roots")
    again = finished(spark, rest, f"{name}-found")
    return roots if again.isEmpty() else finished(spark, lambda: components(found.union(again), name), f"{name}-roots")
