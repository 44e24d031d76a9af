"""Exact links between texts that share a group (a token, a band), without all pairs of a large group.

Texts are sets of 64-bit tokens; two are linked when intersection / union >=
num / den. Groups of at most ``heavy`` members are compared pair by pair. In a
larger group every member is compared with one pivot p only, which also gives its
difference set D: the tokens R it lacks of p and those A it has beyond p. Then

* members linked to p lie in one component: nothing is left to show among them;
* a link of an open x, one that is not linked to p, to any other y needs the overlap
  ``|D_x & D_y| >= T = (s_x + s_y) / (2 (den + num))`` with
  ``s = (den + num) |D| - (den - num) n``, since the symmetric difference of x and y
  is that of D_x and D_y. So candidates share a token in prefixes of their difference sets.
  In the common order the tokens beyond p come first: where T exceeds min(|R_x|, |R_y|) the two
  share a token beyond p, hence their first common token is one, and matches on tokens
  of p are left out. For an open x this is so unless y is shorter than p, so most members
  need not be looked up by the tokens of p at all.
* these differences need no member at their centre. The pivot is a copy with edits of its own, which stand in
  the differences of nearly all others and would make candidates of them all. So the differences are taken to the
  pivot with the tokens changed that most members of a bounded draw have changed; the draw
  decides where the centre lies, and any centre gives all links. Members so near to it that T <= 0 are linked
  whatever they share; they all are to the nearest of the group, so a pair with that one is enough;
* where more than ``open_pairs`` members are open, p was no centre for them: they are joined in
  that way with the linked ones only, and form a group with a pivot of their own, for some levels.

The links found have the same components as all links between members of a common group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm import textops as T
from tandem.llm.staging import join_summary, stage

#: Groups of more members take the pivot route (both routes find all links).
HEAVY = 16
#: Open members of a group that are joined among each other; more get a pivot of their own,
OPEN_PAIRS = 4096
#: for so many levels at most.
LEVELS = 6
#: Members of a group that are asked where its centre lies.
DRAW = 15
#: Keys, or entries of the lists that keys carry, sent whole to every executor, at most; more are joined.
BROADCAST_KEYS = 2_000_000

Tokens = Callable[[list[str]], list[np.ndarray]]


def bounded_join(rows: DataFrame, keys: DataFrame, on: str, how: str = "inner", items: Column | None = None) -> DataFrame:
    """Join with a staged table of distinct keys, broadcast only if its counted size is small.

    ``items`` is the number of entries in the lists of a row of ``keys`` (inner joins). Where
    these are too many, only the keys are broadcast, and the rows that meet one are joined by shuffle.
    """
    size = keys.agg(F.count("*").alias("n"), F.sum(F.lit(1) if items is None else items).alias("items")).first()
    if max(size["n"], size["items"] or 0) <= BROADCAST_KEYS:
        return rows.join(F.broadcast(keys), on, how)
    if items is not None and how == "inner" and size["n"] <= BROADCAST_KEYS:
        rows = rows.join(F.broadcast(keys.select(on)), on, "left_semi")
    return rows.join(keys, on, how)


def _compare(tokens: Tokens, num: int, den: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("star", pa.bool_()), ("na", pa.int64()), ("nb", pa.int64()),
                        ("dist", pa.int64()), ("linked", pa.bool_()), ("beyond", pa.int64()), ("diff", pa.binary())])

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 128):
                batch = whole.slice(lo, 128)
                a, b, star = (batch.column(c).to_pylist() for c in ("a", "b", "star"))
                texts = dict(zip(a, batch.column("text_a").to_pylist())) | dict(zip(b, batch.column("text_b").to_pylist()))
                sets = dict(zip(texts, tokens(list(texts.values()))))
                out: list[list] = [[] for _ in range(6)]
                for i, j, s in zip(a, b, star):
                    x, y = sets[i], sets[j]
                    both = np.concatenate((x, y))
                    both.sort()
                    common = both[1:][both[1:] == both[:-1]]
                    dist, total = len(both) - 2 * len(common), len(both)
                    diff = None
                    if s:  # what the member has beyond the pivot, then what it lacks of it
                        diff = np.concatenate((np.setdiff1d(y, common, assume_unique=True),
                                               np.setdiff1d(x, common, assume_unique=True))).tobytes()
                    for col, v in zip(out, (len(x), len(y), dist, (den + num) * dist <= (den - num) * total,
                                            len(y) - len(common), diff)):
                        col.append(v)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a"), batch.column("b"), batch.column("star")]
                    + [pa.array(c, f.type) for c, f in zip(out, list(schema)[3:])], schema=schema)
    return run


def verify(pairs: DataFrame, texts: DataFrame, tokens: Tokens, num: int, den: int) -> DataFrame:
    """Sizes, distance and link of every pair (a, b, star); star pairs with their difference set."""
    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select(
        "a", "b", "star", "text_a", "text_b").mapInArrow(
        _compare(tokens, num, den),
        "a long, b long, star boolean, na long, nb long, dist long, linked boolean, beyond long, diff binary")


_CARRIED = ["p", "x", "n", "s", "linked", "beyond", "lacks", "take"]


def _explode_diff(batches):
    """A row for every token beyond the pivot, and for those the member lacks where ``use_r`` is set."""
    for batch in T.row_runs(batches):
        beyond, use_r = batch.column("beyond").to_numpy(), batch.column("use_r").to_pylist()
        lists = [np.frombuffer(x, dtype=np.int64) for x in batch.column("diff").to_pylist()]
        lists = [x if r else x[:b] for x, r, b in zip(lists, use_r, beyond.tolist())]
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        take = pa.array(np.repeat(np.arange(len(lists)), sizes))
        at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        yield pa.RecordBatch.from_arrays(
            [batch.column(c).take(take) for c in _CARRIED]
            + [pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64)),
               pa.array(at < np.repeat(beyond, sizes), pa.bool_())], names=[*_CARRIED, "tok", "added"])


def _common_changes(batches):
    """Tokens that more than half of the drawn members have beyond the pivot, then those more than half lack."""
    for batch in batches:
        moved: list[list] = [[], [], []]
        for beyond, diff in zip(batch.column("beyond").to_pylist(), batch.column("diff").to_pylist()):
            lists = [np.frombuffer(x, dtype=np.int64) for x in diff]
            parts = []
            for part in ([x[:b] for x, b in zip(lists, beyond)], [x[b:] for x, b in zip(lists, beyond)]):
                tokens, times = np.unique(np.concatenate(part), return_counts=True)
                parts.append(tokens[2 * times > len(lists)])
            for col, v in zip(moved, (len(parts[0]), len(parts[1]), np.concatenate(parts).tobytes())):
                col.append(v)
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), pa.array(moved[0], pa.int64()), pa.array(moved[1], pa.int64()), pa.array(moved[2], pa.binary())],
            names=["a", "gain", "loss", "moved"])


def _to_centre(batches):
    """Differences to the centre of the group in place of those to its pivot."""
    for batch in T.row_runs(batches):
        na, dist, beyond, diff = (batch.column(c).to_pylist() for c in ("na", "dist", "beyond", "diff"))
        for i, (gain, loss, moved) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("gain", "loss", "moved")))):
            if not moved:
                continue
            more, less = np.split(np.frombuffer(moved, dtype=np.int64), [gain])
            has, lacks = np.split(np.frombuffer(diff[i], dtype=np.int64), [beyond[i]])
            has, lacks = (np.concatenate((_minus(has, more), _minus(less, lacks))),
                          np.concatenate((_minus(lacks, less), _minus(more, has))))
            na[i], dist[i], beyond[i] = na[i] + gain - loss, len(has) + len(lacks), len(has)
            diff[i] = np.concatenate((has, lacks)).tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(na, pa.int64()), batch.column("nb"), pa.array(dist, pa.int64()),
             batch.column("linked"), pa.array(beyond, pa.int64()), pa.array(diff, pa.binary())],
            names=["a", "b", "na", "nb", "dist", "linked", "beyond", "diff"])


def _minus(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.setdiff1d(x, y, assume_unique=True)


def _centred(star: DataFrame) -> DataFrame:
    """Star pairs with size and differences of the group's centre in place of those of its pivot."""
    turn = Window.partitionBy("a").orderBy(F.xxhash64("b"))
    drawn = star.select("a", "b", "beyond", "diff").withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= DRAW)
    moves = stage(drawn.groupBy("a").agg(F.collect_list(F.struct("beyond", "diff")).alias("d"))
                  .select("a", F.col("d.beyond").alias("beyond"), F.col("d.diff").alias("diff"))
                  .mapInArrow(_common_changes, "a long, gain long, loss long, moved binary").where("gain + loss > 0"))
    rows = bounded_join(star.select("a", "b", "na", "nb", "dist", "linked", "beyond", "diff"), moves, "a", "left",
                        F.col("gain") + F.col("loss"))
    return rows.mapInArrow(_to_centre, "a long, b long, na long, nb long, dist long, linked boolean, beyond long, diff binary")


def _residual_pairs(star: DataFrame, num: int, den: int, among_open: bool) -> DataFrame:
    """Pairs of an open member and a linked one (``among_open``: or another open one) that share a
    prefix token of their difference sets."""
    both, less = den + num, den - num
    rows = _centred(star).select(F.col("a").alias("p"), F.col("b").alias("x"), F.col("na").alias("np"), F.col("nb").alias("n"), "dist",
                       "linked", "beyond", (F.col("dist") - F.col("beyond")).alias("lacks"), "diff",
                       (both * F.col("dist") - less * F.col("nb")).alias("s"))
    partner, is_open = F.lit(True) if among_open else F.col("linked"), ~F.col("linked")
    least = lambda cond, c: F.min(F.when(cond, F.col(c)))
    groups = rows.groupBy("p").agg(
        least(partner, "s").alias("s_partner"), least(is_open, "s").alias("s_open"), least(partner, "n").alias("n_partner"),
        least(is_open, "n").alias("n_open"), F.count("*").alias("members"),
        F.min(F.when(partner, F.struct("s", "x", "linked"))).alias("nearest")).where(
        "s_open is not null and s_partner is not null and members > 1")
    rows = join_summary(rows, groups, ["p"])
    other = lambda c: F.when(F.col("linked"), F.col(f"{c}_open")).otherwise(F.col(f"{c}_partner"))
    need = F.greatest(F.lit(1), F.ceil((F.col("s") + other("s")) / (2.0 * both)))
    # T <= |R| of the other, and of the member itself, for the least of the others' sizes and slacks
    shortest = F.greatest(other("n"), F.ceil(num * F.col("n") / den))
    use_r = ((F.col("s") <= both * F.col("np") - 2 * num * shortest)
             & (other("s") <= less * F.col("n") + both * (F.col("np") - F.col("n"))))
    # linked to the nearest whatever the two share, and one of them open
    sure = ((F.col("s") + F.col("nearest.s") <= 0) & (F.col("x") != F.col("nearest.x"))
            & ~(F.col("linked") & (F.col("nearest.linked") if among_open else F.lit(True))))
    rows = rows.withColumns({"take": (F.col("dist") - need + 1).cast("long"), "use_r": use_r,
                             "near": F.when(sure, F.col("nearest.x"))}).where("take > 0 or near is not null")
    rows = stage(rows.select(*_CARRIED, "use_r", "diff", "near"))
    tokens = rows.mapInArrow(_explode_diff, "p long, x long, n long, s long, linked boolean, beyond long, lacks long, "
                                            "take long, tok long, added boolean")
    counts = (tokens.groupBy("p", "tok").agg(F.count("*").alias("df"), F.min("linked").alias("all_linked"),
                                             F.max("linked").alias("any_linked"))
              .where("df > 1 and not all_linked" + ("" if among_open else " and any_linked")).select("p", "tok", "df"))
    # the order: tokens beyond p, then those of p; in either part those that no pair in question can
    # have in common come first, and only their number matters
    common = join_summary(tokens, counts, ["p", "tok"])
    part = Window.partitionBy("p", "x", "added")  # one difference set
    place = F.row_number().over(part.orderBy("df", "tok")) + F.when(F.col("added"), F.col("beyond")).otherwise(
        F.col("beyond") + F.col("lacks")) - F.count("*").over(part)
    prefix = common.withColumn("rank", place).where("rank <= take").select(
        "p", "tok", "added", "x", "n", "s", "linked", "lacks", (F.col("beyond") + F.col("lacks") - F.col("rank") + 1).alias("left"))
    x = prefix.where("not linked")
    y = prefix if among_open else prefix.where("linked")
    y = y.select("p", "tok", *(F.col(c).alias(f"{c}2") for c in ("x", "n", "s", "linked", "lacks", "left")))
    overlap = F.col("s") + F.col("s2")  # times 1 / (2 both)
    meet = (x.join(y, ["p", "tok"])
            .where((F.col("linked2") | (F.col("x") < F.col("x2")))
                   & (den * F.least("n", "n2") >= num * F.greatest("n", "n2"))
                   & (F.col("added") | (2 * both * F.least("lacks", "lacks2") >= overlap))
                   # from the first common token on, both have enough left for the overlap
                   & (2 * both * F.least("left", "left2") >= overlap))
            .select(F.least("x", "x2").alias("a"), F.greatest("x", "x2").alias("b")))
    spokes = rows.where("near is not null").select(F.least("x", "near").alias("a"), F.greatest("x", "near").alias("b"))
    return meet.unionByName(spokes).distinct()


def _grouped(members: DataFrame, heavy: int) -> DataFrame:
    """Members of groups of two or more, staged, with the group's size and, in larger groups, its pivot.

    The pivot is the member whose larger groups hold most members in all: the centre of near copies
    shares a group with nearly each of them, a stray with few. Groups of one cluster thus agree on it."""
    sizes = members.groupBy("g").agg(F.count("*").alias("size")).where("size > 1")
    sized = stage(join_summary(members, sizes, ["g"]).select("g", "id", "n", "score", "size"))
    large = sized.where(F.col("size") > heavy)
    weight = large.groupBy("id").agg(F.sum("size").alias("weight"))
    central = join_summary(large, weight, ["id"])
    pivots = central.groupBy("g").agg(F.min(F.struct((-F.col("weight")).alias("w"), "score", "id")).alias("pivot"))
    placed = join_summary(large, pivots.select("g", F.col("pivot.id").alias("pivot")), ["g"])
    return stage(sized.where(F.col("size") <= heavy).withColumn("pivot", F.lit(None).cast("long")).unionByName(placed))


def links(members: DataFrame, texts_of: Callable[[DataFrame], DataFrame], tokens: Tokens, num: int, den: int,
          also: DataFrame | None = None, heavy: int = HEAVY, open_pairs: int | None = None) -> DataFrame:
    """Verified links (a, b).

    members: g, id (distinct together), n (set size) and score (lower: likelier pivot, of equally central ones).
    also: id and an array; linked ids have an element in common, which is asked for before a pair is verified.
    texts_of(ids) gives id and text of the distinct ids of a staged table.
    """
    open_pairs = OPEN_PAIRS if open_pairs is None else open_pairs

    def filtered(pairs: DataFrame) -> DataFrame:
        if also is None:
            return pairs
        return (pairs.join(also.select(F.col("id").alias("a"), F.col("also").alias("also_a")), "a")
                .join(also.select(F.col("id").alias("b"), F.col("also").alias("also_b")), "b")
                .where(F.arrays_overlap("also_a", "also_b")).select("a", "b"))

    def light_pairs(placed: DataFrame) -> DataFrame:
        light = placed.where(F.col("size") <= heavy).select("g", "id", "n")
        other = light.select("g", F.col("id").alias("id2"), F.col("n").alias("n2"))
        near = (den * F.least("n", "n2") >= num * F.greatest("n", "n2"))
        return light.join(other, "g").where((F.col("id") < F.col("id2")) & near).select(
            F.col("id").alias("a"), F.col("id2").alias("b")).distinct()

    def with_spokes(pairs: DataFrame, placed: DataFrame) -> DataFrame:
        spokes = placed.where((F.col("size") > heavy) & (F.col("id") != F.col("pivot"))).select(
            F.col("pivot").alias("a"), F.col("id").alias("b")).distinct().withColumn("star", F.lit(True))
        return stage(pairs.withColumn("star", F.lit(False)).unionByName(spokes))

    placed = _grouped(members, heavy)
    pairs = with_spokes(filtered(light_pairs(placed)), placed)
    ids = stage(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    texts = stage(texts_of(ids))
    checked = stage(verify(pairs, texts, tokens, num, den))
    found = checked.where("linked").select("a", "b")
    for level in range(LEVELS):
        star = checked.where("star")
        opens = star.groupBy("a").agg(F.count_if(~F.col("linked")).alias("open"))
        most = opens.agg(F.max("open")).first()[0] or 0
        if not most:
            break
        if most <= open_pairs or level == LEVELS - 1:
            rest = filtered(_residual_pairs(star, num, den, among_open=True))
            checked = verify(rest.withColumn("star", F.lit(False)), texts, tokens, num, den)
            found = found.unionByName(checked.where("linked").select("a", "b"))
            break
        star = stage(join_summary(star, opens, ["a"]))
        few, many = star.where(F.col("open") <= open_pairs), star.where(F.col("open") > open_pairs)
        rest = _residual_pairs(few, num, den, True).unionByName(_residual_pairs(many, num, den, False))
        still = many.where("not linked").select(F.col("a").alias("pivot"), F.col("b").alias("id"), F.col("nb").alias("n"))
        placed = _grouped(placed.where(F.col("size") > heavy).drop("n", "size").join(still, ["pivot", "id"])
                          .select("g", "id", "n", "score"), heavy)
        pairs = filtered(light_pairs(placed).unionByName(rest).distinct())
        checked = stage(verify(with_spokes(pairs, placed), texts, tokens, num, den))
        found = found.unionByName(checked.where("linked").select("a", "b"))
    return found
