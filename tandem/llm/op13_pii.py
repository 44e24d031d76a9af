"""Personal data by bootstrapped contextual extraction (operator 13), DataFrame functions alone.

1. Base: four kinds (email, ip, card, phone) by regular expression, with checks on numbers.
   Java tells matches, not places; ``split`` by the same expression gives the gaps between
   them, and running sums of gaps and lengths give the places.
2. Seeds induce lexical patterns: the two words before an entity, and the words on either
   side of it, lower-cased; an identifier among them is written ``#``, an end of the text ``^``.
3. Runs of words that hold a digit or ``@`` and no base entity are the unseen candidates; they
   stand in patterns as well. Patterns and instances (distinct surfaces) form a graph,
   which is scored in rounds:
   a pattern's confidence for a kind is positives / (positives + negatives), over its distinct
   instances: positives are seeds and accepted instances of the kind, negatives those of
   other kinds and candidates whose shape excludes the kind; other candidates are unknown
   and count for neither. Patterns with ``min_seeds`` positives and ``min_confidence`` are kept.
   A candidate's score for a kind is 1 - product(1 - confidence) over its kept patterns; from
   ``accept`` on, with a shape the kind allows, it is accepted for its best kind and is a positive
   of the next round. Rounds end when nothing new is accepted.
4. Accepted instances are spans wherever they stand.

Texts are read once; what is staged and shuffled are places, short contexts and surfaces of
identifiers. A pattern or a surface that very many rows share is counted by partial
aggregation; the spans of one text meet in one task, those of copies never do.

The expressions are those of the contract with possessive quantifiers and look-behinds in
place of retries that cannot succeed, so that runs of any length take linear time and no
stack. Cards are searched with their number of digits bounded, which is the same as dropping
other matches: a maximal run of digits is matched whole or not at all.

Defined cases: null and empty texts have no spans; a null id is kept; repeated rows give
equal rows; a surface accepted for two kinds with equal scores takes the kind listed first; context
words are cut from 160 characters on either side; an empty table gives an empty
result; extra columns are not read. Without seeds nothing is learned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.staging import join_summary, stage

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE, RUN = range(5)

_GAP = r"\x20\x09-\x0D"
_LOCAL = "A-Za-z0-9._%+-"
_WORD_WITH_SIGN = rf"[^{_GAP}0-9@]*+[0-9@][^{_GAP}]*+"
PATTERNS = {
    EMAIL: rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
    RUN: rf"(?<![^{_GAP}]){_WORD_WITH_SIGN}(?:\x20{_WORD_WITH_SIGN})*+",
}
#: Shapes a candidate may have, by kind.
SHAPES = {
    EMAIL: r"^[^@]+@[^@]+$|[(\[]at[)\]]",
    IP: r"^[0-9A-Fa-f]+(?:[.:]+[0-9A-Fa-f]*){3,}+$",
    CARD: r"^[0-9](?:[\x20-]?[0-9]){11,}+$",
    PHONE: r"^(?=(?:[^0-9]*[0-9]){7,15}[^0-9]*$)[+()0-9\x20./-]+$",
}
CONTEXT = 160
_LEAD = r"""^(?:[A-Za-z_]+[:=])?["'<\[{,;:!?]*"""
_TRAIL = r"""(?<!["'>\]},;:.!?])["'>\]},;:.!?]++$"""
_BEFORE = r"""["'(<\[{]+$"""
_AFTER = r"""^["')>\]},;:.!?]+"""


@dataclass(frozen=True)
class Settings:
    min_seeds: int = 5
    min_confidence: float = 0.8
    accept: float = 0.9
    rounds: int = 6


# ----------------------------------------------------------------------------- places
def _guard(text: Column, kind: int) -> Column:
    """What a text with a match must contain, cheaper than the search itself."""
    if kind == EMAIL:
        return F.contains(text, F.lit("@"))
    if kind == PHONE:
        return F.contains(text, F.lit("+"))
    return text.rlike("[0-9]") if kind != RUN else text.rlike("[0-9@]")


def _items(docs: DataFrame) -> DataFrame:
    """doc_id, rk and every match of a row: kind, number, gap before it, text, and what stands around."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("rk"))
    rows = rows.select("*", *(F.when(_guard(F.col("text"), k), F.regexp_extract_all("text", F.lit(p), F.lit(0)))
                              .alias(f"m{k}") for k, p in PATTERNS.items()))
    rows = rows.select("doc_id", "rk", *(f"m{k}" for k in PATTERNS),
                       *(F.when(F.size(f"m{k}") > 0, F.split("text", p, -1)).alias(f"p{k}") for k, p in PATTERNS.items()))
    around = [F.transform(f"p{k}", lambda x: F.struct(F.char_length(x).alias("gap"), F.right(x, F.lit(CONTEXT)).alias("left"),
                                                      F.left(x, F.lit(CONTEXT)).alias("right"))).alias(f"p{k}") for k in PATTERNS]
    rows = rows.select("doc_id", "rk", *(f"m{k}" for k in PATTERNS), *around)

    def located(k: int) -> Column:
        n = F.size(f"m{k}")
        both = F.arrays_zip(F.slice(f"p{k}", 1, n).alias("a"), F.slice(f"p{k}", 2, n).alias("b"), F.col(f"m{k}").alias("m"))
        return F.when(n > 0, F.transform(both, lambda x, i: F.struct(
            F.lit(k).alias("kind"), i.alias("i"), x["a"]["gap"].alias("gap"), x["m"].alias("found"),
            x["a"]["left"].alias("left"), x["b"]["right"].alias("right"))))

    none = F.array().cast("array<struct<kind:int,i:int,gap:int,found:string,left:string,right:string>>")
    return rows.select("doc_id", "rk", F.concat(*(F.coalesce(located(k), none) for k in PATTERNS)).alias("items"))


def _words(text: Column) -> Column:
    trimmed = F.regexp_replace(F.lower(text), rf"^[{_GAP}]+|[{_GAP}]+$", "")
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, rf"[{_GAP}]+"))
    return F.transform(words, lambda w: F.when(w.rlike("[0-9@]"), F.lit("#")).otherwise(w))


def _places(items: DataFrame) -> DataFrame:
    """rk, kind, start, end, found, left, right of every match, equal rows once."""
    # one row per text: copies of a row have equal matches
    once = items.where(F.size("items") > 0).groupBy("rk").agg(F.first("items").alias("items"))
    each = once.select("rk", F.inline("items"))
    own = Window.partitionBy("rk", "kind").orderBy("i")
    size = F.char_length("found")
    end = F.sum(F.col("gap") + size).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return each.select("rk", "kind", "i", "found", "left", "right", end.alias("end")).withColumn("start", F.col("end") - size)


def _valid(kind: Column, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    parts = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    ip = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).try_cast("int") <= 255))
    # Luhn: from the right, every second digit doubled, digit sums added up
    folded = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(
        c.try_cast("int") * 2 - F.when(c.try_cast("int") > 4, 9).otherwise(0)))
    luhn = F.aggregate(folded, F.lit(0), lambda a, x: a + x) % 10 == 0
    return (F.when(kind == IP, ip).when(kind == CARD, n.between(12, 19) & luhn).when(kind == PHONE, n.between(9, 15))
            .otherwise(True))


def found_places(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id and rk of every row; places of base entities and open runs: rk, kind, start, end,
    hash of the surface, kinds that a run's shape allows, and the words before and after)."""
    items = stage(_items(docs))
    places = _places(items).where(_valid(F.col("kind"), F.col("found")))
    # an open run holds no base entity: none reaches into it from before, none begins inside
    text = Window.partitionBy("rk").orderBy("start", "end")
    base = F.col("kind") < RUN
    reach = F.max(F.when(base, F.col("end"))).over(text.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.min(F.when(base, F.col("start"))).over(text.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    places = places.withColumns({"reach": reach, "ahead": ahead}).where(
        base | ((F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.coalesce("ahead", F.col("end")) >= F.col("end"))))
    run = F.col("kind") == RUN
    lead = F.when(run, F.regexp_extract("found", _LEAD, 0)).otherwise(F.lit(""))
    places = places.withColumn("lead", lead)
    rest = F.substr("found", F.char_length("lead") + 1)
    places = places.withColumn("core", F.when(run, F.regexp_replace(rest, _TRAIL, "")).otherwise(F.col("found")))
    shapes = F.array_compact(F.array(*(F.when(F.lower("core").rlike(p), F.lit(k)) for k, p in SHAPES.items())))
    places = places.where("core <> ''").select(
        "rk", "kind", (F.col("start") + F.char_length("lead")).alias("start"),
        (F.col("start") + F.char_length("lead") + F.char_length("core")).alias("end"),
        F.xxhash64(F.lower("core")).alias("surface"), F.when(run, shapes).alias("shapes"),
        _words(F.regexp_replace(F.concat("left", "lead"), _BEFORE, "")).alias("before"),
        _words(F.regexp_replace("right", _AFTER, "")).alias("after"), (F.col("i") > 0).alias("later"))
    edge = F.when(run & F.col("later"), F.lit("#")).otherwise(F.lit("^"))  # runs are next to runs
    n = F.size("before")
    word = lambda k: F.when(n >= k, F.get("before", n - k)).otherwise(edge)
    return items.select("doc_id", "rk"), places.select(
        "rk", "kind", "start", "end", "surface", "shapes", word(2).alias("w2"), word(1).alias("w1"),
        F.coalesce(F.get("after", F.lit(0)), F.lit("^")).alias("w3"))


# ------------------------------------------------------------------------------- graph
def _edges(places: DataFrame) -> DataFrame:
    """Distinct pattern and surface (hashed) with its seed kind (null: unknown), or else its possible kinds."""
    real = lambda c: ~F.col(c).isin("#", "^")
    patterns = F.array_compact(F.array(
        F.when(real("w1"), F.concat_ws(" ", F.lit("before"), "w2", "w1")),
        F.when(real("w1") & real("w3"), F.concat_ws(" ", F.lit("around"), "w1", "w3"))))
    each = places.select(F.explode(patterns).alias("pattern"), "surface", "shapes",
                         F.when(F.col("kind") < RUN, F.col("kind")).alias("seed"))
    return each.groupBy("pattern", "surface").agg(F.min("seed").alias("seed"), F.first("shapes", ignorenulls=True).alias("shapes"))


def _confident(edges: DataFrame, settings: Settings) -> DataFrame:
    """pattern, kind and confidence of the patterns to keep; ``label`` is the known kind of a surface."""
    known = [F.sum((F.col("label") == k).cast("long")).alias(f"pos{k}") for k in range(len(KINDS))]
    against = [F.sum((F.coalesce(F.col("label") != k, ~F.array_contains("shapes", k))).cast("long")).alias(f"neg{k}")
               for k in range(len(KINDS))]
    counts = edges.groupBy("pattern").agg(*known, *against)
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(f"pos{k}", F.lit(0)).alias("pos"),
                               F.coalesce(f"neg{k}", F.lit(0)).alias("neg")) for k in range(len(KINDS))))
    each = counts.select("pattern", F.inline(kinds)).where(F.col("pos") >= settings.min_seeds)
    return each.withColumn("confidence", F.col("pos") / (F.col("pos") + F.col("neg"))).where(
        F.col("confidence") >= settings.min_confidence).select("pattern", "kind", "confidence")


def learned(places: DataFrame, settings: Settings = Settings()) -> DataFrame | None:
    """surface and kind of the accepted candidates; None without any."""
    edges = stage(_edges(places))
    open_edges = edges.where("seed is null and size(shapes) > 0")
    accepted, count = None, 0
    for _ in range(settings.rounds):
        known = edges.withColumn("label", F.col("seed"))
        if accepted is not None:
            known = join_summary(edges, accepted, ["surface"], "left").withColumn("label", F.coalesce("seed", "kind"))
        kept = stage(_confident(known, settings))
        hits = join_summary(open_edges, kept, ["pattern"]).where(F.array_contains("shapes", F.col("kind")))
        # 1 - product(1 - confidence); a confidence of one decides alone
        score = F.when(F.max("confidence") == 1, F.lit(1.0)).otherwise(
            1 - F.exp(F.sum(F.when(F.col("confidence") < 1, F.log1p(-F.col("confidence"))))))
        scores = hits.groupBy("surface", "kind").agg(score.alias("score")).where(F.col("score") >= settings.accept)
        best = stage(scores.groupBy("surface").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind")))
        now = best.count()
        if now <= count:
            break
        accepted, count = best, now
    return accepted


# ---------------------------------------------------------------------------- operator
def personal_data(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, base and all spans (arrays of start, kind number and end, in order) of every row."""
    rows, places = found_places(docs)
    places = stage(places)
    spans = places.where(F.col("kind") < RUN).select("rk", "kind", "start", "end", F.lit(True).alias("base"))
    more = learned(places, settings)
    if more is not None:
        runs = places.where(F.col("kind") == RUN).select("rk", "surface", "start", "end")
        spans = spans.unionByName(join_summary(runs, more, ["surface"]).select(
            "rk", "kind", "start", "end", F.lit(False).alias("base")))
    one = F.struct("start", "kind", "end")
    by_text = spans.groupBy("rk").agg(F.sort_array(F.collect_list(F.when(F.col("base"), one))).alias("base"),
                                      F.sort_array(F.collect_list(one)).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return join_summary(rows, by_text, ["rk"], "left").select(
        "doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def report(found: DataFrame) -> DataFrame:
    """Counts of the base spans by kind, their digest, and all spans as a string."""
    names = F.array(*(F.lit(k) for k in KINDS))

    def written(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))
