"""Joins on keys, names and priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrametra.functions import text
from terrametra.functions.geo import once
from terrametra.operators.ranking import keep_first


def left_with_defaults(base: DataFrame, facts: DataFrame, keys: list[str], defaults: dict) -> DataFrame:
    """Left equi-join with default values for rows without a match."""
    return base.join(facts, keys, "left").fillna(defaults)


def override(base: DataFrame, observed: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Observed values replace the base values where they are present."""
    renamed = observed.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in columns])
    out = base.join(renamed, keys, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(f"_o_{c}"), F.col(c)))
    return out.drop(*[f"_o_{c}" for c in columns])


def lookup(df: DataFrame, dim: DataFrame, keys: list[str], max_rows: int = 100_000) -> DataFrame:
    """Left join with a dimension; broadcast only when the dimension was counted below ``max_rows``."""
    small = dim.limit(max_rows + 1).count() <= max_rows
    return df.join(F.broadcast(dim) if small else dim, keys, "left")


def only_in(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), keys, "left_anti")


def in_both(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), keys, "left_semi")


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return keep_first(df, keys, order)


def registry_diff(new: DataFrame, old: DataFrame, name: str, street: str, species: Column, n_species: int | None = None) -> DataFrame:
    """Openings and closures per street between two registry cuts, on folded (name, street).

    ``species`` gives all matching categories of a business name. Streets that only lose businesses are left
    out, as in the published series.
    """
    def keyed(df):
        return df.withColumn("_k1", text.ascii_upper(F.col(name))).withColumn("_k2", text.ascii_upper(F.col(street)))

    a, b = keyed(new), keyed(old)
    opened = only_in(a, b, ["_k1", "_k2"]).withColumn("_sp", species)
    closed = only_in(b, a, ["_k1", "_k2"]).groupBy(street).agg(F.count("*").alias("closures"))
    per = opened.groupBy(street).agg(
        F.count("*").alias("openings"),
        F.sum((F.size("_sp") > 0).cast("bigint")).alias("indicators"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_sp")))).alias("_s"),  # bounded by the catalogue
    )
    return (
        per.join(closed, street, "left")
        .fillna(0, ["closures"])
        .withColumn("species", F.when(F.size("_s") > 0, F.array_join("_s" if n_species is None else F.slice("_s", 1, n_species), ", ")).otherwise("—"))
        .drop("_s")
    )


def slug_candidates(df: DataFrame, key: str, candidates: list[Column], columns: list[str]) -> DataFrame:
    """Rows ``(key, slug, priority)`` of the candidate names in order; empty slugs drop out."""
    arr = F.array(*[F.struct(F.lit(i).alias("priority"), text.slug(c).alias("slug")) for i, c in enumerate(candidates)])
    return df.select(key, *columns, F.explode(arr).alias("_c")).select(key, *columns, "_c.*").filter(F.coalesce(F.col("slug"), F.lit("")) != "")


def slug_fallback_join(df: DataFrame, key: str, candidates: list[Column], registry: DataFrame, slug: str) -> DataFrame:
    """Match by the first candidate slug that exists in the registry (one row per registry slug)."""
    cand = slug_candidates(df, key, candidates, [])
    hits = cand.join(registry.withColumnRenamed(slug, "slug"), "slug")
    fields = [c for c in hits.columns if c not in (key, "priority")]
    best = hits.groupBy(key).agg(F.min_by(F.struct("priority", *fields), F.col("priority")).alias("_b")).select(key, "_b.*")
    return df.join(best, key, "left")


def resolve_entities(requests: DataFrame, request: str, names: DataFrame, name: str) -> DataFrame:
    """Official name for each requested name by a cascade of rules, or NULL.

    Rules in order: exact fold, without punctuation, same set of words, longer official name. The first rule
    with any candidate decides, and only when it leaves exactly one; otherwise nothing is chosen. Each rule is
    an equi-join on its own key: the last one on every proper word prefix and suffix of the official name.
    """
    req = requests.select(F.col(request).alias("request")).distinct().withColumn("_w", text.words(F.col("request")))
    off = names.select(F.col(name).alias("official")).filter("official is not null").distinct().withColumn("_w", text.words(F.col("official")))

    def bag(w: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(w)), " ")

    def joined(w: Column) -> Column:
        return F.array_join(w, " ")

    n = F.size("_w")
    cuts = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    affixes = F.array_distinct(
        F.concat(
            F.transform(cuts, lambda k: joined(F.slice(F.col("_w"), 1, k))),
            F.transform(cuts, lambda k: joined(F.slice(F.col("_w"), k + 1, F.size("_w")))),
        )
    )
    entry = lambda r, k: F.struct(F.lit(r).alias("rule"), k.alias("k"))
    asked = req.select(
        "request",
        F.explode(
            F.array(
                entry(1, text.ascii_upper(F.col("request"))),
                entry(2, joined(F.col("_w"))),
                entry(3, bag(F.col("_w"))),
                entry(4, joined(F.col("_w"))),
            )
        ).alias("e"),
    ).select("request", "e.*")
    offered = off.select(
        "official",
        F.explode(
            F.concat(
                F.array(
                    entry(1, text.ascii_upper(F.col("official"))),
                    entry(2, joined(F.col("_w"))),
                    entry(3, bag(F.col("_w"))),
                ),
                F.transform(affixes, lambda a: F.struct(F.lit(4).alias("rule"), a.alias("k"))),
            )
        ).alias("e"),
    ).select("official", "e.*")
    # candidates are counted per key before the join, so a common prefix never pairs with all its names
    per_key = offered.groupBy("rule", "k").agg(F.count("*").alias("candidates"), F.min("official").alias("official"))
    found = asked.join(per_key, ["rule", "k"])
    first = found.groupBy("request").agg(F.min_by(F.struct("rule", "candidates", "official"), F.col("rule")).alias("_f"))
    one = F.col("_f")["candidates"] == 1
    return (
        req.select("request")
        .join(first, "request", "left")
        .select(
            "request",
            F.when(one, F.col("_f")["official"]).alias("official"),
            F.col("_f")["rule"].alias("rule"),
            F.coalesce(F.col("_f")["candidates"], F.lit(0)).alias("candidates"),
        )
    )


GRAM = 3  # characters of a key in the containment join


def grams(c: Column, shortest: int = 1) -> Column:
    """The distinct pieces of ``shortest`` to ``GRAM`` characters: fewer than ``GRAM`` a character."""
    n = F.length(c)
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(c, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(k) for k in range(shortest, GRAM + 1)]))


def containing(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs ``text, part`` of the distinct values of two one-column tables where the text holds the part.

    Each part is looked up by one key, the rarest in the texts of its pieces of ``GRAM`` characters (itself if it is shorter),
    and each text lies under all its pieces; so rows grow with the length of the names, and a common piece is the key of a
    part only if all others are as common. Nulls and empty parts are in no text.
    """
    t = texts.toDF("text").filter("text <> ''").distinct().select("text", F.explode(grams(F.col("text"))).alias("gram"))
    keys = F.when(F.length("part") > GRAM, grams(F.col("part"), GRAM)).otherwise(F.array("part"))
    p = parts.toDF("part").filter("part <> ''").distinct().select("part", F.explode(keys).alias("gram"))
    found = p.join(t.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left")
    rarest = found.groupBy("part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("k")).filter("k.n > 0")
    return t.join(rarest.select("part", F.col("k.gram").alias("gram")), "gram").filter(F.contains("text", "part")).select("text", "part")


def partial_name_join(zones: DataFrame, monitor: DataFrame, totals: list[Column] | None = None) -> DataFrame:
    """Monitor rows of each zone ``(zone, mun, ent)``: exact municipality, else a partial one.

    A state matches when either text contains the other; ``mun='*'`` takes every municipality of a state whose
    text contains the zone's. Containment is a join of the distinct names by their rarest pieces.
    With ``totals`` (named aggregates of monitor rows) a zone gets one row per name and, for ``mun='*'``, one per whole state,
    each with the totals of its rows; such a zone's municipalities are never listed.
    """
    if totals is not None:
        of_state = monitor.filter("mun is not null").groupBy("ent").agg(*totals)
        monitor = monitor.groupBy("mun", "ent").agg(*totals)
    z = zones.select("zone", F.col("mun").alias("z_mun"), F.col("ent").alias("z_ent"))
    names = monitor.select("mun", "ent") if totals is not None else monitor.select("mun", "ent").distinct()
    ents = names.select("ent").distinct()
    held = containing(ents, z.select("z_ent")).toDF("ent", "z_ent").join(z, "z_ent").select("zone", "z_mun", "ent", F.lit(True).alias("held"))
    holds = containing(z.select("z_ent"), ents).toDF("z_ent", "ent").join(z, "z_ent").select("zone", "z_mun", "ent", F.lit(False).alias("held"))
    states = held.unionByName(holds).groupBy("zone", "z_mun", "ent").agg(F.max("held").alias("held"))
    starred = states.filter((F.col("z_mun") == "*") & F.col("held"))
    inside = containing(names.select("mun"), z.select("z_mun")).toDF("mun", "z_mun")
    named = names.join(inside, "mun").join(states, ["ent", "z_mun"]).select(
        "zone", "mun", "ent", F.when(F.col("mun") == F.col("z_mun"), 1).otherwise(2).alias("rule")
    )
    if totals is None:
        hits = named.unionByName(names.join(starred, "ent").select("zone", "mun", "ent", F.lit(1).alias("rule")))
        best = hits.groupBy("zone").agg(F.min("rule").alias("rule"))
        return monitor.join(hits.join(best, ["zone", "rule"]).select("zone", "mun", "ent"), ["mun", "ent"])
    whole = starred.filter("zone is not null").select("zone", "ent")  # a match by the first rule
    best = named.select("zone", "rule").unionByName(whole.select("zone", F.lit(1).alias("rule"))).groupBy("zone").agg(F.min("rule").alias("rule"))
    listed = monitor.join(named.join(best, ["zone", "rule"]).select("zone", "mun", "ent"), ["mun", "ent"])
    return listed.unionByName(of_state.join(whole, "ent").withColumn("mun", F.lit("*")).select(*listed.columns))


def canonical_name(c: Column, names: list[str], aliases: dict[str, str] | None = None) -> Column:
    """Canonical entry for a folded name: alias, exact, else the prefix relative closest in length."""
    alias = F.create_map(*[F.lit(x) for kv in (aliases or {"": ""}).items() for x in kv])
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(names)])

    def closest(known: Column) -> Column:
        related = F.filter(table, lambda e: F.startswith(e["n"], known) | F.startswith(known, e["n"]))
        return F.array_min(F.transform(related, lambda e: F.struct(F.abs(F.length(e["n"]) - F.length(known)).alias("d"), e["i"].alias("i"), e["n"].alias("n"))))["n"]

    # the folded name is worked out once and not for each entry
    return once(c, lambda x: F.when(F.coalesce(x, F.lit("")) != "", once(F.coalesce(F.try_element_at(alias, x), x), closest)))


def complete_with_zero(base: DataFrame, keys: list[str], column: str, values: list[str], counts: DataFrame, measure: str) -> DataFrame:
    """Every (key, value) combination with its count, absent ones 0; the value list is a fixed catalogue."""
    full = base.withColumn(column, F.explode(F.array(*[F.lit(v) for v in values])))
    return full.join(counts, [*keys, column], "left").fillna(0, [measure])


def before_after(df: DataFrame, keys: list[str], before: Column, measures: tuple[str, str] = ("before", "after")) -> DataFrame:
    """Row counts on both sides of a condition per key; one aggregate replaces the outer join of two counts."""
    return df.groupBy(*keys).agg(
        F.sum(before.cast("bigint")).alias(measures[0]), F.sum((~before).cast("bigint")).alias(measures[1])
    )


def merge_registries(parts: list[DataFrame], slug: str, order: str) -> DataFrame:
    """Union in priority order, first row per slug wins; empty slugs drop out."""
    out = None
    for i, p in enumerate(parts):
        tagged = p.withColumn("_prio", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return keep_first(out.filter(F.coalesce(F.col(slug), F.lit("")) != ""), [slug], ["_prio", order]).drop("_prio")


def track_listings(listings: DataFrame, tracker: DataFrame, keys: list[str]) -> DataFrame:
    """Days listed, whether the start is censored, and the price cut in percent since the first change.

    ``tracker(keys, base, act, first_seen, price, changes array<struct<at,from,to>>)``.
    """
    first = F.try_element_at("changes", F.lit(1))
    cut = F.when(first["from"] > 0, F.floor((F.col("t_price") / first["from"] - 1.0) * 100.0 + 0.5))
    joined = listings.join(tracker.withColumnRenamed("price", "t_price"), keys, "left")
    return joined.withColumn(
        "days_listed", F.when(F.col("first_seen").isNotNull(), F.greatest(F.datediff("act", "first_seen"), F.lit(0)))
    ).withColumn("censored", F.col("first_seen") == F.col("base")).withColumn("cut_pct", cut).drop("t_price", "base", "act", "first_seen", "changes")


def rank_sources(exact: DataFrame, municipal: DataFrame, code: str, quality: str, position: str) -> DataFrame:
    """Postal points: an exact source beats a municipal one; higher quality, then the later row wins."""
    both = exact.withColumn("precision", F.lit(0)).unionByName(municipal.withColumn("precision", F.lit(1)))
    rank = F.struct(-F.col("precision"), F.col(quality), F.col(position))
    return both.groupBy(code).agg(F.max_by(F.struct("lat", "lng", "precision"), rank).alias("_p")).select(code, "_p.*")


def coverage_plan(registry: DataFrame, existing: DataFrame, minimum: int, cap: int, entity_codes: Column) -> DataFrame:
    """Which towns to load next: largest inventory first, known states only, one town per suffix.

    ``registry(name 'Town, State', n)``; ``existing(suffix)``. The cap is the size of the plan, not of the data.
    """
    parts = registry.filter(F.col("name").contains(",") & (F.col("n") >= minimum))
    town = F.trim(F.substring_index("name", ",", 1))
    state = F.trim(F.expr("substring(name, instr(name, ',') + 1)"))
    named = parts.select("name", "n", town.alias("town"), state.alias("state"))
    options = F.filter(F.transform(F.split("town", "/"), lambda t: F.trim(t)), lambda t: t != "")
    suffixes = F.transform(F.when(F.size(options) > 0, options).otherwise(F.array(F.col("town"))), lambda t: F.regexp_replace(text.slug(t), "-", "_"))
    cand = named.withColumn("suffixes", suffixes).withColumn("state_code", entity_codes).withColumn("suffix", F.col("suffixes")[0])
    taken = (
        cand.select("name", F.explode("suffixes").alias("suffix"))
        .join(existing.select("suffix").distinct(), "suffix", "left_semi")
        .select("name")
        .distinct()
    )
    open_towns = cand.join(taken, "name", "left_anti").filter(F.col("state_code").isNotNull())
    one = keep_first(open_towns.drop("suffixes"), ["suffix"], [-F.col("n"), "name"])
    return one.orderBy(F.col("n").desc(), "name").limit(cap)
