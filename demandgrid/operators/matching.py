"""Entity matching and set operations over names, places and record identities.

Fuzzy joins meet on equi-keys only: grid cells for distance, rare tokens for
names, rare runs of characters for containment.  Greedy one-to-one and keep-first rules
are evaluated in rounds that give exactly the result of the sequential walk.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from demandgrid.functions.exprs import EARTH_MILES_GRID, fenced
from demandgrid.functions.text import name_tokens, plain_name, token_jaccard
from demandgrid.operators.geo import within
from demandgrid.session import ensure_checkpoint_dir

C = F.col
# rows of connected groups that one task walks
WALK_ROWS = 1 << 20


def word_set(name: Column) -> Column:
    """Distinct lower-case words, split on whitespace only."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), r"\s+"), lambda t: t != "")))


def first_match(left: DataFrame, right: DataFrame, miles: float = 0.05, share: float = 0.5) -> DataFrame:
    """One-to-one pairs (l_id, r_id): each left row in id order takes the first
    unused right row that is near and named alike.

    ``left``: l_id, l_name, l_lat, l_lng; ``right`` likewise with r_.

    Rows with equal words at an equal spot form a group, and groups, not rows, are
    compared; groups with the same partners merge.  A group is known by 16 bytes, as pairs
    of groups are most of what is shuffled.  A pair of groups that match only
    each other pairs its members by rank, so a pile of copies costs no pairwise work.  The other
    groups are walked row by row, those that are connected in one task."""
    ensure_checkpoint_dir(left.sparkSession)

    def groups(df: DataFrame, p: str) -> DataFrame:
        placed = df.where(C(f"{p}_lat").isNotNull() & C(f"{p}_lng").isNotNull()).withColumn(f"{p}_w", word_set(C(f"{p}_name")))
        placed = placed.where(F.size(f"{p}_w") > 0)
        named = F.struct(C(f"{p}_w").alias("w"), C(f"{p}_lat").alias("lat"), C(f"{p}_lng").alias("lng"))
        return placed.withColumn(f"{p}_g", F.unhex(F.md5(F.to_json(named))))

    lrows, rrows = groups(left, "l"), groups(right, "r")
    lg = lrows.select("l_g", "l_w", "l_lat", "l_lng").dropDuplicates(["l_g"]).checkpoint()
    rg = rrows.select("r_g", "r_w", "r_lat", "r_lng").dropDuplicates(["r_g"]).checkpoint()
    near = within(lg, rg, ("l_lat", "l_lng"), ("r_lat", "r_lng"), miles, miles, EARTH_MILES_GRID)
    pairs = near.where(token_jaccard(C("l_w"), C("r_w")) >= share).select("l_g", "r_g").checkpoint()
    # groups that see the same partners are one group: piles of copies under several
    # names then pair by rank too.  Two passes, as merging one side can make the other alike
    for _ in range(2):
        for p, q in (("l_g", "r_g"), ("r_g", "l_g")):
            seen = F.unhex(F.md5(F.concat_ws(" ", F.count("*"), F.bit_xor(F.xxhash64(q)), F.bit_xor(F.xxhash64(q, F.lit(1))))))
            alike = pairs.groupBy(p).agg(seen.alias("_to")).checkpoint()
            pairs = pairs.join(alike, p).select(C("_to").alias(p), q).distinct().checkpoint()
            if p == "l_g":
                lrows = lrows.join(alike, "l_g").drop("l_g").withColumnRenamed("_to", "l_g")
            else:
                rrows = rrows.join(alike, "r_g").drop("r_g").withColumnRenamed("_to", "r_g")
    degree_l = pairs.groupBy("l_g").agg(F.count("*").alias("dl"))
    degree_r = pairs.groupBy("r_g").agg(F.count("*").alias("dr"))
    sized = pairs.join(degree_l, "l_g").join(degree_r, "r_g")
    alone = sized.where((C("dl") == 1) & (C("dr") == 1)).select("l_g", "r_g")
    lone = _rank_pairs(lrows.select("l_g", "l_id"), rrows.select("r_g", "r_id"), alone)
    mixed = sized.where((C("dl") > 1) | (C("dr") > 1)).select("l_g", "r_g")
    return lone.unionByName(_walked(lrows.select("l_g", "l_id"), rrows.select("r_g", "r_id"), mixed.checkpoint()))


def _walked(l: DataFrame, r: DataFrame, edges: DataFrame) -> DataFrame:
    """The sequential walk (l_id, r_id) over groups that overlap several others.

    Groups that are connected are walked in one task, row by row in id order, so copies
    cost one step each; connected groups of more than ``WALK_ROWS`` rows open up to pairs
    of rows and settle in rounds over all tasks."""
    l = l.where(C("l_id").isNotNull()).join(edges.select("l_g").distinct(), "l_g").distinct().checkpoint()
    r = r.where(C("r_id").isNotNull()).join(edges.select("r_g").distinct(), "r_g").distinct().checkpoint()
    # an id in several groups connects them
    node = lambda tag, c: F.concat(F.lit(tag), C(c).cast("string")).cast("binary")
    shared_l = l.join(l.groupBy("l_id").agg(F.count("*").alias("k")).where("k > 1"), "l_id").select("l_g", node("l", "l_id").alias("b"))
    shared_r = r.join(r.groupBy("r_id").agg(F.count("*").alias("k")).where("k > 1"), "r_id").select("r_g", node("r", "r_id").alias("b"))
    links = edges.select("l_g", C("r_g").alias("b")).unionByName(shared_l).unionByName(edges.join(shared_r, "r_g").select("l_g", "b"))
    of = _connected(links, "l_g", "b")
    placed = edges.join(of, "l_g").checkpoint()
    lp, rp = l.join(of, "l_g"), r.join(placed.select("r_g", "_c").distinct(), "r_g")
    sizes = lp.select("_c").unionByName(rp.select("_c")).unionByName(placed.select("_c")).groupBy("_c").agg(F.count("*").alias("k"))
    wide = sizes.where(C("k") > WALK_ROWS).select("_c").checkpoint()
    if not wide.isEmpty():
        taken = _settled(placed.join(wide, "_c").join(l, "l_g").join(r, "r_g").select("l_id", "r_id").checkpoint())
        placed, lp, rp = (x.join(wide, "_c", "left_anti") for x in (placed, lp, rp))
    none = {c: F.lit(None).cast(t) for df in (l, r) for c, t in df.dtypes}
    form = lambda df: df.select("_c", *[C(c) if c in df.columns else v.alias(c) for c, v in none.items()])
    kinds = {**dict(l.dtypes), **dict(r.dtypes)}
    rows = form(placed).unionByName(form(lp)).unionByName(form(rp))
    walked = rows.groupBy("_c").applyInArrow(_walk, f"l_id {kinds['l_id']}, r_id {kinds['r_id']}")
    return walked if wide.isEmpty() else walked.unionByName(taken)


def _walk(rows: pa.Table) -> pa.Table:
    """Each left row in id order takes the first unused right row of the groups that its own meet."""
    meets, left, queue = {}, {}, {}
    for lg, li, rg, ri in zip(*(rows.column(c).to_pylist() for c in ("l_g", "l_id", "r_g", "r_id"))):
        if li is None and ri is None:
            meets.setdefault(lg, []).append(rg)
        elif ri is None:
            left.setdefault(li, []).append(lg)
        else:
            queue.setdefault(rg, []).append(ri)
    for q in queue.values():
        q.sort(reverse=True)  # the first unused is the last
    used, pairs = set(), []
    for li in sorted(left):
        best = None
        for lg in left[li]:
            for rg in meets[lg]:
                q = queue[rg] if rg in queue else []
                while q and q[-1] in used:
                    q.pop()
                if q and (best is None or q[-1] < best):
                    best = q[-1]
                elif not q:
                    meets[lg] = [x for x in meets[lg] if queue.get(x)]
        if best is not None:
            used.add(best)
            pairs.append((li, best))
    kinds = [(c, rows.schema.field(c).type) for c in ("l_id", "r_id")]
    return pa.table({c: pa.array([p[k] for p in pairs], t) for k, (c, t) in enumerate(kinds)})


def _connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(a, _c): an equal ``_c`` for all ``a`` that are connected through ``b``.

    Every a joins the least one it shares a b with, and the smaller graph goes again; keys
    are hashes, so about half of a chain goes each time."""
    links = links.select(C(a).alias("_a"), C(b).alias("_b")).distinct().checkpoint()
    of = links.select(C("_a").alias(a), C("_a").alias("_c")).distinct().checkpoint()
    while True:
        least = links.groupBy("_b").agg(F.min("_a").alias("_m"))
        to = links.join(least, "_b").groupBy("_a").agg(F.min("_m").alias("_to")).checkpoint()
        if to.where(C("_a") != C("_to")).isEmpty():
            return of
        of = of.join(to, C("_c") == C("_a")).select(a, C("_to").alias("_c")).checkpoint()
        links = links.join(to, "_a").select(C("_to").alias("_a"), "_b").distinct().checkpoint()


def _settled(open_: DataFrame) -> DataFrame:
    """The walk over pairs of rows in rounds: a pair that comes first for both of its rows
    is taken, its rows leave, and the rest goes again."""
    taken = open_.limit(0)
    while not open_.isEmpty():
        first_l = open_.groupBy("l_id").agg(F.min("r_id").alias("r_id"))
        first_r = open_.groupBy("r_id").agg(F.min("l_id").alias("l_id"))
        new = first_l.join(first_r, ["l_id", "r_id"]).checkpoint()
        taken = taken.unionByName(new.select("l_id", "r_id"))
        open_ = open_.join(new.select("l_id"), "l_id", "left_anti").join(new.select("r_id"), "r_id", "left_anti").checkpoint()
    return taken


def _rank_pairs(l: DataFrame, r: DataFrame, pairs: DataFrame) -> DataFrame:
    """i-th left member with i-th right member of each matched pair of groups."""
    from demandgrid.operators.ranks import running_total

    a = running_total(l.join(pairs, "l_g"), [C("l_id")], F.lit(1).cast("bigint"), "_i", ["l_g"])
    b = running_total(r.join(pairs, "r_g"), [C("r_id")], F.lit(1).cast("bigint"), "_i", ["r_g"])
    return a.select("l_g", "_i", "l_id").join(b.select("l_g", "_i", "r_id"), ["l_g", "_i"]).select("l_id", "r_id")


def near_duplicates(df: DataFrame, key: str, name: str, share: float = 0.6) -> DataFrame:
    """(key, keeper): the earliest kept row whose words overlap enough, else itself.

    Equal word sets collapse first.  Two sets that overlap by ``share`` must have a
    word in common among their rarest few, so each set is indexed under those only
    (prefix filtering); frequent words never gather rows."""
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.select(C(key).alias("k"), word_set(C(name)).alias("w"))
    sets = rows.where(F.size("w") > 0).groupBy("w").agg(F.min("k").alias("pos"))
    sets = sets.withColumn("sid", F.md5(F.array_join("w", " ")))
    words = sets.select("sid", F.size("w").alias("n"), F.explode("w").alias("t"))
    rarity = words.groupBy("t").agg(F.count("*").alias("df"))
    ordered = words.join(rarity, "t").groupBy("sid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("ts"))
    keep = C("n") - F.ceil(F.lit(share) * C("n")).cast("int") + 1
    index = ordered.select("sid", "n", F.posexplode(F.slice(F.transform("ts", lambda s: s["t"]), F.lit(1), keep)).alias("j", "t"))
    other = index.select(C("sid").alias("sid2"), C("n").alias("n2"), C("j").alias("j2"), "t")
    # sizes too different, or too few words left after the first shared one, cannot overlap enough
    room = (F.least("n", "n2") >= share * F.greatest("n", "n2") - 1e-9) & (F.least(C("n") - C("j"), C("n2") - C("j2")) >= share / (1 + share) * (C("n") + C("n2")) - 1e-9)
    cand = index.join(other, "t").where((C("sid") != C("sid2")) & room).select("sid", "sid2").distinct()
    a = sets.select("sid", "w", "pos")
    b = sets.select(C("sid").alias("sid2"), C("w").alias("w2"), C("pos").alias("pos2"))
    edges = cand.join(a, "sid").join(b, "sid2").where((token_jaccard(C("w"), C("w2")) >= share) & (C("pos2") < C("pos"))).select(
        "sid", "pos", "sid2", "pos2").checkpoint()
    open_ = sets.select("sid", "pos").checkpoint()
    live, kept = edges, None
    while not open_.isEmpty():
        new = open_.join(live.select("sid").distinct(), "sid", "left_anti").checkpoint()
        kept = new if kept is None else kept.unionByName(new)
        closed = live.join(new.select(C("sid").alias("sid2")), "sid2", "left_semi").select("sid").distinct()
        open_ = open_.join(new, "sid", "left_anti").join(closed, "sid", "left_anti").checkpoint()
        gone = new.select("sid").unionByName(closed)
        live = live.join(open_.select("sid"), "sid", "left_semi").join(gone.select(C("sid").alias("sid2")), "sid2", "left_anti").checkpoint()
    keepers = sets.select("sid", "pos").limit(0) if kept is None else kept
    first = edges.join(keepers.select(C("sid").alias("sid2")), "sid2", "left_semi").groupBy("sid").agg(F.min("pos2").alias("keeper"))
    own = keepers.select("sid", C("pos").alias("own"))
    lead = sets.join(own, "sid", "left").join(first, "sid", "left").select("w", F.coalesce("own", "keeper").alias("keeper"))
    out = rows.join(lead, "w", "left")
    return out.select(C("k").alias(key), F.coalesce("keeper", C("k")).alias("keeper"))


def merge_duplicates(df: DataFrame, links: DataFrame, key: str, fill: list[str], order: str) -> DataFrame:
    """Keeper rows with their empty fields filled from merged rows, first known wins;
    sources in order of first appearance (one already named is not named again), and
    ``contactable`` when the merged row has a phone or an address on the web."""
    j = df.join(links, key)
    first = lambda c: F.min_by(c, F.when(C(c).isNotNull() & (C(c) != ""), C(order)))
    agg = j.groupBy("keeper").agg(F.count("*").alias("merged"), *[first(c).alias(f"_{c}") for c in fill])
    seen = j.groupBy("keeper", "source").agg(F.min(order).alias("_o")).groupBy("keeper").agg(F.array_sort(F.collect_list(F.struct("_o", "source"))).alias("_s"))
    add = lambda acc, s: F.when(F.contains(acc, s["source"]), acc).when(acc == "", s["source"]).otherwise(F.concat(acc, F.lit("+"), s["source"]))
    sources = seen.select(C("keeper").alias("_k"), F.aggregate("_s", F.lit(""), add).alias("sources"))
    base = df.join(agg, C(key) == C("keeper")).join(sources, C("keeper") == C("_k"))
    has = lambda c: C(c).isNotNull() & (C(c) != "")
    filled = base.withColumns({c: F.when(has(c), C(c)).otherwise(C(f"_{c}")) for c in fill}).drop("keeper", "_k", *[f"_{c}" for c in fill])
    return filled.withColumn("contactable", F.coalesce(has("phone"), F.lit(False)) | F.coalesce(has("url"), F.lit(False)))


#: Characters of a key in the containment index; a shorter needle is its own key.
GRAM = 4


def _with_grams(df: DataFrame, text: str, sizes: Column) -> DataFrame:
    """A row per distinct run of characters of the given sizes in ``text``, as _g.

    Characters are split off once, so a text costs its length, however long it is."""
    cut = fenced(df.withColumns({"_ch": F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), "_sizes": sizes}), ["_ch", "_sizes"])
    runs = F.flatten(F.transform(F.filter("_sizes", lambda n: n <= F.size("_ch")), lambda n: F.transform(
        F.sequence(F.lit(1), F.size("_ch") - n + 1), lambda i: F.array_join(F.slice("_ch", i, n), ""))))
    return cut.select(*[c for c in df.columns if c != text], F.explode(F.array_distinct(runs)).alias("_g"))


def contained(long: DataFrame, long_text: str, short: DataFrame, short_text: str, gram: int = GRAM) -> DataFrame:
    """Pairs where the short text occurs inside the long one.

    An inverted index: every long text lists its distinct runs of ``gram`` characters
    (of needles' own size where they are shorter), each needle is looked up under the
    one of its runs that the fewest texts hold, and what meets there is verified.  A
    needle with a run that no text holds meets nothing."""
    ensure_checkpoint_dir(long.sparkSession)
    needles = short.where(F.length(short_text) > 0).select(C(short_text).alias("_st")).distinct()
    size = F.least(F.length("_st"), F.lit(gram))
    keys = _with_grams(needles.withColumn("_n", C("_st")), "_n", F.array(size)).checkpoint()
    sizes = needles.agg(F.collect_set(size).alias("s")).scalar()  # at most ``gram`` numbers
    # the hash only says where to look: a pair is verified on the texts themselves
    texts = long.where(C(long_text).isNotNull()).select(C(long_text).alias("_lt")).distinct().withColumn("_tid", F.xxhash64("_lt"))
    held = _with_grams(texts, "_lt", sizes).join(keys.select("_g").distinct(), "_g", "left_semi").checkpoint()
    spread = held.groupBy("_g").agg(F.count("*").alias("_df"))
    rarest = keys.join(spread, "_g", "left").groupBy("_st").agg(F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("_df"), "_g")).alias("_k"))
    met = rarest.where("_k._df > 0").select("_st", C("_k._g").alias("_g")).join(held, "_g").select("_tid", "_st").distinct()
    found = long.withColumn("_tid", F.xxhash64(long_text)).join(met, "_tid").where(F.contains(long_text, "_st"))
    return found.join(short, C("_st") == C(short_text)).drop("_tid", "_st")


def union_preferring(curated: DataFrame, live: DataFrame, url: str, order: str) -> DataFrame:
    """Curated rows plus live rows with a new address; blank addresses all stay."""
    norm = lambda df: df.withColumn("_u", F.lower(F.trim(F.coalesce(C(url), F.lit("")))))
    cur, liv = norm(curated), norm(live)
    fresh = liv.where(C("_u") != "").join(cur.where(C("_u") != "").select("_u").distinct(), "_u", "left_anti")
    # first live row per address as a hash aggregate (no window over copies)
    cols = [c for c in live.columns]
    firsts = fresh.groupBy("_u").agg(F.min_by(F.struct(*cols), C(order)).alias("r")).select("r.*")
    return curated.unionByName(firsts).unionByName(liv.where(C("_u") == "").select(*cols))


def distinct_places(df: DataFrame, key: str) -> DataFrame:
    """One row per place id; rows without an id all stay."""
    return df.where(C(key).isNotNull()).dropDuplicates([key]).unionByName(df.where(C(key).isNull()))


def first_per_value(df: DataFrame, value: str, position: str) -> DataFrame:
    """Ordered distinct: each value once, at its first position."""
    return df.groupBy(value).agg(F.min(position).alias(position))


def upsert(prior: DataFrame, fresh: DataFrame, keys: list[str], human: list[str], status: str = "outreach_status") -> DataFrame:
    """Refresh a lead store: fields people maintain survive, touched leads that
    discovery no longer finds stay, untouched ones leave."""
    fields = [c for c in fresh.columns if c not in keys]
    p = prior.select(*keys, F.lit(True).alias("_p"), *[C(c).alias(f"_p_{c}") for c in fields])
    f = fresh.select(*keys, F.lit(True).alias("_f"), *fields)
    j = f.join(p, keys, "full_outer")
    touched = F.coalesce(C(f"_p_{status}"), F.lit("")).isin("", "NEW")
    pick = {}
    for c in fields:
        known = C(f"_p_{c}").isNotNull() & (C(f"_p_{c}").cast("string") != "") & ((C(f"_p_{c}") != "NEW") if c == status else F.lit(True))
        mine = F.when(known, C(f"_p_{c}")).otherwise(C(c)) if c in human else C(c)
        pick[c] = F.when(C("_f"), mine).otherwise(C(f"_p_{c}"))
    return j.where(C("_f") | ~touched).select(*keys, *[v.alias(c) for c, v in pick.items()])


def append_unseen(log: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return log.unionByName(new.join(log.select(key), key, "left_anti"))


def centroid_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union by ZIP where the new coordinates win."""
    both = old.withColumn("_o", F.lit(1)).unionByName(new.withColumn("_o", F.lit(0)))
    return both.groupBy("zip").agg(F.min_by(F.struct("lat", "lng"), "_o").alias("r")).select("zip", "r.lat", "r.lng")


def missing_inputs(areas: DataFrame, key: str, inputs: dict[str, DataFrame]) -> DataFrame:
    """(area, input) for every manual input that has no row of that area: tasks to fill in."""
    present = None
    for name, df in inputs.items():
        rows = df.select(C(key), F.lit(name).alias("input"))
        present = rows if present is None else present.unionByName(rows)
    wanted = areas.select(key).distinct().withColumn("input", F.explode(F.array(*[F.lit(n) for n in inputs])))
    return wanted.join(present, [key, "input"], "left_anti")


def match_summary(right: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row over the second source (r_id, rating, reviews): matched and unmatched rows,
    mean rating and review total of the matched ones (NULL without any)."""
    both = right.join(pairs.select("r_id", F.lit(True).alias("_m")), "r_id", "left")
    hit = C("_m").isNotNull()
    reviews = F.sum(F.when(hit, C("reviews")))
    return both.agg(F.count_if(hit).alias("matched"), F.count_if(~hit).alias("right_only"), F.round(F.avg(F.when(hit, C("rating"))), 2).alias("avg_rating"),
                    F.when(reviews != 0, reviews).alias("total_reviews"))


def lookup_override(candidates: DataFrame, key: str, text: str, overrides: DataFrame, their_key: str, needle: str, position: str) -> DataFrame:
    """(candidate, position, matched_by): the first override row with the candidate's own
    key, else the first whose needle occurs in the candidate's joined text (lower-cased)."""
    exact = overrides.where(C(their_key).isNotNull()).groupBy(C(their_key).alias("_k")).agg(F.min(position).alias("_exact"))
    needles = overrides.select(C(position), F.trim(F.lower(needle)).alias("_n")).where(C("_n") != "").groupBy("_n").agg(F.min(position).alias(position))
    loose = contained(candidates.select(key, text), text, needles, "_n").groupBy(C(key).alias("_c")).agg(F.min(position).alias("_loose"))
    both = candidates.join(exact, C(key) == C("_k"), "left").join(loose, C(key) == C("_c"), "left")
    by = F.when(C("_exact").isNotNull(), "candidate_id").otherwise("address")
    return both.select(key, F.coalesce("_exact", "_loose").alias(position), by.alias("matched_by")).where(C(position).isNotNull())


def match_by_area_then_name(places: DataFrame, rows: DataFrame) -> DataFrame:
    """(loc, position): the first row of the place's own ZIP, else the first whose plain
    name holds the place's plain name or is held by it.

    ``places``: loc, zip, name; ``rows``: position, zip, name (plain names)."""
    area = rows.where(F.coalesce(C("zip"), F.lit("")) != "").groupBy("zip").agg(F.min("position").alias("_area"))
    names = rows.where(F.coalesce(C("name"), F.lit("")) != "").groupBy(C("name").alias("_rn")).agg(F.min("position").alias("position"))
    ours = places.where(F.coalesce(C("name"), F.lit("")) != "").select("loc", C("name").alias("_ln"))
    one = contained(ours, "_ln", names, "_rn").select("loc", "position")
    two = contained(names, "_rn", ours, "_ln").select("loc", "position")
    # an empty place name is held by every name, so the first row with a name counts
    bare = places.where(F.coalesce(C("name"), F.lit("")) == "").select("loc").withColumn("position", names.agg(F.min("position")).scalar())
    loose = one.unionByName(two).unionByName(bare).groupBy("loc").agg(F.min("position").alias("_loose"))
    return places.join(area, "zip", "left").join(loose, "loc", "left").select("loc", F.coalesce("_area", "_loose").alias("position")).where(C("position").isNotNull())


def lead_identity(id_: Column, name: Column, source: Column) -> Column:
    """The id of a stored lead, else its name and source."""
    known = F.coalesce(id_.cast("string"), F.lit(""))
    return F.when(known != "", known).otherwise(F.concat(F.coalesce(name, F.lit("")), F.lit("|"), F.coalesce(source, F.lit(""))))


def replace_filled(generated: DataFrame, filled: DataFrame, miles: float) -> DataFrame:
    """Rent rows after a merge: (row_id, filled_id).  Each generated row in id order is
    replaced by the first unused filled row at its place; the others stay blank, and
    filled rows without a place are kept.  ``generated``: row_id, lat, lng; ``filled``: filled_id, lat, lng."""
    one = F.lit("same")  # only the distance counts
    left = generated.select(C("row_id").alias("l_id"), one.alias("l_name"), C("lat").alias("l_lat"), C("lng").alias("l_lng"))
    right = filled.select(C("filled_id").alias("r_id"), one.alias("r_name"), C("lat").alias("r_lat"), C("lng").alias("r_lng"))
    pairs = first_match(left, right, miles).select(C("l_id").alias("row_id"), C("r_id").alias("filled_id"))
    kept = generated.select("row_id").join(pairs, "row_id", "left")
    return kept.unionByName(filled.select("filled_id").join(pairs, "filled_id", "left_anti").select(F.lit(None).cast("bigint").alias("row_id"), "filled_id"))
