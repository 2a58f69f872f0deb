"""Posting identity: external id, content hash, fuzzy title; the ingest merge; order within a batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions.text import is_blank
from jobloom.sources.tables import stored

SIMILARITY = 0.85


def trigrams(c) -> Column:
    """Distinct trigrams of each word with two spaces before and one behind."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.col(c) if isinstance(c, str) else c), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, 3)))))


def set_similarity(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared, F.size(a) + F.size(b) - shared), F.lit(0.0))


def trigram_similarity(a, b) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def match_external_id(new: DataFrame, jobs: DataFrame) -> DataFrame:
    """new with l1_id: the job of the same source and external id."""
    known = jobs.where("external_source is not null and external_job_id is not null").groupBy("external_source", "external_job_id").agg(F.min("id").alias("l1_id"))
    return new.join(known, ["external_source", "external_job_id"], "left")


def match_hash(new: DataFrame, jobs: DataFrame) -> DataFrame:
    """new with l2_id: the first job of the same content hash."""
    known = jobs.where("dedup_hash is not null").groupBy("dedup_hash").agg(F.min("id").alias("l2_id"))
    return new.join(known, "dedup_hash", "left")


def similar_titles(ours: DataFrame, theirs: DataFrame, block: list[str], least: float, hot: int = 20_000) -> DataFrame:
    """block, title, other and like of pairs of titles (block, title) whose trigram sets have a similarity of
    least. Both sides hold distinct titles.

    Sets of n >= m trigrams are only that similar if one of the first n - least * n + 1 trigrams of the larger is
    among the first m - 2 least / (1 + least) * m + 1 of the smaller, in any one order of all trigrams; the rarest of
    the block come first. So titles meet on the block and such a trigram, the larger one of either side with the
    smaller one of the other. Where they meet first, what follows in both must suffice for the overlap that they
    need; the join tests that, so pairs that share only what all titles of a block have in common never come out.
    Trigrams that more than `hot` titles of a block have are dealt over several keys.
    """
    # Both joins read the distinct titles with their trigrams, which are few beside the rows that they come from.
    both = ours.select(*block, "title", F.lit(True).alias("_ours"))
    both = both if theirs is ours else both.unionByName(theirs.select(*block, "title", F.lit(False).alias("_ours")))
    dealt = both.select(*block, "title", "_ours", F.explode(trigrams("title")).alias("_gram"))
    counted = dealt.groupBy(*block, "_gram").agg(F.count("*").alias("_often"))
    grams = F.sort_array(F.collect_list(F.struct("_often", "_gram"))).alias("_grams")
    both = stored(ours.sparkSession, dealt.join(counted, [*block, "_gram"]).groupBy(*block, "title", "_ours").agg(grams), "title-grams")
    mine, others = both.where("_ours"), both if theirs is ours else both.where("not _ours")

    def firsts(df: DataFrame, share: float, probe: bool, name: str) -> DataFrame:
        n = F.size("_grams")
        long = (n - F.ceil(share * n - 1e-9) + 1).cast("int")
        out = df.select(*block, F.col("title").alias(name), F.col("_grams")["_gram"].alias(f"_{name}s"), n.alias(f"_{name}_n"), F.posexplode(F.slice("_grams", 1, long)).alias(f"_{name}_at", "_first"))
        parts = F.ceil(F.col("_first._often") / hot).cast("int")
        part = F.pmod(F.xxhash64(name), parts).cast("int") if probe else F.explode(F.sequence(F.lit(0), parts - 1))
        return out.withColumn("_gram", F.col("_first._gram")).withColumn("_part", part).drop("_first")

    def met(probe_ours: bool) -> DataFrame:
        a = firsts(mine, least if probe_ours else 2 * least / (1 + least), probe_ours, "title")
        b = firsts(others, 2 * least / (1 + least) if probe_ours else least, not probe_ours, "other")
        n, m = F.col("_title_n"), F.col("_other_n")
        need = F.ceil(least / (1 + least) * (n + m) - 1e-9)
        fits = (n >= m) & (m >= least * n - 1e-9) if probe_ours else (m > n) & (n >= least * m - 1e-9)
        enough = F.least(n - F.col("_title_at"), m - F.col("_other_at")) >= need
        return a.join(b, [*block, "_gram", "_part"]).where(fits & enough).select(*block, "title", "other", set_similarity(F.col("_titles"), F.col("_others")).alias("like")).where(F.col("like") >= least)

    return met(True).unionByName(met(False)).dropDuplicates([*block, "title", "other"])


def match_fuzzy(new: DataFrame, jobs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """new (key) with l3_id: the most similar title among active jobs of the same company and city, of equally
    similar ones the smallest id. Distinct titles of a block are compared, not rows."""
    names = {"_company": F.lower("normalized_company_name"), "_city": F.lower("city"), "_title": F.col("normalized_title")}
    block = ["_company", "_city"]
    full = "_company is not null and _city is not null and _title is not null"
    title = F.col("_title").alias("title")
    ours = new.select(*[c.alias(k) for k, c in names.items()]).where(full).select(*block, title).distinct()
    theirs = jobs.where("is_active").select("id", *[c.alias(k) for k, c in names.items()]).where(full).groupBy(*block, title).agg(F.min("id").alias("id"))
    near = similar_titles(ours, theirs.drop("id"), block, least).join(theirs.withColumnRenamed("title", "other"), [*block, "other"])
    best = near.groupBy(*block, "title").agg(F.min(F.struct(-F.col("like"), F.col("id").alias("id"))).alias("_best"))
    best = best.select(*block, F.col("title").alias("_title"), F.col("_best.id").alias("l3_id"))
    return new.join(best, [c == F.col(k) for k, c in names.items()], "left").drop(*names)


def resolve(new: DataFrame, jobs: DataFrame) -> DataFrame:
    """new with match_id and dedup_level (L1, L2, L3 or NONE); the cheapest level that hits decides."""
    found = match_fuzzy(match_hash(match_external_id(new, jobs), jobs), jobs)
    level = F.when(F.col("l1_id").isNotNull(), "L1").when(F.col("l2_id").isNotNull(), "L2").when(F.col("l3_id").isNotNull(), "L3").otherwise("NONE")
    return found.withColumn("dedup_level", level).withColumn("match_id", F.coalesce("l1_id", "l2_id", "l3_id")).drop("l1_id", "l2_id", "l3_id")


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row with the smallest order columns for each key; it is found before the shuffle already, so a hot
    key is no hot task."""
    first = df.groupBy(*key).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_first"))
    return first.select("_first.*")


def upsert_postings(jobs: DataFrame, resolved: DataFrame, as_of, extend_expiry: bool = False) -> DataFrame:
    """The job table after a batch: matched jobs are active again, seen, counted and take the last non-blank
    apply_url, publisher and easy-apply mark; the other rows are new jobs. expires_at stays unless asked."""
    last = lambda c, keep: F.max_by(c, F.when(keep, F.col("seq")))
    hits = resolved.where("match_id is not null").groupBy(F.col("match_id").alias("id")).agg(
        F.count("*").alias("_n"), last("apply_url", ~is_blank("apply_url")).alias("_apply_url"), last("publisher", F.col("publisher").isNotNull()).alias("_publisher"),
        last("linkedin_easy_apply", F.col("linkedin_easy_apply").isNotNull()).alias("_easy"),
    )
    now, hit = F.lit(as_of).cast("timestamp"), F.col("_n").isNotNull()
    joined = jobs.join(hits, "id", "left")
    updates = {
        "is_active": F.col("is_active") | hit, "last_seen_at": F.when(hit, now).otherwise(F.col("last_seen_at")), "duplicate_source_count": (F.col("duplicate_source_count") + F.coalesce("_n", F.lit(0))).cast("int"),
        "apply_url": F.coalesce("_apply_url", "apply_url"), "publisher": F.coalesce("_publisher", "publisher"), "linkedin_easy_apply": F.coalesce("_easy", "linkedin_easy_apply"),
    }
    if extend_expiry:
        updates["expires_at"] = F.when(hit, now + F.expr("INTERVAL 30 DAYS")).otherwise(F.col("expires_at"))
    updated = joined.withColumns(updates).select(jobs.columns)
    return updated.unionByName(resolved.where("match_id is null").select(jobs.columns))


def _kept_here(rows: list[tuple[int, list[str]]], near: dict[str, list[str]]) -> list[int]:
    """The kept ones of rows (seq, keys) in the order of seq: those that no earlier kept row shares a key with,
    nor has a title near theirs."""
    taken: set[str] = set()
    kept = []
    for seq, keys in sorted(rows):
        if not any(k in taken or any(x in taken for x in near.get(k, ())) for k in keys):
            kept.append(seq)
            taken.update(keys)
    return kept


_KINDS = ("_id", "_hash", "_named")
_BLOCK = ["_company", "_city"]


def _row_keys(rows: DataFrame, *keep: str) -> DataFrame:
    """keep, the block and title of each row, and its keys: id, hash and title within the block. Null ids and hashes
    match nothing, nor do titles without company, city or letters."""
    text = lambda kind, *c: F.when(F.forall(F.array(*c), lambda x: x.isNotNull()), F.concat_ws("\x1f", F.lit(kind), *c))
    title = F.when(F.size(trigrams("normalized_title")) > 0, F.col("normalized_title"))
    out = rows.select(*keep, F.lower("normalized_company_name").alias("_company"), F.lower("city").alias("_city"), title.alias("title"), F.col("external_source").cast("string").alias("_source"), F.col("external_job_id").cast("string").alias("_job"), "dedup_hash")
    return out.select(*keep, *_BLOCK, "title", text("id", F.coalesce("_source", F.lit("")), F.col("_job")).alias("_id"), text("hash", F.col("dedup_hash")).alias("_hash"), text("title", *map(F.col, _BLOCK), F.col("title")).alias("_named"))


_TITLE_KEY = lambda c: F.concat_ws("\x1f", F.lit("title"), *_BLOCK, c)


def _titles(rows: DataFrame) -> DataFrame:
    return rows.where("_named is not null").select(*_BLOCK, "title").distinct()


def _unmatched(rows: DataFrame, leaders: DataFrame, least: float) -> DataFrame:
    """rows that share no key with a leader and whose title is near none of an active one's."""
    for k in ("_id", "_hash"):
        rows = rows.join(leaders.where(f"{k} is not null").select(k).distinct(), k, "left_anti")
    near = similar_titles(_titles(rows), _titles(leaders.where("_active")), _BLOCK, least)
    return rows.join(near.select(_TITLE_KEY("title").alias("_named")).distinct(), "_named", "left_anti")


def _leaders_of_chunk(rows: DataFrame, least: float, small: int) -> DataFrame:
    """seq of the rows (seq, keys) that are kept when they are taken in the order of seq, in rounds: every undecided
    row that is the earliest under all its keys, near titles included, is kept, and all that match a newly kept row
    are settled; each round settles the earliest undecided row at least. Only minima per key are exchanged."""
    spark = rows.sparkSession
    titles = _titles(rows)
    near = similar_titles(titles, titles, _BLOCK, least).where("title <> other").select(_TITLE_KEY("title").alias("key"), _TITLE_KEY("other").alias("other"))
    near = stored(spark, near, "batch-titles")
    open_ = stored(spark, rows.select("seq", F.explode(F.array_compact(F.array(*_KINDS))).alias("key")), "batch-keys")
    kept, close = [], near
    while True:
        # At most `small` rows of both.
        some = open_.limit(small + 1).collect()
        pairs = close.select("key", "other").limit(small + 1 - len(some)).collect() if len(some) <= small else []
        if len(some) + len(pairs) <= small:
            own: dict[int, list[str]] = {}
            for r in some:
                own.setdefault(r["seq"], []).append(r["key"])
            by: dict[str, list[str]] = {}
            for r in pairs:
                by.setdefault(r["key"], []).append(r["other"])
            kept.append(spark.createDataFrame([(s,) for s in _kept_here(list(own.items()), by)], "seq long"))
            return reduce(DataFrame.unionByName, kept)
        low = open_.groupBy("key").agg(F.min("seq").alias("low"))
        beside = close.join(low.withColumnRenamed("key", "other"), "other").select("key", "low")
        low = low.unionByName(beside).groupBy("key").agg(F.min("low").alias("low"))
        lead = open_.join(low, "key").groupBy("seq").agg((F.min("low") >= F.col("seq")).alias("lead")).where("lead").select("seq")
        lead = stored(spark, lead, "batch-leaders")
        kept.append(lead)
        taken = open_.join(lead, "seq", "left_semi").select("key").distinct()
        taken = taken.unionByName(close.join(taken, "key", "left_semi").select(F.col("other").alias("key"))).distinct()
        gone = open_.join(taken, "key", "left_semi").select("seq").distinct()
        open_ = stored(spark, open_.join(gone, "seq", "left_anti"), "batch-keys")
        close = near.join(open_.select("key").distinct(), "key", "left_semi").join(open_.select(F.col("key").alias("other")).distinct(), "other", "left_semi")


def resolve_batch(batch: DataFrame, jobs: DataFrame | None = None, least: float = SIMILARITY, small: int = 20_000, first: int = 1024, growth: int = 8) -> DataFrame:
    """seq, job, leader and level of each row of a batch whose rows are taken in the order of seq after the table
    jobs: a row that matches a job or an earlier kept row by id (L1), hash (L2) or title within company and city (L3,
    the most similar, of equally similar ones the job with the smallest id, then the earliest row) is counted on it,
    and its own keys are not kept; the others are kept and lead themselves (NONE). L3 looks at active jobs only.
    So resolving a stream batch by batch, each against the table that the last one left, gives what one fold over all
    rows gives, however they were cut.

    Rows are first reduced to the earliest of equal keys, so copies don't count. Chunks of growing size (the first
    `first` rows in the order of seq, then `growth` times as many, and so on) are settled one after the other: what
    matches a leader found so far is dropped, and only the rest of a chunk is compared within itself. Titles of one
    kind, however many, thus meet the few leaders of their kind instead of each other. A chunk is settled in rounds;
    when at most `small` keys and near titles of it are left, they are settled in one go in the order of seq, which
    gives the same rows and bounds the rounds that long chains of single matches would take.
    """
    spark = batch.sparkSession
    rows = stored(spark, _row_keys(batch.withColumn("seq", F.col("seq").cast("long")), "seq"), "batch-rows")
    empty = spark.createDataFrame([], "id long, is_active boolean, normalized_company_name string, city string, normalized_title string, external_source string, external_job_id string, dedup_hash string")
    table = (empty if jobs is None else jobs).withColumns({"job": F.col("id").cast("long"), "_active": F.coalesce("is_active", F.lit(True))})
    table = _row_keys(table, "job", "_active").withColumn("seq", F.lit(None).cast("long"))
    has_leaders = jobs is not None and not jobs.isEmpty()
    leaders = stored(spark, table, "batch-jobs") if has_leaders else table
    keyless = " and ".join(f"{k} is null" for k in _KINDS)
    open_ = stored(spark, rows.where(f"not ({keyless})").groupBy(*_KINDS).agg(F.min("seq").alias("seq"), *(F.first(c).alias(c) for c in (*_BLOCK, "title"))), "batch-first")
    n, cuts, size = open_.count(), [], first
    while size < n:
        cuts.append(size / n)
        size += size * growth
    edges = [None, *(open_.approxQuantile("seq", cuts, 1e-4) if cuts else []), None]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        chunk = open_
        if low is not None:
            chunk = chunk.where(F.col("seq") > int(low))
        if high is not None:
            chunk = chunk.where(F.col("seq") <= int(high))
        if has_leaders:
            chunk = stored(spark, _unmatched(chunk, leaders, least), "batch-chunk")
        found = chunk.join(_leaders_of_chunk(chunk, least, small), "seq", "left_semi").withColumns({"job": F.lit(None).cast("long"), "_active": F.lit(True)})
        found = stored(spark, found.select(*leaders.columns), "batch-kept")
        leaders, has_leaders = leaders.unionByName(found) if has_leaders else found, True
    keyless = rows.where(keyless).select("seq")
    return _counted_on(rows, leaders, keyless, least)


def _counted_on(rows: DataFrame, leaders: DataFrame, keyless: DataFrame, least: float) -> DataFrame:
    """The leader of each row: of jobs with equal keys the one with the smallest id; of kept rows each key has one."""
    spark = rows.sparkSession
    is_kept = leaders.where("seq is not null").select(F.col("seq").alias("_kept")).unionByName(keyless.select(F.col("seq").alias("_kept")))
    # Places of jobs and kept rows in one order: jobs by id, then rows by seq.
    place = F.struct(F.col("seq").isNotNull().alias("new"), F.coalesce("job", "seq").alias("at"))

    def by(k: str, name: str) -> DataFrame:
        return leaders.where(f"{k} is not null").groupBy(k).agg(F.min(place).alias(name))

    titled = leaders.where("_active and _named is not null").select(*_BLOCK, "title", F.col("_named").alias("other"), place.alias("place"))
    jobs_by_title = titled.groupBy("other", "place.new").agg(F.min("place").alias("place"))
    near = similar_titles(_titles(rows), titled.select(*_BLOCK, "title").distinct(), _BLOCK, least).select(_TITLE_KEY("title").alias("_named"), _TITLE_KEY("other").alias("other"), "like")
    near = near.join(jobs_by_title, "other").groupBy("_named").agg(F.collect_list(F.struct((-F.col("like")).alias("unlike"), "place")).alias("_near"))
    found = rows.join(by("_id", "_l1"), "_id", "left").join(by("_hash", "_l2"), "_hash", "left").join(near, "_named", "left")
    found = stored(spark, found.join(is_kept, F.col("seq") == F.col("_kept"), "left"), "batch-found")
    before = lambda p: ~p["new"] | (p["at"] < F.col("seq"))
    l1, l2 = (F.when(before(F.col(x)), F.col(x)) for x in ("_l1", "_l2"))
    l3 = F.array_min(F.filter("_near", lambda x: before(x["place"])))["place"]
    level = F.when(F.col("_kept").isNotNull(), "NONE").when(l1.isNotNull(), "L1").when(l2.isNotNull(), "L2").otherwise("L3")
    best = F.when(F.col("_kept").isNull(), F.coalesce(l1, l2, l3))
    return found.select("seq", level.alias("level"), best.alias("_best"), "_kept").select("seq", F.when(~F.col("_best.new"), F.col("_best.at")).alias("job"), F.coalesce("_kept", F.when(F.col("_best.new"), F.col("_best.at"))).alias("leader"), "level")


def apply_url_exists(new: DataFrame, jobs: DataFrame) -> DataFrame:
    return new.join(jobs.select("apply_url").where("apply_url is not null"), "apply_url", "left_semi")


def linkedin_known(new: DataFrame, jobs: DataFrame) -> DataFrame:
    """new whose LinkedIn id is that of an active job; ids are compared whole."""
    from jobloom.functions.text import linkedin_job_id

    known = jobs.where("is_active").select(linkedin_job_id("linkedin_url").alias("_id")).where("_id is not null")
    return new.withColumn("_id", linkedin_job_id("linkedin_url")).join(known, "_id", "left_semi").drop("_id")


def _place(spark: SparkSession, rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """rows with _place: their place, from 1 on, among the rows of one key in that order. Places come from a sort by
    ranges of key and order, so a key with many rows is spread over tasks; one count a range reaches the driver."""
    sort = [*key, *order]
    ranged = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_row", F.monotonically_increasing_id())
    kept = stored(spark, ranged, "places")
    part, row = F.shiftrightunsigned("_row", 33), F.col("_row").bitwiseAND((1 << 33) - 1)
    counts = sorted((r["part"], r["n"]) for r in kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    base, bases = 0, []
    for p, n in counts:
        bases.append((p, base))
        base += n
    numbered = kept.join(F.broadcast(spark.createDataFrame(bases, "_part long, _base long")), part == F.col("_part")).withColumn("_place", F.col("_base") + row)
    first = stored(spark, numbered.groupBy(*key).agg(F.min("_place").alias("_first")), "places-first")
    return numbered.join(first, key).withColumn("_place", F.col("_place") - F.col("_first") + 1).drop("_row", "_part", "_base", "_first")


def assign_unique_slugs(new: DataFrame, taken: DataFrame) -> DataFrame:
    """new (base, seq) with slug: base, base-1, base-2, ... in order of seq, passing over taken ones.

    The k-th row of a base gets the k-th free number: k - 1 plus the used numbers before it. The i-th used number u
    is before it if there are fewer than k free ones below u, that is u - (i - 1) < k. So used numbers are put among
    the rows by that count, and each row's place in the mixed order tells how many are before it."""
    spark = new.sparkSession
    number = r"^(.*?)(?:-(\d+))?$"
    used = taken.select(F.regexp_extract("slug", number, 1).alias("base"), F.regexp_extract("slug", number, 2).alias("n"))
    # A slug may be a base itself or a base with a number.
    used = used.select("base", F.when(F.col("n") == "", 0).otherwise(F.col("n").try_cast("long")).alias("n")).unionByName(taken.select(F.col("slug").alias("base"), F.lit(0).cast("long").alias("n"))).where("n is not null").distinct()
    used = used.join(new.select("base").distinct(), "base", "left_semi")
    own = F.struct(*new.columns).alias("_own")
    rows = new.select(F.lit(1).alias("_kind"), "base", F.col("seq").cast("long").alias("_n"), own)
    both = used.select(F.lit(0).alias("_kind"), "base", F.col("n").alias("_n"), F.lit(None).cast(rows.schema["_own"].dataType).alias("_own")).unionByName(rows)
    at = F.when(F.col("_kind") == 0, F.col("_n") - F.col("_place") + 1).otherwise(F.col("_place") - 1)
    mixed = _place(spark, both, ["_kind", "base"], ["_n"]).select("_kind", "base", at.alias("_at"), "_own")
    # With c used numbers before it the k-th row is at place k + c, and its number is k - 1 + c.
    placed = _place(spark, mixed, ["base"], ["_at", "_kind"]).where("_kind = 1").select("_own.*", (F.col("_place") - 1).alias("_free"))
    return placed.withColumn("slug", F.when(F.col("_free") == 0, F.col("base")).otherwise(F.concat_ws("-", "base", "_free"))).drop("_free")
