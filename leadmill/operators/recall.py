"""Recall: web results and profile tables to candidates per query, merged, ranked and cut.

Keep-first always is ``row_number`` by an explicit order, never ``dropDuplicates``: the result is the same
for any partitioning. Filters on sites come before the windows, so portals with many pages never reach one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill import vocab
from leadmill.functions import text as T
from leadmill.operators.ranks import MOST, free, numbered
from leadmill.sources.io import stored
from leadmill.schemas import EVIDENCE


def keep_first(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order."""
    return top(df, keys, 1, *order)


def top(df: DataFrame, keys: Sequence[str], n: Column | int, *order: Column | str) -> DataFrame:
    """The first n rows of each key."""
    nth = free(df.columns, "nth")
    return df.withColumn(nth, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(nth) <= n).drop(nth)


#: Words that texts are compared with one by one, and words that are broadcast.
FEW, BROADCAST = 64, 500_000


def containing(texts: DataFrame, words: DataFrame, few: int = FEW, most: int = BROADCAST) -> DataFrame:
    """texts (pos, said) and words (word): the distinct (pos, word) of the words that a text contains.

    Up to ``few`` words are broadcast and compared with every text. More are found by an equi-join on one
    block of each: of its strings of three characters, or the whole word if it is shorter, the one in fewest
    texts, so no common block gathers rows; words with a block that no text has go at once. The blocks are
    broadcast up to ``most`` words and shuffled beyond. Texts are read again only where a block was met. A
    table in fewer files than there are cores is dealt to all of them first.
    """
    words = words.select("word").where("word <> ''").distinct()
    n = words.limit(max(few, most) + 1).count()
    if n <= few:
        return texts.join(F.broadcast(words), F.contains("said", F.col("word"))).select("pos", "word")
    cores = texts.sparkSession.sparkContext.defaultParallelism
    texts = texts.repartition(cores, "pos") if len(texts.inputFiles()) < cores else texts
    small = F.broadcast if n <= most else (lambda df: df)
    sizes = sorted(r[0] for r in words.select(F.least(F.length("word"), F.lit(3))).distinct().collect())  # three at most
    own = F.coalesce(*[F.when(F.least(F.length("word"), F.lit(3)) == k, T.grams(F.col("word"), k)) for k in sizes])
    blocks = words.select("word", F.explode(own).alias("block"))
    opened = texts.select("pos", F.explode(F.concat(*[T.grams(F.col("said"), k) for k in sizes])).alias("block"))
    met = opened.join(small(blocks.select("block").distinct()), "block").groupBy("block").agg(F.count("*").alias("n"))
    rarest = blocks.join(met, "block", "left").groupBy("word").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "block")).alias("b")).where("b.n > 0")
    near = opened.join(small(rarest.select("word", F.col("b.block").alias("block"))), "block").select("pos", "word")
    return near.join(texts, "pos").where(F.contains("said", F.col("word"))).select("pos", "word")


def web_to_companies(results: DataFrame, queries: DataFrame, registrable=T.registrable_domain, non_company: Sequence[str] = vocab.NON_COMPANY_SITES, directories: Sequence[str] = vocab.DIRECTORY_SITES, domain_only: bool = False) -> DataFrame:
    """(query_id, rank, url, title, content) and (query_id, hints, limit) to candidates of each query.

    Pages that aren't companies' go first. Directory pages stay without a domain. The first result of a key
    (registrable domain, else name) wins; unnamed ones go. ``domain_only`` is the variant for sources whose
    results without a domain are dropped.
    """
    domain = T.extract_domain(F.col("url"))
    rows = results.withColumn("title", T.strip(F.col("title"))).withColumn("content", T.strip(F.col("content"))).withColumn("place", domain)
    rows = rows.withColumn("site", T.classify_site(F.col("place"), non_company, directories, registrable)).where("site <> 'non_company'")
    rows = rows.withColumn("domain", F.when(F.col("site") == "directory", "").otherwise(F.col("place")))
    if domain_only:
        rows = rows.where("domain <> ''")
    name = F.coalesce(T.blank_to_null(T.name_from_title(F.col("title"), F.col("domain"), registrable)), T.name_from_domain(F.col("domain"), registrable))
    rows = rows.select("*", F.explode(F.array(name)).alias("name")).where("name <> ''")  # a long expression, evaluated once
    rows = rows.withColumn("key", F.when(F.col("domain") != "", registrable(F.col("domain"))).otherwise(F.lower("name")))
    first = keep_first(rows, ["query_id", "key"], "rank")
    joined = first.join(queries.select("query_id", "hints", "limit"), "query_id")
    cut = top(joined, ["query_id"], F.col("limit"), "rank")
    found = F.when(F.col("site") == "directory", T.registry_fields(F.col("content"))).otherwise(F.expr("cast(map() as map<string, string>)"))
    said = F.concat("title", F.lit(" "), "content")
    return cut.select(
        "query_id", "rank", "key", "name", "domain",
        F.filter("hints", lambda h: (h != "") & F.contains(said, h)).alias("industries"),
        F.col("content").alias("summary"),
        F.array(F.struct(F.coalesce(T.blank_to_null(F.col("title")), F.col("name")).alias("title"), F.col("url").alias("url"), F.substring("content", 1, 200).alias("snippet"))).alias("evidence"),
        F.when(F.col("content") == "", F.array(F.lit("contacts"), F.lit("official_contact"), F.lit("summary"))).otherwise(F.array(F.lit("contacts"), F.lit("official_contact"))).alias("missing_fields"),
        found.alias("attributes"),
    )


def merge_recalls(primary: DataFrame, extra: DataFrame, registrable=T.registrable_domain, most: int = MOST) -> DataFrame:
    """Rows (query_id, pos, name, domain) of a query: all primary ones, then extra ones with a new key and a new name.

    A dropped extra must not block a later one, so rows are decided in rounds, for all queries at once: the first open
    row of both its key and its name is kept, open rows with its key or its name are dropped. The first open row of a
    query is decided in every round; there are as many rounds as a chain of rows has links that block each other by
    turns. Groups of any size are aggregates and joins by key, and no query is one task's.
    """

    def keyed(df: DataFrame, part: int) -> DataFrame:
        name = F.lower(T.strip(F.coalesce("name", F.lit(""))))
        key = F.when(F.col("domain") != "", registrable(F.col("domain"))).otherwise(name)
        return df.select("query_id", F.lit(part).alias("part"), "pos", "name", "domain", key.alias("key"), name.alias("fold"))

    def without(df: DataFrame, taken: DataFrame) -> DataFrame:
        left = df.join(taken.select("query_id", "key").distinct(), ["query_id", "key"], "left_anti")
        return left.join(taken.where("fold <> ''").select("query_id", "fold").distinct(), ["query_id", "fold"], "left_anti")

    first = keyed(primary, 0)
    kept, at = [first], F.struct("pos", "row")
    open_ = stored(without(keyed(extra, 1), first).withColumn("row", F.monotonically_increasing_id()), "open")
    while not open_.isEmpty():
        by_key = open_.groupBy("query_id", "key").agg(F.min(at).alias("of_key"))
        by_name = open_.where("fold <> ''").groupBy("query_id", "fold").agg(F.min(at).alias("of_name"))
        both = open_.join(by_key, ["query_id", "key"]).join(by_name, ["query_id", "fold"], "left")
        won = stored(both.where((at == F.col("of_key")) & ((F.col("fold") == "") | (at == F.col("of_name")))).select(open_.columns), "won")
        kept.append(won.drop("row"))
        open_ = stored(without(open_, won), "open")
    placed = numbered(reduce(DataFrame.unionByName, kept), ["query_id"], ["part", "pos"], "place", most)
    return placed.select("query_id", (F.col("place") - 1).cast("long").alias("place"), "part", "name", "domain")


def waterfall_collect(items: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items (query_id, source_id, pos, key, ...) and calls (query_id, source_id, priority, ok, latency_ms, cost, target).

    Sources of a query answer by priority; the first item of a key wins; once the target is reached, later
    sources aren't asked. Returns the items and one row per query with sources, latency, cost, truncation.
    A query whose sources all failed has ``failed`` set: an error, not an empty result.
    """
    good = calls.where("ok")
    ranked = items.join(good.select("query_id", "source_id", "priority", "target"), ["query_id", "source_id"])
    first = keep_first(ranked, ["query_id", "key"], "priority", "source_id", "pos")
    gained = first.groupBy("query_id", "source_id").agg(F.count("*").alias("gained"))
    asked = good.join(gained, ["query_id", "source_id"], "left").withColumn("gained", F.coalesce("gained", F.lit(0)))
    before = F.coalesce(F.sum("gained").over(Window.partitionBy("query_id").orderBy("priority", "source_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    asked = asked.withColumn("before", before).where("target = 0 or before < target")
    kept = first.join(asked.select("query_id", "source_id"), ["query_id", "source_id"], "left_semi")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("priority", "source_id", "pos"))
    kept = kept.withColumn("place", place).where("target = 0 or place <= target")
    told = asked.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("priority", "source_id"))), lambda x: x["source_id"]), "+").alias("source_id"),
        F.sum("latency_ms").alias("latency_ms"),
        F.sum("cost").alias("cost"),
        (F.max("target") > 0).alias("bounded"),
        (F.sum("gained") > F.max("target")).alias("over"),
    )
    summary = calls.select("query_id").distinct().join(told, "query_id", "left").select("query_id", F.coalesce("source_id", F.lit("")).alias("source_id"), F.coalesce("latency_ms", F.lit(0)).alias("latency_ms"), F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce(F.col("bounded") & F.col("over"), F.lit(False)).alias("truncated"), F.col("bounded").isNull().alias("failed"))
    return kept, summary


def rotated(pos: Column, offset: Column, n: Column) -> Column:
    """Position after a rotation of n items by an offset."""
    return F.pmod(pos - F.pmod(offset, F.greatest(n, F.lit(1))), F.greatest(n, F.lit(1)))


def _rotated_recall(queries: DataFrame, hits: DataFrame, scoped: DataFrame, turned: bool, most: int) -> DataFrame:
    """queries (query_id, scope, seed, limit), hits (query_id, pos, score), scoped (scope, pos): (query_id, pos, score, place).

    Hits come first: by score and position, or where ``turned``, by position rotated by the seed. The rest of
    the scope follows, rotated by it, as far as the limit reaches. Positions have a rank in their scope. The
    place j of the rest is the rank j plus the hits that lie before it: those whose own rank less the hits
    before them is j at most. A rest is only wanted by a query with fewer hits than its limit, so ranks are found from
    less than twice its limit of rows, and looked up by an equi-join: a query meets as many rows of its scope as it returns.
    """
    hits, scoped = stored(hits, "hits"), stored(scoped, "scoped")
    ranked = numbered(scoped, ["scope"], ["pos"], "rank", most).withColumn("rank", F.col("rank").cast("long") - 1)
    sizes = scoped.groupBy("scope").agg(F.count("*").alias("size"))
    found = hits.groupBy("query_id").agg(F.count("*").alias("hits"))
    asked = queries.join(sizes, "scope").join(found, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))
    rows = numbered(hits, ["query_id"], ["pos"] if turned else [F.col("score").desc(), "pos"], "turn", most).join(asked, "query_id").withColumn("turn", F.col("turn") - 1)
    rows = rows.withColumn("turn", rotated(F.col("turn"), F.pmod("seed", "hits"), F.col("hits"))) if turned else rows
    first = rows.where("turn < limit").select("query_id", "pos", "score", (F.col("turn") + 1).cast("int").alias("place"))
    # the rest: places from start on, around the end
    n = F.col("size") - F.col("hits")
    start = F.pmod(F.when(F.col("hits") > 0, F.pmod("seed", "hits")).otherwise(F.col("seed")) if turned else F.col("seed"), n)
    open_ = asked.where("hits < limit and hits < size").select("query_id", "scope", "hits", n.alias("n"), start.alias("start"), F.least(F.col("limit") - F.col("hits"), n).alias("need"))
    wanted = open_.select("query_id", "scope", "hits", F.explode(F.sequence(F.lit(0).cast("long"), F.col("need") - 1)).alias("turn"), "start", "n")
    wanted = wanted.select("query_id", "scope", F.pmod(F.col("start") + F.col("turn"), F.col("n")).alias("at"), (F.col("hits") + F.col("turn") + 1).cast("int").alias("place"))
    own = hits.join(open_.select("query_id", "scope"), "query_id").join(ranked, ["scope", "pos"])  # fewer than the limit
    own = own.withColumn("at", F.col("rank") - F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) + 1)
    both = wanted.unionByName(own.select("query_id", "scope", "at", F.lit(None).cast("int").alias("place")))
    before = F.count(F.when(F.col("place").isNull(), 1)).over(Window.partitionBy("query_id").orderBy("at", F.col("place").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("rank", F.col("at") + before).where("place is not null")
    rest = both.join(ranked, ["scope", "rank"]).select("query_id", "pos", F.lit(0).alias("score"), "place")
    return first.unionByName(rest)


def _of_hints(queries: DataFrame, column: str, texts: DataFrame) -> DataFrame:
    """The distinct (query_id, pos) of the texts (pos, said) that contain a hint of a query."""
    asked = queries.select("query_id", F.explode(column).alias("word"))
    return containing(texts, asked).join(asked, "word").select("query_id", "pos").distinct()


def rank_companies(queries: DataFrame, corpus: DataFrame, most: int = MOST) -> DataFrame:
    """(query_id, city, hints, seed, limit) and (pos, location, industries, ...): the corpus' columns with query_id, place and hit.

    Companies with an industry hint come first, each part rotated. The city is a hard filter, taken as an
    equi-join where the corpus has a column ``city``. Positions are unique; hints and cities are found by
    equi-joins, never by comparing all pairs. Scopes and hits of over ``most`` rows are ranked by many tasks.
    """
    q = queries.select("query_id", "hints", "seed", "limit", F.coalesce("city", F.lit("")).alias("scope"))
    scopes = q.select("scope").distinct()
    if "city" in corpus.columns:
        of_city = corpus.select(F.col("city").alias("scope"), "pos").where("scope <> ''")
    else:
        of_city = containing(corpus.select("pos", F.col("location").alias("said")), scopes.withColumnRenamed("scope", "word")).select(F.col("word").alias("scope"), "pos")
    scoped = of_city.union(corpus.select(F.lit(""), "pos")).join(F.broadcast(scopes) if scopes.limit(BROADCAST + 1).count() <= BROADCAST else scopes, "scope", "left_semi")
    hits = _of_hints(queries, "hints", corpus.select("pos", F.array_join("industries", "").alias("said")))
    hits = hits.join(q.select("query_id", "scope"), "query_id").join(scoped, ["scope", "pos"], "left_semi")
    best = _rotated_recall(q.drop("hints"), hits.select("query_id", "pos", F.lit(1).alias("score")), scoped, True, most)
    return best.join(corpus, "pos").withColumn("hit", F.col("score") > 0).drop("score")


def rank_people(queries: DataFrame, people: DataFrame, most: int = MOST) -> DataFrame:
    """(query_id, name_hints, role_hints, company_hints, city, seed, limit) and people (pos, ...): people's columns with query_id, relevance and place.

    Full name 4, part of a name 2, role 2, company 2, city 1. Hits keep their order for any seed; the others
    follow, rotated by it. Positions are unique; every part of the relevance is found by equi-joins on name
    forms and words, and of the others only those are read that the limit reaches.
    """
    words = F.array_join("keywords", "")
    named = name_matches(queries.select("query_id", F.explode("name_hints").alias("hint")), people.select("pos", T.all_names(F.col("name"), F.col("name_local"), F.col("aliases")).alias("names")))
    parts = [
        named.select("query_id", "pos", F.when(F.col("level") == "full", 4).otherwise(2).alias("score")),
        _of_hints(queries, "role_hints", people.select("pos", F.concat("title", words).alias("said"))).withColumn("score", F.lit(2)),
        _of_hints(queries, "company_hints", people.select("pos", F.concat("company", "company_domain", words).alias("said"))).withColumn("score", F.lit(2)),
        _of_hints(queries.withColumn("cities", F.array(F.coalesce("city", F.lit("")))), "cities", people.select("pos", F.col("location").alias("said"))).withColumn("score", F.lit(1)),
    ]
    hits = reduce(DataFrame.unionByName, parts).groupBy("query_id", "pos").agg(F.sum("score").cast("int").alias("score"))
    q = queries.select("query_id", F.lit("").alias("scope"), "seed", "limit")
    best = _rotated_recall(q, hits, people.select(F.lit("").alias("scope"), "pos"), False, most)
    return best.join(people, "pos").withColumnRenamed("score", "relevance")


def name_matches(queries: DataFrame, people: DataFrame) -> DataFrame:
    """Pairs with a full or partial name match, found by equi-joins on forms instead of comparing all pairs.

    queries (query_id, hint), people (pos, names): (query_id, pos, level). Parts of Chinese names are found by
    their first two characters.
    """
    forms = people.select("pos", T.name_forms(F.col("names")).alias("f"))
    full = forms.select("pos", F.explode("f.full").alias("form"))
    hints = queries.select("query_id", T.normalize_name(F.col("hint")).alias("form")).where("length(form) >= 2")
    exact = hints.join(full, "form").select("query_id", "pos", F.lit(0).alias("rank"))
    token = hints.where(~F.col("form").rlike(T.CJK)).join(forms.select("pos", F.explode("f.tokens").alias("form")), "form").select("query_id", "pos", F.lit(1).alias("rank"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("form") - 1, F.lit(1))), lambda i: F.substring(F.col("form"), i, F.lit(2)))
    blocks = full.where(F.col("form").rlike(T.CJK)).select("pos", F.col("form").alias("whole"), F.explode(F.array_distinct(grams)).alias("block"))
    part = hints.where(F.col("form").rlike(T.CJK)).withColumn("block", F.substring("form", 1, 2)).join(blocks, "block").where(F.contains("whole", F.col("form"))).select("query_id", "pos", F.lit(1).alias("rank"))
    best = exact.union(token).union(part).groupBy("query_id", "pos").agg(F.min("rank").alias("rank"))
    return best.select("query_id", "pos", F.when(F.col("rank") == 0, "full").otherwise("partial").alias("level"))


def exclude_taken(candidates: DataFrame, taken: DataFrame, n: Column | int, *order: Column | str) -> DataFrame:
    """Candidates (list_id, row_key, ...) that the list doesn't have yet, the first n of each list."""
    return top(candidates.join(taken.select("list_id", "row_key").distinct(), ["list_id", "row_key"], "left_anti"), ["list_id"], n, *order)


def contacts_by_domain(requests: DataFrame, contacts: DataFrame) -> DataFrame:
    """requests (request_id, domain, limit, positions), contacts (domain, pos, title, ...): limit first, then title words.

    A blank domain is an error: names are no way to find people.
    """
    domain = T.strip(F.lower("domain"))
    checked = requests.withColumn("domain", F.when(domain == "", F.raise_error(F.lit("contacts need a verified domain, not a company name"))).otherwise(domain))
    first = top(checked.join(contacts, "domain"), ["request_id"], F.col("limit"), "pos")
    wanted = F.filter(F.transform("positions", lambda p: F.lower(T.strip(p))), lambda p: p != "")
    return first.where((F.size(wanted) == 0) | T.any_in(F.lower("title"), wanted))


def entity_pages(entities: DataFrame, pages: DataFrame, n: int = 4, few: int = FEW, most: int = BROADCAST) -> DataFrame:
    """entities (entity_id, name, evidence_url, reason), pages (pos, url, title, content): evidence of each entity.

    Pages that name it, the first n; else its own link. Each distinct name is looked for once (``containing``)
    and keeps its first n pages before entities come in, so many entities of one name, or a name on every
    page, cost a row each and never their product. Positions of pages are unique.
    """
    names = entities.where("name <> ''").select(F.col("name").alias("word")).distinct()
    said = pages.select("pos", F.concat("title", F.lit(" "), "content").alias("said"))
    first = top(containing(said, names, few, most), ["word"], n, "pos")
    item = F.struct("pos", F.substring("title", 1, 120).alias("title"), "url", F.substring("content", 1, 200).alias("snippet"))
    items = first.join(pages.select("pos", item.alias("item")), "pos")
    listed = items.groupBy(F.col("word").alias("name")).agg(F.transform(F.array_sort(F.collect_list("item")), lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"), x["snippet"].alias("snippet"))).alias("found"))
    listed = F.broadcast(listed) if names.limit(FEW + 1).count() <= FEW else listed  # a few names may have most entities
    own = F.when(F.col("evidence_url") != "", F.array(F.struct(F.col("name").alias("title"), F.col("evidence_url").alias("url"), F.col("reason").alias("snippet")))).otherwise(F.array().cast(f"array<{EVIDENCE}>"))
    return entities.join(listed, "name", "left").select("entity_id", F.coalesce("found", own).alias("evidence"))


def dedupe_entities(entities: DataFrame) -> DataFrame:
    """The first of each name in a run, by round and position."""
    return keep_first(entities, ["run_id", "name"], "round", "pos")


def locate_homepage(hits: DataFrame, extra: Sequence[str] = (), skip: Sequence[str] = vocab.SKIP_SITES, suffixes: Sequence[str] = vocab.LISTED_SUFFIXES) -> DataFrame:
    """hits (entity_id, rank, url): the registrable domain of each entity's first hit that may be a home page."""
    host = T.extract_host(F.col("url"))
    rows = hits.withColumn("host", host).where(~T.is_skippable(F.col("host"), extra, skip, suffixes))
    return rows.groupBy("entity_id").agg(F.min_by(T.registrable_domain_listed(F.col("host"), suffixes), "rank").alias("domain"))


# What a page's path says about its worth, and endings of files.
SUBPAGES = (
    ("about", "关于", "简介", "介绍", "profile"),
    ("product", "产品", "服务", "方案", "solution", "business"),
    ("join", "career", "招聘", "job", "人才"),
    ("contact", "联系"),
    ("news", "动态", "新闻", "media", "资讯"),
)
ASSETS = (
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico", ".zip", ".rar", ".7z", ".mp4", ".mp3", ".exe", ".apk", ".css", ".js",
)


def pick_subpages(links: DataFrame, n: int = 3, suffixes: Sequence[str] = vocab.LISTED_SUFFIXES) -> DataFrame:
    """links (page_id, home, link): the n best pages of the same site: word groups, then shorter paths, then the address."""
    clean = F.lower(F.regexp_replace(F.regexp_replace("link", r"[?#].*$", ""), "/+$", ""))
    rows = links.withColumn("link", clean)
    site = lambda c: T.registrable_domain_listed(F.col(c), suffixes)
    path = F.coalesce(F.get(F.split("link", "/"), F.lit(3)), F.lit(""))
    rows = rows.where((site("home") != "") & (site("link") == site("home"))).withColumn("path", path)
    rows = rows.where((F.col("path") != "") & ~F.col("link").rlike("(?:" + "|".join(a.replace(".", r"\.") for a in ASSETS) + ")$"))
    score = sum(T.any_in(F.col("path"), T.literals(g)).cast("int") for g in SUBPAGES)
    rows = rows.withColumn("score", score)
    order = Window.partitionBy("page_id").orderBy(F.col("score").desc(), F.length("path"), "link")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("page_id", "place", "link", "score")


def pack_documents(documents: DataFrame, n: int = 16, body: int = 260, materials: bool = False) -> DataFrame:
    """documents (list_id, pos, title, url, content, website, date): the first n of each list as one numbered text.

    ``materials`` gives the shorter form whose bodies aren't cut.
    """
    place = F.row_number().over(Window.partitionBy("list_id").orderBy("pos"))
    first = documents.withColumn("nth", place).where(F.col("nth") <= n)
    flat = T.strip(F.regexp_replace("content", r"(?U)\s+", " "))
    head = F.concat(F.lit("["), F.col("nth").cast("string"), F.lit("] "), T.strip(F.col("title")))
    site = F.lit("") if materials else F.concat(F.lit("\n    站点："), T.strip(F.col("website")), F.lit("　日期："), T.strip(F.col("date")))
    block = F.concat(head, site, F.lit("\n    URL："), T.strip(F.col("url")), F.lit("\n    正文："), flat if materials else F.substring(flat, 1, body))
    listed = first.select("list_id", F.struct("nth", block.alias("block")).alias("x")).groupBy("list_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return listed.select("list_id", F.size("xs").alias("n_documents"), F.array_join(F.transform("xs", lambda x: x["block"]), "\n").alias("packed"))


def find_mentioned_company(queries: DataFrame, companies: DataFrame) -> DataFrame:
    """queries (query_id, text), companies (pos, name): the first company whose short name, or its last four characters, occurs.

    Of companies with the same such characters only the first is looked for; ids of queries are unique.
    """
    short = F.replace(F.replace("name", F.lit("有限公司"), F.lit("")), F.lit("股份"), F.lit(""))
    brand = F.when(F.length("short") > 4, F.right("short", F.lit(4))).otherwise(F.col("short"))
    known = companies.select("pos", "name", short.alias("short")).where("short <> ''").groupBy(brand.alias("word")).agg(F.min(F.struct("pos", "name")).alias("first"))
    hits = containing(queries.select(F.col("query_id").alias("pos"), F.col("text").alias("said")), known.select("word"))  # the short name holds the brand
    return hits.join(known, "word").groupBy(F.col("pos").alias("query_id")).agg(F.min("first").alias("first")).select("query_id", F.col("first.name").alias("company"))
