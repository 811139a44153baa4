"""Enrichment: joins that fill what is blank and never overwrite, and the history of companies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions import text as T
from leadmill.operators.ranks import free
from leadmill.operators.recall import keep_first
from leadmill.schemas import EVIDENCE

FILLABLE = ("summary", "location", "employees", "funding_stage")


def enrich_targets(records: DataFrame) -> DataFrame:
    """Records with a domain or a name, and what they lack; a blank summary counts as lacking."""
    lacking = F.when(F.col("summary") == "", F.array_union("missing_fields", F.array(F.lit("summary")))).otherwise(F.col("missing_fields"))
    key = T.dedupe_key(F.col("domain"), F.col("name"))
    return records.where("domain <> '' or name <> ''").select("domain", "name", F.array_sort(lacking).alias("missing"), key.alias("dedupe_key"))


def is_relevant(name: Column, domain: Column, title: Column, content: Column, url: Column) -> Column:
    """Whether a result is about a company: its name is in it, or its first domain label, of three letters at least, in the address."""
    root = F.substring_index(F.lower(T.strip(domain)), ".", 1)
    named = (T.strip(name) != "") & (F.contains(title, T.strip(name)) | F.contains(content, T.strip(name)))
    return named | ((F.length(root) > 2) & F.contains(F.lower(url), root))


def first_relevant(targets: DataFrame, results: DataFrame) -> DataFrame:
    """targets (dedupe_key, name, domain, missing), results (dedupe_key, stage, rank, url, title, content).

    The first result about each target that lacks a summary, directory results (stage 0) before general ones
    (stage 1); registry fields come from directory results only.
    """
    need = targets.where(F.array_contains("missing", "summary") & (F.col("dedupe_key") != ""))
    rows = need.join(results, "dedupe_key").withColumn("content", T.strip(F.col("content"))).withColumn("title", T.strip(F.col("title")))
    rows = rows.where((F.col("content") != "") & is_relevant(F.col("name"), F.col("domain"), F.col("title"), F.col("content"), F.col("url")))
    best = keep_first(rows, ["dedupe_key"], "stage", "rank")
    source = F.when(F.col("stage") == 0, "directory").otherwise("web_search")
    kept = F.when(F.col("stage") == 0, T.registry_fields(F.col("content"))).otherwise(F.expr("cast(map() as map<string, string>)"))
    return best.select("dedupe_key", "stage", F.substring("content", 1, 400).alias("summary"), "title", "url", source.alias("source"), kept.alias("attributes"))


def cache_lookup(targets: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """targets (cache_key), cache (cache_key, value, created_at, expires_at): state hit, known_empty or miss; an empty value is no miss."""
    live = cache.where(F.col("expires_at") >= now).select("cache_key", "value")
    return targets.join(live, "cache_key", "left").withColumn("state", F.when(F.col("value").isNull(), "miss").when(F.col("value") == "", "known_empty").otherwise("hit"))


def cache_prune(cache: DataFrame, now: Column, most: int = 10_000, drop: int = 1_000) -> DataFrame:
    """Under ``most`` entries nothing goes; else expired ones do, and if there are still as many, the oldest ``drop``."""
    if cache.count() < most:
        return cache
    live = cache.where(F.col("expires_at") >= now)
    if live.count() < most:
        return live
    oldest = live.orderBy("created_at", "cache_key").limit(drop).select("cache_key")
    return live.join(oldest, "cache_key", "left_anti")


def merge_evidence(base: Column, more: Column) -> Column:
    """Both lists, the first item of each address."""
    return F.aggregate(
        F.concat(base, more), F.array().cast(f"array<{EVIDENCE}>"), lambda a, e: F.when(F.exists(a, lambda x: x["url"] == e["url"]), a).otherwise(F.concat(a, F.array(e)))
    )


def one_of_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key, the first by all its other columns as text: an aggregate, so a key of any size is no hot one."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    kept, tie = F.struct(*[F.col(c) for c in rest]), F.to_json(F.struct(*[F.struct(F.col(c)).alias(f"c{i}") for i, c in enumerate(rest)]))
    held = free(df.columns, "kept")
    return df.groupBy(*keys).agg(F.min_by(kept, tie).alias(held)).select(*keys, *[F.col(held)[c].alias(c) for c in rest])


def merge_enrichment(base: DataFrame, enriched: DataFrame, priority: Sequence[str] = ()) -> DataFrame:
    """base records with blanks filled from ``enriched`` (company schema), by dedupe key; blank keys never meet.

    Sources answer in the order of ``priority``, others after them by name. A field takes the first value that isn't
    blank, evidence is joined in that order, an attribute comes from the first source that has it, and ``enriched_by``
    names all, joined by ``+``. Of several records of one source and key, the first as text counts. A base record
    stays one row.
    """
    none = F.expr("cast(map() as map<string, string>)")
    at, key_col, found = (free(base.columns, c) for c in ("rank", "key", "found"))
    rank = F.coalesce(*[F.when(F.col("source_id") == x, i) for i, x in enumerate(priority)], F.lit(len(priority))) if priority else F.lit(0)
    new = enriched.select(T.dedupe_key(F.col("domain"), F.col("name")).alias(key_col), "source_id", *FILLABLE, "industries", "evidence", "attributes").where(F.col(key_col) != "").where(F.col("source_id").isNotNull())
    new = one_of_each(new, [key_col, "source_id"])
    first = lambda a, b: F.when(a[at] < b[at], -1).when(a[at] > b[at], 1).when(a["source_id"] < b["source_id"], -1).when(a["source_id"] > b["source_id"], 1).otherwise(0)
    sources = new.withColumn(at, rank).groupBy(key_col).agg(F.array_sort(F.collect_list(F.struct(at, "source_id", *FILLABLE, "industries", "evidence", "attributes")), first).alias(found))  # a record per source
    rows = base.withColumn(key_col, T.blank_to_null(T.dedupe_key(F.col("domain"), F.col("name")))).join(sources, key_col, "left")
    got, of = F.col(found).isNotNull(), lambda c: F.transform(found, lambda x: x[c])
    best = {c: F.coalesce(F.get(F.filter(of(c), lambda x: x != ""), F.lit(0)), F.lit("")) for c in FILLABLE}
    filled = {c: F.when(got & (F.col(c) == ""), best[c]).otherwise(F.col(c)) for c in FILLABLE}
    lost = got & (F.col("summary") == "") & (best["summary"] != "")
    without = lambda m, other: F.map_filter(m, lambda k, _: ~F.array_contains(F.map_keys(other), k))
    own = F.aggregate(of("attributes"), none, lambda a, m: F.map_concat(a, without(F.coalesce(m, none), a)))
    fresh = F.map_concat(F.map_filter(own, lambda k, _: k != "enriched_by"), F.create_map(F.lit("enriched_by"), F.array_join(of("source_id"), "+")))
    empty = F.array().cast(f"array<{EVIDENCE}>")
    out = {
        **filled,
        "industries": F.when(got & (F.size("industries") == 0), F.coalesce(F.get(F.filter(of("industries"), lambda x: F.size(x) > 0), F.lit(0)), "industries")).otherwise(F.col("industries")),
        "evidence": F.when(got, merge_evidence(F.col("evidence"), F.flatten(F.transform(of("evidence"), lambda x: F.coalesce(x, empty))))).otherwise(F.col("evidence")),
        "missing_fields": F.when(lost, F.array_remove("missing_fields", "summary")).otherwise(F.col("missing_fields")),
        "attributes": F.when(got, F.map_concat(without(F.col("attributes"), fresh), fresh)).otherwise(F.col("attributes")),
    }
    return rows.select(*[out[c].alias(c) if c in out else F.col(c) for c in base.columns])


def latest_enrichment(enrichments: DataFrame) -> DataFrame:
    """The newest record per company and source; of several of one time, the first by all its other columns as text."""
    rest = [F.to_json(F.struct(c)) for c in enrichments.columns if c not in ("dedupe_key", "source_id", "fetched_at")]
    return keep_first(enrichments, ["dedupe_key", "source_id"], F.col("fetched_at").desc(), *rest)


def enrichment_audit(enrichments: DataFrame, since: Column, until: Column) -> DataFrame:
    """Companies filled per source in a time range."""
    return enrichments.where((F.col("fetched_at") >= since) & (F.col("fetched_at") < until)).groupBy("source_id").agg(F.countDistinct("dedupe_key").alias("companies"))


def _kept() -> list[Column]:
    """What a master keeps of the latest and the earliest sighting."""
    return [F.col(c).alias(name) for c, name in (("late.name", "name"), ("early.source_id", "first_source"), ("early.seen_at", "first_seen_at"), ("late.seen_at", "last_seen_at"), ("late.source_id", "last_source"))]


def _ends(seen_at: str, late_source: str, early_at: str, early_source: str) -> tuple[Column, Column]:
    """Latest and earliest sighting; one without a time is neither while there is one with a time."""
    early = F.struct(F.col(early_at).alias("seen_at"), F.col(early_source).alias("source_id"))
    return F.max(F.struct(F.col(seen_at).alias("seen_at"), F.col(late_source).alias("source_id"), "name")), F.coalesce(F.min(F.when(F.col(early_at).isNotNull(), early)), F.min(early))


def company_master(sightings: DataFrame) -> DataFrame:
    """One row per company from (dedupe_key, name, domain, source_id, seen_at): latest name, first source, times and count.

    Sightings without a time count, but are first or last only for a company that has no other.
    """
    late, early = _ends("seen_at", "source_id", "seen_at", "source_id")
    new = sightings.where("dedupe_key <> ''").groupBy("dedupe_key")
    return new.agg(late.alias("late"), early.alias("early"), F.count("*").alias("seen_count")).select("dedupe_key", *_kept(), "seen_count")


def merged_master(rows: DataFrame) -> DataFrame:
    """Rows of several masters as one, without reading the sightings again; equal to one master of all sightings, ties included."""
    late, early = _ends("last_seen_at", "last_source", "first_seen_at", "first_source")
    return rows.groupBy("dedupe_key").agg(late.alias("late"), early.alias("early"), F.sum("seen_count").alias("seen_count")).select("dedupe_key", *_kept(), "seen_count")


def merge_master(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two masters as one."""
    return merged_master(old.unionByName(new))


def first_seen_by_source(master: DataFrame, period: str = "month") -> DataFrame:
    return master.groupBy("first_source", F.date_trunc(period, "first_seen_at").alias("period")).agg(F.count("*").alias("companies"))


LEDGER = ("registered_capital", "legal_rep", "founded", "matched_title", "pdl_id")


def enrichment_ledger(records: DataFrame, labels: DataFrame) -> DataFrame:
    """The shown attributes and the source's label of enriched records; labels (source_id, label) is a small dimension."""
    by = F.coalesce(F.element_at("attributes", "enriched_by"), F.lit(""))
    rows = records.withColumn("enriched_by", by).where("enriched_by <> ''")
    rows = rows.join(labels.select(F.col("source_id").alias("enriched_by"), "label"), "enriched_by", "left")
    fields = F.map_filter("attributes", lambda k, v: k.isin(*LEDGER) & (v != ""))
    return rows.select("external_id", "enriched_by", F.coalesce("label", "enriched_by").alias("source_label"), fields.alias("fields"))


# Profiles of vendors


def profile_to_record(profiles: DataFrame) -> DataFrame:
    """(id, name, website, industry, tags, locality, region, country, size, summary, target_name, target_domain) to company records."""
    col = lambda c: F.coalesce(F.col(c), F.lit(""))
    site = F.regexp_replace(F.regexp_replace(F.lower(T.strip(F.coalesce(T.blank_to_null(col("website")), col("target_domain")))), "^http://", ""), "^https://", "")
    site = F.regexp_replace(site, "^/+|/+$", "")
    summary = T.strip(col("summary"))
    missing = F.concat(F.array(F.lit("contacts"), F.lit("official_contact")), F.when(summary == "", F.array(F.lit("summary"))).otherwise(F.array().cast("array<string>")))
    return profiles.select(
        F.concat(F.lit("profile-"), F.coalesce(T.blank_to_null(col("id")), T.blank_to_null(site), col("target_name"))).alias("external_id"),
        F.coalesce(T.blank_to_null(col("name")), T.blank_to_null(col("target_name")), col("target_domain")).alias("name"),
        site.alias("domain"),
        T.clean_tags(col("industry"), F.coalesce("tags", F.array().cast("array<string>"))).alias("industries"),
        summary.alias("summary"),
        T.joined_location(col("locality"), col("region"), col("country")).alias("location"),
        T.strip(col("size")).alias("employees"),
        missing.alias("missing_fields"),
    )


# Dossiers


def dossier_schema(fields: list[dict]) -> str:
    """The schema of a dossier's JSON from its field table of dicts (name, kind text or list, required)."""
    own = ", ".join(f"`{f['name']}`: {'array<string>' if f['kind'] == 'list' else 'string'}" for f in fields)
    return f"struct<name: string, {own}, matched: string, reason: string, missing: array<string>, evidence_url: string>"


def _tidy(values: Column) -> Column:
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), T.strip), lambda x: x != "")


def parse_dossier(payload: Column, fallback_name: Column, fields: list[dict]) -> Column:
    """A dossier struct from JSON text under ``entity`` or ``company``; null if neither is an object.

    Texts and list items are trimmed, blank items dropped, a blank name falls back.
    """
    kind = dossier_schema(fields)
    root = F.from_json(payload, f"struct<entity: {kind}, company: {kind}>")
    raw = F.coalesce(root["entity"], root["company"])
    required = [f["name"] for f in fields if f["required"]]
    made = F.struct(
        F.coalesce(T.blank_to_null(T.strip(raw["name"])), fallback_name).alias("name"),
        *((_tidy(raw[f["name"]]) if f["kind"] == "list" else T.strip(F.coalesce(raw[f["name"]], F.lit("")))).alias(f["name"]) for f in fields),
        T.as_bool(raw["matched"]).alias("matched"),
        T.strip(F.coalesce(raw["reason"], F.lit(""))).alias("reason"),
        missing_required(raw["missing"], required).alias("missing"),
        F.coalesce(raw["evidence_url"], F.lit("")).alias("evidence_url"),
    )
    return F.when(raw.isNotNull(), made)


def parse_entities(pages: DataFrame, fields: list[dict]) -> DataFrame:
    """(run_id, round, payload) to one row per named entity under ``entities`` or ``companies``; unmatched ones stay."""
    kind = dossier_schema(fields)
    root = F.from_json("payload", f"struct<entities: array<{kind}>, companies: array<{kind}>>")
    rows = pages.withColumn("root", root).select("run_id", "round", F.posexplode(F.coalesce("root.entities", "root.companies")).alias("pos", "e"))
    cols = [(_tidy(F.col(f"e.{f['name']}")) if f["kind"] == "list" else T.strip(F.coalesce(f"e.{f['name']}", F.lit("")))).alias(f["name"]) for f in fields]
    return rows.select(
        "run_id", "round", "pos", T.strip(F.coalesce("e.name", F.lit(""))).alias("name"), *cols, T.as_bool(F.col("e.matched")).alias("matched"),
        T.strip(F.coalesce("e.reason", F.lit(""))).alias("reason"), T.strip(F.coalesce("e.evidence_url", F.lit(""))).alias("evidence_url"),
    ).where("name <> ''")


def missing_required(missing: Column, required: list[str]) -> Column:
    """Reported gaps that are required fields, in order."""
    return F.filter(_tidy(missing), lambda x: x.isin(*required) if required else F.lit(False))


def filled_count(dossier: Column, fields: list[dict]) -> Column:
    """Dossier fields with content."""
    return sum(((F.size(dossier[f["name"]]) > 0) if f["kind"] == "list" else (F.coalesce(dossier[f["name"]], F.lit("")) != "")).cast("int") for f in fields)


ROW_FIELDS = ("domain", "summary", "location", "employees", "funding_stage")


def apply_dossier(rows: DataFrame, dossiers: DataFrame, extra_fields: tuple[str, ...] = ("legal_name", "registered_capital", "official_contact")) -> DataFrame:
    """rows with blanks filled from dossiers (row_key, name, legal_name, domain, summary, industries, ..., official_contact).

    The legal name, else the dossier's, replaces the row's: the only overwrite. Contacts found make that
    state ready, fields without a place in the row go to ``agent_fields``, what was written to ``written``.
    Fields that the dossiers don't have are blank. Of several dossiers of a key the first as text counts, so a row stays one.
    """
    names = {c: free([*rows.columns, *dossiers.columns], f"d_{c}") for c in dossiers.columns if c != "row_key"}
    joined = rows.join(one_of_each(dossiers, ["row_key"]).withColumnsRenamed(names), "row_key", "left")
    col = lambda c: T.strip(F.coalesce(names[c], F.lit(""))) if c in names else F.lit("")
    upgraded = F.coalesce(T.blank_to_null(col("legal_name")), T.blank_to_null(col("name")), F.col("name"))
    fill = {c: F.when(F.col(c) == "", col(c)).otherwise(F.col(c)) for c in ROW_FIELDS}
    industries = F.when(F.size("industries") == 0, F.coalesce(names["industries"], "industries") if "industries" in names else F.col("industries")).otherwise(F.col("industries"))
    wrote = [F.when(upgraded != F.col("name"), F.struct(F.lit("name").alias("k"), upgraded.alias("v")))]
    wrote += [F.when((F.col(c) == "") & (fill[c] != ""), F.struct(F.lit(c).alias("k"), fill[c].alias("v"))) for c in ROW_FIELDS]
    wrote.append(F.when((F.size("industries") == 0) & (F.size(industries) > 0), F.struct(F.lit("industries").alias("k"), F.array_join(industries, "、").alias("v"))))
    extra = [F.when(col(c) != "", F.struct(F.lit(c).alias("k"), col(c).alias("v"))) for c in extra_fields]
    as_map = lambda xs: F.map_from_entries(F.array_compact(F.array(*xs)))
    state = F.when(col("official_contact") != "", "ready").otherwise(F.col("official_contact_state"))
    new = {"name": upgraded, **fill, "industries": industries, "official_contact_state": state}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns], as_map(extra).alias("agent_fields"), as_map(wrote).alias("written"))


def entity_to_record(entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """Entities (entity_id, name, domain, summary, matched, reason, attributes) with their pages to light records."""
    rows = entities.join(evidence, "entity_id", "left")
    return rows.select(
        "entity_id", "name", F.lower(T.strip(F.col("domain"))).alias("domain"), T.strip(F.col("summary")).alias("summary"), F.when(F.col("matched"), "明确符合").otherwise("可能符合").alias("match_level"),
        F.when(F.col("matched"), 90).otherwise(45).alias("score"), F.col("reason").alias("match_reason"),
        F.map_concat(F.map_filter("attributes", lambda k, _: ~k.isin("agent", "agent_reason")), F.create_map(F.lit("agent"), F.lit("discovery"), F.lit("agent_reason"), F.col("reason"))).alias("attributes"),
        F.coalesce("evidence", F.array().cast(f"array<{EVIDENCE}>")).alias("evidence"),
    )
