"""Judging records against criteria and scoring the verdicts.

Criteria stay an array on the record row: judging is row-local, built-in expressions only, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill import vocab
from leadmill.functions.text import all_names, any_in, blank_to_null, employee_range, literals, match_name, name_forms, normalize_funding, range_covers, strip
from leadmill.operators.enrich import one_of_each
from leadmill.vocab import NO, UNSURE, YES


def hard(c: Column) -> Column:
    return (c["weight"] >= vocab.HARD_AT) & ~c["lenient"]


def _by_tokens(text: Column, c: Column, miss: Column | str) -> Column:
    return F.when(any_in(text, c["tokens"]), YES).otherwise(miss)


# Companies


def judge_geo(location: Column, c: Column) -> Column:
    return F.when((strip(location) == "") | (F.size(c["tokens"]) == 0), UNSURE).otherwise(_by_tokens(location, c, NO))


def judge_industry(industries: Column, summary: Column, name: Column, c: Column) -> Column:
    joined = F.array_join(industries, "、")
    soft = F.when(any_in(F.concat(summary, name), c["tokens"]), UNSURE).otherwise(NO)
    return F.when(joined == "", UNSURE).otherwise(_by_tokens(joined, c, soft))


def judge_size(employees: Column, c: Column) -> Column:
    have = employee_range(employees)
    pair = r"^(?U)\s*(\d+)\s*:\s*(\d+)\s*$"
    low, high = (F.regexp_extract(c["expected"], pair, i).try_cast("long") for i in (1, 2))
    return F.when(have.isNull() | low.isNull() | high.isNull(), UNSURE).when(range_covers(have, low, high), YES).otherwise(NO)


def judge_funding(stage: Column, c: Column) -> Column:
    return F.when(strip(stage) == "", UNSURE).when(normalize_funding(strip(stage)) == normalize_funding(c["expected"]), YES).otherwise(NO)


def judge_business(summary: Column, name: Column, industries: Column, c: Column) -> Column:
    return _by_tokens(F.concat(summary, name, F.array_join(industries, "、")), c, F.when(c["lenient"], UNSURE).otherwise(NO))


def judge_reachability(contact_count: Column) -> Column:
    return F.when(contact_count > 0, YES).otherwise(UNSURE)


def judge_company(c: Column) -> Column:
    """The verdict of one criterion on the company columns of the row."""
    k = c["category"]
    return (
        F.when(k == "geo", judge_geo(F.col("location"), c))
        .when(k == "industry", judge_industry(F.col("industries"), F.col("summary"), F.col("name"), c))
        .when(k == "size", judge_size(F.col("employees"), c))
        .when(k == "funding", judge_funding(F.col("funding_stage"), c))
        .when(k == "reachability", judge_reachability(F.col("contact_count")))
        .otherwise(judge_business(F.col("summary"), F.col("name"), F.col("industries"), c))
    )


# People


def person_history() -> Column:
    return F.concat(F.col("summary"), F.col("company"), F.array_join("keywords", ""), F.array_join("aliases", "、"))


def judge_name(names: Column, c: Column) -> Column:
    level = match_name(name_forms(names), c["tokens"])["level"]
    return F.when(level == "full", YES).when(level == "partial", UNSURE).otherwise(NO)


def judge_title(title: Column, history: Column, c: Column) -> Column:
    hit = any_in(F.lower(strip(title)), F.transform(c["tokens"], F.lower))
    return F.when(strip(title) == "", UNSURE).when(hit, YES).when(any_in(history, c["tokens"]), UNSURE).otherwise(NO)


def judge_employer(text: Column, c: Column, families=vocab.FAMILIES) -> Column:
    """Without any industry word at all a profile says nothing about the employer's business."""
    words = literals([w for _, tokens in families for w in tokens])
    return F.when(strip(text) == "", UNSURE).otherwise(_by_tokens(text, c, F.when(any_in(text, words), NO).otherwise(UNSURE)))


def seniority_rank(title: Column, bands=vocab.BANDS) -> Column:
    """Position of the highest band with a word in the title, null without one."""
    out = F.lit(None).cast("int")
    for i, (_, words) in reversed(list(enumerate(bands))):
        out = F.when(any_in(title, literals(words)) | any_in(F.lower(title), literals(words)), i).otherwise(out)
    return out


def judge_seniority(title: Column, c: Column, bands=vocab.BANDS) -> Column:
    rank = seniority_rank(strip(title), bands)
    target = F.array_position(literals([b for b, _ in bands]), c["expected"])
    gap = rank - F.when(target > 0, target - 1).otherwise(len(bands))
    return F.when((strip(title) == "") | rank.isNull(), UNSURE).when(gap <= 0, YES).when(gap == 1, UNSURE).otherwise(NO)


def judge_background(history: Column, c: Column) -> Column:
    return _by_tokens(history, c, UNSURE)


def judge_person_contact(email: Column, phone: Column) -> Column:
    return F.when((email != "") | (phone != ""), YES).otherwise(UNSURE)


def judge_person(c: Column) -> Column:
    """The verdict of one criterion on the person columns of the row."""
    k = c["category"]
    employer = F.concat("company", "company_domain", "summary", F.array_join("keywords", ""))
    return (
        F.when(k == "name", judge_name(all_names(F.col("name"), F.col("name_local"), F.col("aliases")), c))
        .when(k == "title", judge_title(F.col("title"), person_history(), c))
        .when(k == "company", judge_employer(employer, c))
        .when(k == "seniority", judge_seniority(F.col("title"), c))
        .when(k == "geo", judge_geo(F.col("location"), c))
        .when(k == "reachability", judge_person_contact(F.col("contact_email"), F.col("contact_phone")))
        .otherwise(judge_background(person_history(), c))
    )


# Scores


def factor(verdict: Column) -> Column:
    return F.when(verdict == YES, 1.0).when(verdict == UNSURE, 0.5).otherwise(0.0)


def score_verdicts(verdicts: Column) -> Column:
    """struct(score, ratio, match_level, hard_miss) of an array of verdicts."""
    total = F.aggregate(verdicts, F.lit(0).cast("long"), lambda a, v: a + v["weight"])
    earned = F.aggregate(verdicts, F.lit(0.0), lambda a, v: a + v["weight"] * factor(v["verdict"]))
    ratio = F.when(total > 0, earned / F.greatest(total, F.lit(1))).otherwise(0.0)
    miss = F.exists(verdicts, lambda v: (v["verdict"] == NO) & v["hard"])
    level = F.when((ratio >= vocab.FULL_AT) & ~miss, vocab.FULL).when(ratio >= vocab.PARTIAL_AT, vocab.PARTIAL).otherwise(vocab.UNCONFIRMED)
    return F.struct(F.bround(ratio * 100).cast("int").alias("score"), ratio.alias("ratio"), level.alias("match_level"), miss.alias("hard_miss"))


def _names(verdicts: Column, n: int = 2) -> Column:
    return F.array_join(F.slice(F.transform(verdicts, lambda v: v["criterion"]), 1, n), "、")


def compose_reason(verdicts: Column, scored: Column, people: bool = False) -> Column:
    """A sentence with the counts of hits, open points and the first two misses."""
    of = lambda kind: F.filter(verdicts, lambda v: v["verdict"] == kind)
    share = F.concat(F.size(of(YES)).cast("string"), F.lit("/"), F.size(verdicts).cast("string"))
    score = F.concat(F.lit("（加权得分 "), scored["score"].cast("string"), F.lit("）"))
    if people:
        labels = F.transform(F.filter(of(YES), lambda v: v["hard"]), lambda v: F.substring_index(v["criterion"], "：", 1))
        subject = F.coalesce(blank_to_null(F.array_join(F.slice(labels, 1, 2), "、")), F.lit("硬性条件"))
        full = F.concat(share, F.lit(" 条标准命中"), score, F.lit("，"), subject, F.lit("等硬性条件均一致，可进入触达序列。"))
    else:
        full = F.concat(share, F.lit(" 条标准命中"), score, F.lit("，地域与行业等硬性条件均一致，可直接进入触达序列。"))
    missed = F.concat(share, F.lit(" 条标准命中，但「"), _names(of(NO)), F.lit("」不符合，建议人工确认后再跟进。"))
    open_ = F.concat(share, F.lit(" 条标准命中"), score, F.lit("，仍有 "), F.size(of(UNSURE)).cast("string"), F.lit(" 条需补充核实。"))
    rest = F.concat(F.lit("仅 "), share, F.lit(" 条标准命中"), score, F.lit("，公开信息不足以支撑判断，需要补充调研。"))
    return (
        F.when(F.size(verdicts) == 0, "本轮没有可用的判断标准，无法给出匹配结论。")
        .when(scored["match_level"] == vocab.FULL, full)
        .when(scored["match_level"] == vocab.PARTIAL, F.when(scored["hard_miss"], missed).otherwise(open_))
        .otherwise(rest)
    )


def company_source(evidence: Column, category: Column) -> Column:
    """Address that backs a criterion: the contact page for reachability, else the about page, else the first."""
    suffix = F.when(category == "reachability", "/contact").otherwise("/about")
    return F.coalesce(F.get(F.filter(evidence, lambda e: e["url"].endswith(suffix)), F.lit(0))["url"], F.get(evidence, F.lit(0))["url"], F.lit(""))


def person_sources(evidence: Column, category: Column) -> Column:
    """Up to three distinct addresses: team page or posts first where the category asks for them."""
    first = F.get(evidence, F.lit(0))["url"]
    team = F.get(F.filter(evidence, lambda e: F.contains(e["url"], F.lit("/team"))), F.lit(0))["url"]
    post = F.get(F.filter(evidence, lambda e: F.contains(e["url"], F.lit("/posts/"))), F.lit(0))["url"]
    order = (
        F.when(category == "reachability", F.array(F.coalesce(team, first), post))
        .when(category == "signal", F.when(post.isNotNull(), F.array(post, first, team)).otherwise(F.array(first)))
        .otherwise(F.array(first, team, post))
    )
    return F.slice(F.array_distinct(F.filter(order, lambda u: u.isNotNull() & (u != ""))), 1, 3)


def judge(records: DataFrame, people: bool = False) -> DataFrame:
    """Records with an array ``criteria`` get verdicts, score, ratio, match_level, hard_miss and match_reason."""
    one = judge_person if people else judge_company
    verdicts = F.transform(
        "criteria", lambda c: F.struct(c["name"].alias("criterion"), c["category"].alias("category"), c["weight"].alias("weight"), hard(c).alias("hard"), one(c).alias("verdict"))
    )
    out = records.withColumn("verdicts", verdicts).withColumn("scored", score_verdicts(F.col("verdicts")))
    return out.withColumn("match_reason", compose_reason(F.col("verdicts"), F.col("scored"), people)).select(*records.columns, "verdicts", "scored.*", "match_reason")


def rejudge(rows: DataFrame, records: DataFrame, people: bool = False) -> DataFrame:
    """rows (list_id, row_key, score, match_level, match_reason, criteria) judged anew where a record (row_key, ...) exists.

    A row stays one row: of several records of a key the first as text counts, and rows that repeat a key are judged each.
    """
    out = ("list_id", "row_key", "score", "match_level", "match_reason")
    one = one_of_each(records, ["row_key"])
    new = judge(rows.select("list_id", "row_key", "criteria").join(one, "row_key"), people)
    return new.select(*out).unionByName(rows.join(one.select("row_key"), "row_key", "left_anti").select(*out))


def evaluation_rows(judged: DataFrame, people: bool = False) -> DataFrame:
    """One row per record and criterion."""
    source = (lambda v: F.get(person_sources(F.col("evidence"), v), F.lit(0))) if people else (lambda v: company_source(F.col("evidence"), v))
    rows = judged.select("list_id", "row_key", "evidence", F.posexplode("verdicts").alias("pos", "v"))
    return rows.select("list_id", "row_key", "pos", F.col("v.criterion").alias("condition"), F.col("v.verdict").alias("status"), F.col("v.weight").alias("weight"), F.coalesce(source(F.col("v.category")), F.lit("")).alias("source_url"))


def row_references(evidence: Column, name: Column, address: Column, label: Column | None = None) -> Column:
    """array<struct<title, url>> of the evidence links, else a company's home page.

    With a ``label``, of the source of a person's profile, the address is the profile's; a person without one has no link.
    """
    links = F.transform(evidence, lambda e: F.struct(e["title"].alias("title"), e["url"].alias("url")))
    link = lambda title, url: F.array(F.struct(title.alias("title"), url.alias("url")))
    if label is None:
        own = link(F.concat(name, F.lit("（官网首页）")), F.concat(F.lit("https://"), address))
    else:
        own = F.when(address != "", link(F.concat(name, F.lit(" · "), F.when(label != "", label).otherwise("公开档案")), address)).otherwise(F.array().cast("array<struct<title: string, url: string>>"))
    return F.when(F.size(evidence) > 0, links).otherwise(own)
