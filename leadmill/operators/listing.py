"""Rows of lists: building, filtering, sorting, paging.

Places in a list come from ``ranks.numbered``, so a list with most of the rows is sorted by all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill import vocab
from leadmill.functions.text import row_key
from leadmill.operators.ranks import MOST, free, numbered, same_keys


def level_order(level: Column) -> Column:
    return F.when(level == vocab.FULL, 0).when(level == vocab.PARTIAL, 1).when(level == vocab.UNCONFIRMED, 2).otherwise(9)


def build_rows(judged: DataFrame, started: Column, people: bool = False, most: int = MOST) -> DataFrame:
    """Judged records (list_id, seed, pos, ...) to rows: id by seed and position, states, time of creation."""
    place = free(judged.columns, "at")
    rows = numbered(judged, ["list_id"], ["pos"], place, most)
    at = F.col(place) - 1
    lacks = lambda c: F.array_contains("missing_fields", c)
    key = row_key(F.col("source_url"), F.col("name")) if people else row_key(F.col("domain"), F.col("name"))
    reach = (F.col("contact_email") != "") | (F.col("contact_phone") != "") if people else ~lacks("contacts")
    count = F.when(reach, 1).otherwise(0) if people else F.col("contact_count")
    own = [] if people else [F.when(lacks("official_contact"), "blocked").otherwise("ready").alias("official_contact_state")]
    return rows.select(
        "list_id", F.concat(F.lit("row-"), F.col("seed").cast("string"), F.lit("-"), at.cast("string")).alias("row_id"), at.alias("pos"), key.alias("row_key"), "name", "score", "match_level", "match_reason",
        F.when(lacks("summary"), "failed").otherwise("ready").alias("summary_state"), F.when(reach, "ready").otherwise("failed").alias("contact_state"), *own, count.cast("long").alias("contact_count"),
        (started + F.make_dt_interval(secs=at * 7)).alias("created_at"),
    )


def search_text(people: bool = False) -> Column:
    plain = ("name", "name_local", "title", "company", "company_domain", "source_url", "summary", "location") if people else ("name", "domain", "summary", "location")
    return F.concat_ws(" ", *plain, *([] if people else [F.col("industries")]))


def filter_rows(rows: DataFrame, keyword: str = "", match_level: str = "", people: bool = False) -> DataFrame:
    out = rows.where(F.col("match_level") == match_level) if match_level else rows
    return out.where(F.contains(F.lower(search_text(people)), F.lit(keyword.lower()))) if keyword else out


def order_by(sort: str = "match", address: str = "row_key") -> list[Column]:
    """Sort columns; ties keep the order of recall."""
    first = {"name": [F.col("name")], "website": [F.col(address)]}.get(sort, [level_order(F.col("match_level")), F.col("score").desc()])
    return [*first, F.col("pos")]


def sort_rows(rows: DataFrame, sort: str = "match", most: int = MOST) -> DataFrame:
    """With the place of each row in its list."""
    return numbered(rows, ["list_id"], order_by(sort), "place", most)


def page_rows(rows: DataFrame, lists: DataFrame, page: int, size: int, keyword: str = "", match_level: str = "", sort: str = "match", people: bool = False, most: int = MOST) -> DataFrame:
    """One page of each list with the total: the discovered prefix, filtered, sorted, cut."""
    seen = rows.join(lists.select("list_id", "discovered_count"), "list_id").where("pos < discovered_count").drop("discovered_count")
    chosen = filter_rows(seen, keyword, match_level, people)
    totals = chosen.groupBy("list_id").agg(F.count("*").alias("total"))
    return same_keys(sort_rows(chosen, sort, most).where(F.col("place").between((page - 1) * size + 1, page * size)), totals, ["list_id"], "inner")


def blocked_rows(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected rows without a deep dive yet."""
    return rows.join(selected.select("list_id", "row_id").distinct(), ["list_id", "row_id"], "left_semi").where("coalesce(dossier_state, 'blocked') <> 'ready'")


def keyword_search(df: DataFrame, keyword: str, first: str, second: str) -> DataFrame:
    """Rows with the keyword in either column, in any case."""
    word = F.lit(keyword.strip().lower())
    return df.where((word == "") | F.contains(F.lower(first), word) | F.contains(F.lower(second), word))


def recent_first(df: DataFrame, n: int, at: str = "created_at", tie: str = "id") -> DataFrame:
    return df.orderBy(F.col(at).desc(), tie).limit(n)


def opportunity_page(opportunities: DataFrame, page: int, level: str = "", size: int = 8) -> DataFrame:
    """One page per owner of the opportunities of a level; pages out of range are clamped."""
    chosen = opportunities.where(F.col("level") == level) if level else opportunities
    w = Window.partitionBy("owner")
    ranked = chosen.withColumn("place", F.row_number().over(w.orderBy(F.col("last_message_at").desc(), "id"))).withColumn("total", F.count("*").over(w))
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / size))
    at = F.least(F.greatest(F.lit(page), F.lit(1)), pages)
    return ranked.where((F.col("place") > (at - 1) * size) & (F.col("place") <= at * size)).withColumn("page", at.cast("int"))


def row_research_state(rows: DataFrame, people: bool = False) -> DataFrame:
    """What research found per row; ready needs content. For people: contact and completeness of the profile."""
    if people:
        reached = (F.col("contact_state") == "ready") & (F.col("contact_count") > 0)
        whole = (F.col("summary_state") == "ready") & (F.col("title") != "")
        return rows.select(
            "list_id", "row_id", F.when(reached, "ready").otherwise("failed").alias("contact_state"), F.when(reached, "已获取邮箱或电话").otherwise("未找到结果").alias("contact_summary"),
            F.when(whole, "ready").otherwise("blocked").alias("profile_state"), F.when(whole, "职位与归属齐备").otherwise("缺少职位或所属机构").alias("profile_summary"),
        )
    contact = (F.col("contact_state") == "ready") & (F.col("contact_count") > 0)
    official = (F.col("official_contact_state") == "ready") & (F.trim("official_note") != "")
    return rows.select(
        "list_id", "row_id", F.col("contact_state").alias("contacts_state"), F.when(contact, F.concat(F.lit("已挖掘到 "), F.col("contact_count").cast("string"), F.lit(" 位"))).otherwise("未找到结果").alias("contacts_summary"),
        F.when(official, "ready").when(F.col("official_contact_state") == "ready", "ready").otherwise(F.col("official_contact_state")).alias("official_state"), F.when(official, F.trim("official_note")).otherwise("未找到结果").alias("official_summary"),
    )
