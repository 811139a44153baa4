"""Schemas of the records. Missing text is an empty string, never null."""

from __future__ import annotations

EVIDENCE = "struct<title: string, url: string, snippet: string>"
COMPANY = (
    "external_id string, name string, domain string, industries array<string>, summary string, location string, employees string, "
    f"funding_stage string, contact_count int, evidence array<{EVIDENCE}>, missing_fields array<string>, source_id string, attributes map<string, string>"
)
PERSON = (
    "external_id string, name string, title string, company string, company_domain string, name_local string, location string, summary string, "
    "source_label string, source_url string, aliases array<string>, keywords array<string>, contact_email string, contact_phone string, "
    f"confidence int, evidence array<{EVIDENCE}>, missing_fields array<string>, source_id string, attributes map<string, string>"
)
CONTACT = "external_id string, name string, title string, email string, phone string, linkedin string, domain string, confidence int, source_id string"
WEB_RESULT = "query_id string, rank int, url string, title string, content string, website string, date string"
CRITERION = (
    "struct<id: string, name: string, question: string, category: string, weight: int, tokens: array<string>, expected: string, rationale: string, lenient: boolean>"
)
VERDICT = "struct<criterion: string, category: string, weight: int, hard: boolean, verdict: string>"
MASTER = "dedupe_key string, name string, first_source string, first_seen_at timestamp, last_seen_at timestamp, last_source string, seen_count long"
KINDS = {"company": COMPANY, "person": PERSON, "contact": CONTACT, "web_result": WEB_RESULT}
