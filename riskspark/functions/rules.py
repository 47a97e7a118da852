"""Domain weights and the graph of related domains."""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# Weight of a domain in materiality.
DOMAIN_WEIGHT = {
    "admissions": 0.90, "placements": 0.90, "academics": 0.88, "faculty": 0.88, "finance": 0.88,
    "retention": 0.86, "accreditation": 0.85, "compliance": 0.85, "research": 0.78, "infrastructure": 0.76,
    "grievances": 0.75, "attendance": 0.74, "ranking": 0.74, "internships": 0.72, "industry": 0.70,
    "feedback": 0.70, "students": 0.72, "general_institutional": 0.60,
}
DEFAULT_DOMAIN_WEIGHT = 0.70

# Domains to inspect when a signal of the key domain changes.
RELATED_DOMAINS = {
    "placements": ["internships", "industry", "academics", "feedback", "faculty", "admissions"],
    "admissions": ["ranking", "placements", "feedback", "accreditation", "infrastructure", "faculty"],
    "academics": ["attendance", "faculty", "grievances", "infrastructure", "retention", "feedback"],
    "retention": ["attendance", "academics", "grievances", "finance", "faculty", "feedback"],
    "faculty": ["finance", "research", "grievances", "academics", "retention"],
    "research": ["faculty", "finance", "industry", "infrastructure", "accreditation"],
    "finance": ["admissions", "faculty", "infrastructure", "compliance", "research"],
    "accreditation": ["faculty", "research", "academics", "infrastructure", "placements", "compliance"],
    "compliance": ["accreditation", "finance", "faculty", "infrastructure", "grievances"],
    "grievances": ["faculty", "infrastructure", "academics", "retention", "feedback", "attendance"],
    "attendance": ["academics", "retention", "grievances", "faculty", "feedback"],
    "internships": ["industry", "placements", "academics", "feedback"],
    "industry": ["internships", "placements", "research", "academics"],
    "feedback": ["academics", "faculty", "infrastructure", "grievances", "placements"],
    "infrastructure": ["finance", "academics", "research", "feedback", "grievances"],
    "ranking": ["admissions", "placements", "research", "accreditation", "faculty"],
    "students": ["admissions", "retention", "attendance", "grievances", "feedback"],
    "general_institutional": ["academics", "finance", "faculty", "admissions", "placements"],
}


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def domain_weight(domain: Column) -> Column:
    return F.coalesce(literal_map(DOMAIN_WEIGHT)[domain], F.lit(DEFAULT_DOMAIN_WEIGHT))


def related_domains(domain: Column) -> Column:
    """Array of related domains; the fixed graph travels as a map literal, so no join is needed."""
    entries = chain.from_iterable(
        (F.lit(k), F.array(*[F.lit(x) for x in v])) for k, v in RELATED_DOMAINS.items())
    return F.coalesce(F.create_map(*entries)[domain], F.array().cast("array<string>"))
