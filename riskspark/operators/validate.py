"""Contract checks, payload defaults, institution typing and row-level scope."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskspark.functions.num import rnd


def _failed(rules: dict[str, Column]) -> Column:
    """Names of the rules whose condition is violated (a null input counts as a violation)."""
    items = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def _base_rules() -> dict[str, Column]:
    return {
        "institution_id": F.length("institution_id") > 0, "department": F.length("department") > 0,
        "academic_year": F.col("academic_year").between(2000, 2100),
    }


def validate_admissions(df: DataFrame) -> DataFrame:
    i, e, v, r = (F.col(c) for c in ("sanctioned_intake", "enrolled_count", "vacancy_count", "vacancy_rate"))
    return df.withColumn("failed_rules", _failed({
        **_base_rules(), "intake_positive": i > 0, "enrolled_range": e >= 0, "vacancy_range": v >= 0,
        "rate_range": r.between(0.0, 1.0), "enrolled_within_intake": e <= i, "vacancy_matches": v == i - e,
        "rate_matches": F.abs(r - rnd(F.try_divide(v, i), 4)) <= 0.01}))


def validate_placements(df: DataFrame) -> DataFrame:
    e, p, u = F.col("eligible_students"), F.col("placed_students"), F.col("unplaced_count")
    return df.withColumn("failed_rules", _failed({
        **_base_rules(), "graduation_year": F.col("graduation_year").between(2000, 2100), "eligible_positive": e > 0,
        "placed_range": p >= 0, "percentage_range": F.col("placement_percentage").between(0.0, 100.0),
        "salary_range": (F.col("median_salary_lpa") >= 0) & (F.col("max_salary_lpa") >= 0),
        "placed_within_eligible": p <= e, "unplaced_matches": u == e - p,
        "max_above_median": F.col("max_salary_lpa") >= F.col("median_salary_lpa")}))


def validate_ranking(df: DataFrame) -> DataFrame:
    return df.withColumn("failed_rules", _failed({
        **_base_rules(), "opening_rank": F.col("opening_rank") >= 1, "closing_rank": F.col("closing_rank") >= 1,
        "percentile_range": F.col("percentile_cutoff").between(0.0, 100.0)}))


def default_admissions(p: DataFrame) -> DataFrame:
    """Fill the missing fields of an admissions payload from the given ones."""
    i = F.coalesce("sanctioned_intake", F.lit(120))
    e = F.coalesce("enrolled_count", "admitted_students", i)
    v = F.coalesce("vacancy_count", F.greatest(F.lit(0), i - e))
    r = F.coalesce("vacancy_rate", F.when(i > 0, rnd(v / i, 4)).otherwise(0.0))
    return p.select("institution_id", "department", "academic_year", i.alias("sanctioned_intake"),
                    e.alias("enrolled_count"), v.alias("vacancy_count"), r.alias("vacancy_rate"))


def default_placements(p: DataFrame) -> DataFrame:
    placed = F.coalesce("placed_students", F.lit(0))
    e = F.greatest(F.coalesce("eligible_students", "graduating_cohort_size", F.greatest(F.lit(100), placed)), placed)
    u = F.coalesce("unplaced_count", F.greatest(F.lit(0), e - placed))
    pct = F.coalesce("placement_percentage",
                     F.when(e > 0, F.least(F.lit(100.0), rnd(placed / e * 100.0, 2))).otherwise(0.0))
    med = F.coalesce("median_salary_lpa", "average_package_lpa", F.lit(4.5))
    top = F.coalesce("max_salary_lpa", F.greatest(med, med * 1.5))
    return p.select("institution_id", "department", "academic_year",
                    F.coalesce("graduation_year", "academic_year").alias("graduation_year"),
                    e.alias("eligible_students"), placed.alias("placed_students"), u.alias("unplaced_count"),
                    pct.alias("placement_percentage"), med.alias("median_salary_lpa"), top.alias("max_salary_lpa"))


def default_ranking(p: DataFrame) -> DataFrame:
    o = F.coalesce("opening_rank", F.lit(1000))
    c = F.coalesce("closing_rank", F.greatest(o, F.lit(5000)))
    pct = F.coalesce("percentile_cutoff", F.greatest(F.lit(1.0), F.least(F.lit(99.9), rnd(100.0 - c / 1500.0, 2))))
    return p.select("institution_id", "department", "academic_year",
                    F.coalesce("quota_category", F.lit("GM")).alias("quota_category"), o.alias("opening_rank"),
                    c.alias("closing_rank"), pct.alias("percentile_cutoff"))


# Labels of the recognized institution types.
TYPE_LABELS = {
    "school": "High School / K-12", "puc": "Pre-University (PUC / Junior College)",
    "engineering": "Engineering & Technical Institution", "medical": "Medical & Health Sciences Institution",
    "college": "Degree College", "university": "University",
}


def institution_type(df: DataFrame, type_col: str = "institution_type", domain_col: str = "academic_domain") -> DataFrame:
    """Type slug and label from ordered keyword tests over type and domain text."""
    t = F.lower(F.coalesce(type_col, F.lit("")))
    both = F.concat(t, F.lit(" "), F.lower(F.coalesce(domain_col, F.lit(""))))

    def any_of(c: Column, *words: str) -> Column:
        out = c.contains(words[0])
        for w in words[1:]:
            out = out | c.contains(w)
        return out
    own = F.regexp_replace(F.translate(t, " -", "__"), "^_+|_+$", "")
    slug = (
        F.when(any_of(t, "school") | any_of(both, "k-12", "k12"), "school")
        .when(any_of(t, "pre-university", "pre_university", "puc", "pu/", "junior college"), "puc")
        .when(any_of(both, "engineering", "technical", "polytechnic"), "engineering")
        .when(any_of(both, "med", "health", "dental", "nursing", "pharmacy"), "medical")
        .when(any_of(t, "university"), "university").when(any_of(t, "college", "degree"), "college")
        .when(own != "", own).otherwise("institution"))
    label = F.create_map(*[F.lit(x) for kv in TYPE_LABELS.items() for x in kv])
    plain = F.trim(F.translate(F.coalesce(type_col, F.lit("")), "_", " "))
    return df.withColumn("type_slug", slug).withColumn(
        "type_label", F.coalesce(label[F.col("type_slug")], F.when(plain != "", plain), F.lit("Educational Institution")))


# Categories that mark an organization group.
GROUP_CATEGORIES = ["educational_group_network", "nonprofit_trust_society_foundation", "government_public_body",
                    "private_organization"]
GROUP_TYPES = ["educational_group_network", "nonprofit_trust_society", "government_public_body", "private_organization"]
GROUP_EDU_TYPES = ["school group", "college group", "university system", "educational trust",
                   "educational society/sangha", "education network"]


def structural_archetype(df: DataFrame) -> DataFrame:
    """university, organization_group or institution."""
    cat, typ, edu = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in
                     ("entity_category", "entity_type", "education_entity_type"))
    return df.withColumn("archetype", F.when((edu == "university") | (typ == "university"), "university").when(
        cat.isin(GROUP_CATEGORIES) | typ.isin(GROUP_TYPES) | edu.isin(GROUP_EDU_TYPES), "organization_group")
        .otherwise("institution"))


def apply_scope(rows: DataFrame, policies: DataFrame) -> DataFrame:
    """Rows each user may see: one output row per (user, visible row).

    A policy grants a whole organization, one institution, or one institution limited to departments. Each grant
    kind is its own equi-join; the union is de-duplicated per user and row key.
    """
    kind = F.col("scope")
    org = policies.where(kind == "organization").select("user_id", "organization_id")
    inst = policies.where(kind == "institution").select("user_id", "institution_id")
    dept = policies.where(kind == "department").select(
        "user_id", "institution_id", F.upper(F.trim("department")).alias("_d"))
    d = rows.withColumn("_d", F.upper(F.trim("department")))
    cols = ["user_id", *rows.columns]
    seen = (
        d.join(org, "organization_id").select(cols)
        .unionByName(d.join(inst, "institution_id").select(cols))
        .unionByName(d.join(dept, ["institution_id", "_d"]).select(cols))
    )
    return seen.distinct()
