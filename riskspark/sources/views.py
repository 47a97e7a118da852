"""Canonical tables projected from the raw parquet tables (definitions in FIXTURES.md, part B)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from riskspark.functions.num import rnd
from riskspark.session import stage

CELL = ["institution_id", "department", "academic_year"]


class Views:
    """Lazy canonical views over one folder of raw tables.

    ``staged(name)`` materializes a view once per query when several branches of a plan read it; the raw
    tables are then scanned and shuffled a single time.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # all times of the model are UTC
        self._staged: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def staged(self, name: str) -> DataFrame:
        if name not in self._staged:
            self._staged[name] = stage(getattr(self, name)())
        return self._staged[name]

    def canonical(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Admissions, placements and ranking rows, each staged."""
        cells = self.staged("cells")
        return self._admissions(cells), self.staged("placements"), self._ranking(cells)

    # ---- dimensions -------------------------------------------------------------------------
    def institutions(self) -> DataFrame:
        n, r = self.table("nation"), self.table("region")
        k = F.col("n_nationkey")
        return n.join(r, n.n_regionkey == r.r_regionkey).select(
            F.col("n_name").alias("institution_id"),
            F.col("r_name").alias("organization_id"),
            F.when(k % 4 == 0, "school").when(k % 4 == 1, "engineering").when(k % 4 == 2, "medical")
            .otherwise("college").alias("institution_type"),
            (k * 5 - 60).cast("double").alias("latitude"),
            (k * 13 - 160).cast("double").alias("longitude"),
            k.alias("inst_no"),
        )

    def _order_slots(self) -> DataFrame:
        """Orders with institution, department and year."""
        n = self.table("nation").select("n_nationkey", "n_name")
        c = self.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        o = self.table("orders")
        return (
            o.join(c, o.o_custkey == c.c_custkey)
            .join(n, c.c_nationkey == n.n_nationkey)
            .select(
                F.col("n_name").alias("institution_id"),
                F.col("c_mktsegment").alias("department"),
                (F.year("o_orderdate") + 23).alias("academic_year"),
                "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
            )
        )

    # ---- canonical tables -------------------------------------------------------------------
    def cells(self) -> DataFrame:
        """One aggregation of the orders gives both the admissions and the ranking rows."""
        return self._order_slots().groupBy(*CELL).agg(
            F.count("*").cast("int").alias("sanctioned_intake"),
            F.count_if(F.col("o_orderstatus") != "O").cast("int").alias("enrolled_count"),
            F.min("o_totalprice").alias("lo_price"),
            F.max("o_totalprice").alias("hi_price"),
            F.count_if(F.substring("o_orderpriority", 1, 1).isin("1", "2")).alias("n_priority"),
        )

    @staticmethod
    def _admissions(cells: DataFrame) -> DataFrame:
        vac = F.col("sanctioned_intake") - F.col("enrolled_count")
        return cells.select(
            *CELL, "sanctioned_intake", "enrolled_count",
            vac.alias("vacancy_count"),
            rnd(vac / F.col("sanctioned_intake"), 4).alias("vacancy_rate"),
        )

    @staticmethod
    def _ranking(cells: DataFrame) -> DataFrame:
        opening = F.greatest(F.lit(1), F.floor(F.col("lo_price") / 100).cast("int"))
        return cells.select(
            *CELL,
            opening.alias("opening_rank"),
            F.greatest(opening, F.floor(F.col("hi_price") / 100).cast("int")).alias("closing_rank"),
            rnd(F.lit(100.0) * F.col("n_priority") / F.col("sanctioned_intake"), 2).alias("percentile_cutoff"),
        )

    def admissions(self) -> DataFrame:
        return self._admissions(self.cells())

    def ranking(self) -> DataFrame:
        return self._ranking(self.cells())

    def placements(self) -> DataFrame:
        """Lines collapse map-side to one row per price, and apart from that to one per recruiter (nearly every line has a pair of its own), so the exact
        median is found by running sums of counted prices and no cell buffers its prices."""
        li = self.table("lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_returnflag")
        lines = li.join(self._order_slots().select(*CELL, "o_orderkey"), li.l_orderkey == F.col("o_orderkey"))
        recruiters = lines.select(*CELL, "l_suppkey").distinct().groupBy(*CELL).agg(F.count("*").cast("int").alias("top_tier_recruiters"))
        hist = lines.groupBy(*CELL, F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents")).agg(
            F.count("*").alias("n"), F.count_if(F.col("l_returnflag") != "R").alias("n_placed"))
        priced = F.when(F.col("cents").isNotNull(), F.col("n")).otherwise(0)
        hist = hist.withColumns({"upto": F.sum(priced).over(W.partitionBy(*CELL).orderBy("cents").rowsBetween(W.unboundedPreceding, W.currentRow)),
                                 "all": F.sum(priced).over(W.partitionBy(*CELL))})
        middle = lambda odd: F.min(F.when(2 * F.col("upto") > F.col("all") - odd, F.col("cents")))  # the lower and the upper of the two middle prices
        g = hist.groupBy(*CELL).agg(
            F.sum("n").cast("int").alias("eligible_students"),
            F.sum("n_placed").cast("int").alias("placed_students"),
            ((0.5 * middle(1) + 0.5 * middle(0)) / 1000000.0).alias("median_salary_lpa"),
            rnd(F.max("cents") / 1000000.0, 4).alias("max_salary_lpa"),
        )
        return g.join(recruiters, CELL).select(
            *CELL, F.col("academic_year").alias("graduation_year"),
            "eligible_students", "placed_students",
            rnd(F.lit(100.0) * F.col("placed_students") / F.col("eligible_students"), 2).alias("placement_percentage"),
            "median_salary_lpa", "max_salary_lpa", "top_tier_recruiters",
            (F.col("eligible_students") - F.col("placed_students")).alias("unplaced_count"),
        )

    # ---- long signals -----------------------------------------------------------------------
    DOMAIN_OF = {"view": "attendance", "click": "feedback", "purchase": "finance",
                 "signup": "internships", "error": "grievances"}

    def _event_slots(self) -> DataFrame:
        n = self.table("nation").select("n_nationkey", "n_name")
        e = self.table("events")
        dom = F.create_map(*[F.lit(x) for kv in self.DOMAIN_OF.items() for x in kv])
        return e.join(n, (F.col("user_id") % 25) == F.col("n_nationkey")).select(
            F.col("n_name").alias("institution_id"),
            dom[F.col("event_type")].alias("domain"),
            F.concat(F.col("event_type"), F.lit("_value")).alias("metric_name"),
            F.initcap(F.concat(F.col("event_type"), F.lit(" value"))).alias("metric_label"),
            (F.lit(2019) + F.floor((F.dayofmonth("ts") - 1) / 5)).cast("int").alias("academic_year"),
            F.when(F.col("event_type") == "error", "lower_is_better").otherwise("higher_is_better").alias("polarity"),
            "event_id", "value", "ts", "user_id",
        )

    def signals(self) -> DataFrame:
        """Institution-wide yearly observations of five dynamic domains (department is null)."""
        g = self._event_slots().groupBy(
            "institution_id", "domain", "metric_name", "metric_label", "academic_year", "polarity"
        ).agg(F.avg("value").alias("v"), F.count("*").alias("n"), F.min("event_id").alias("seq"))
        val = rnd(F.col("v"), 4)
        return g.select(
            F.concat_ws(":", "institution_id", "metric_name", "academic_year").alias("signal_id"),
            "institution_id", "domain", "metric_name", "metric_label",
            F.lit(None).cast("string").alias("department"),
            "academic_year", val.alias("value"), val.cast("string").alias("raw_value"),
            F.lit("count").alias("unit"), "polarity",
            # higher-is-better series carry the shortfall against 60, error rates carry the excess over 40
            F.when(F.col("polarity") == "lower_is_better", rnd(F.least(F.lit(1.0), val / 100.0), 3))
            .otherwise(rnd(F.greatest(F.lit(0.0), (F.lit(60.0) - val) / 60.0), 3)).alias("risk_contribution"),
            F.lit(False).alias("is_contradictory"), F.lit(False).alias("is_duplicate"),
            rnd(F.lit(0.80) + F.lit(0.01) * (F.col("n") % 20), 2).alias("confidence"),
            F.col("seq"),
            F.concat(F.lit("doc_"), F.col("domain")).alias("document"),
        )

    def signals_full(self) -> DataFrame:
        """The dynamic signals plus vacancy rates reported a second time at one decimal, so that identical
        repeats and conflicting figures of canonical metrics both occur."""
        val = rnd(F.col("vacancy_rate"), 1)
        again = self._admissions(self.staged("cells")).select(
            F.concat_ws(":", F.lit("again"), "institution_id", "department", "academic_year").alias("signal_id"),
            "institution_id", F.lit("admissions").alias("domain"), F.lit("vacancy_rate").alias("metric_name"),
            F.lit("Seat vacancy").alias("metric_label"), "department", "academic_year", val.alias("value"),
            val.cast("string").alias("raw_value"), F.lit("ratio").alias("unit"),
            F.lit("lower_is_better").alias("polarity"), F.least(F.lit(1.0), val * 1.5).alias("risk_contribution"),
            F.lit(False).alias("is_contradictory"), F.lit(False).alias("is_duplicate"),
            F.lit(0.90).alias("confidence"), F.lit(-1).cast("bigint").alias("seq"),
            F.lit("doc_admissions").alias("document"))
        return self.signals().unionByName(again)

    def signals_dup(self) -> DataFrame:
        """Event-level observations of the same slots; even event ids are stored already, odd ones are new."""
        return self._event_slots().select(
            F.col("event_id").cast("string").alias("signal_id"),
            "institution_id", "domain", "metric_name", "metric_label",
            F.concat(F.lit("D"), F.col("user_id") % 4).alias("department"),
            F.lit(None).cast("string").alias("program"),
            "academic_year", F.floor(F.col("value") / 10).cast("double").alias("value"),
            F.floor(F.col("value") / 10).cast("string").alias("raw_value"),
            F.lit("count").alias("unit"), "polarity",
            (F.col("event_id") % 2 == 1).alias("is_new"),
            F.col("event_id").alias("seq"),
            F.concat(F.lit("ing_"), F.col("user_id") % 7).alias("ingestion_id"),
            rnd(F.lit(0.80) + F.lit(0.01) * (F.col("event_id") % 20), 2).alias("confidence"),
            F.concat(F.lit("R"), F.col("event_id").cast("string")).alias("location"),
            "ts",
        )

    # ---- event side -------------------------------------------------------------------------
    def articles(self) -> DataFrame:
        """Documents as news articles: the first line is the title, the whole text the summary."""
        d = self.table("documents")
        i = F.col("doc_id")
        return d.select(
            i.alias("arrival"),
            F.trim(F.substring_index("text", "\n", 1)).alias("title"),
            F.col("text").alias("summary"),
            F.col("source").alias("publisher"),
            F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), i.cast("string")).alias("url"),
            F.col("lang").alias("country"),
            F.concat(F.lit("c"), (i % 7).cast("string")).alias("city"),
            (F.lit(1704067200) + i * 1020).alias("published_s"),
            F.element_at(F.array(*[F.lit(x) for x in EVENT_TYPES]), (i % 9 + 1).cast("int")).alias("event_type"),
            F.element_at(F.array(*[F.lit(x) for x in SEVERITIES]), ((i % 10) / 3 + 1).cast("int")).alias("severity"),
            F.when(i % 7 != 0, (i * 37 % 1200) / 10.0 - 60).alias("latitude"),
            F.when(i % 7 != 0, (i * 91 % 3600) / 10.0 - 180).alias("longitude"),
            F.when(i % 11 == 0, "RESOLVED").otherwise("ACTIVE").alias("status"),
        )

    def events(self) -> DataFrame:
        a = self.articles()
        return a.select(
            F.concat(F.lit("evt_"), F.col("arrival").cast("string")).alias("event_id"),
            "arrival", "title", F.col("summary").alias("description"), "event_type",
            "published_s", F.timestamp_seconds("published_s").alias("first_observed"),
            "country", "city", "latitude", "longitude", "severity", "status",
            F.col("publisher").alias("source_id"),
            F.substring(F.sha2(F.col("summary"), 256), 1, 16).alias("origin_hash"),
            F.lit(0.75).alias("confidence"),
            F.when(F.col("arrival") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(
                F.concat(F.lit("org_"), F.col("arrival") % 5), F.concat(F.lit("place_"), F.col("arrival") % 11))).alias("entities"),
        )

    def sources(self) -> DataFrame:
        no = F.regexp_replace("source", "[^0-9]", "").try_cast("int")
        return self.table("documents").select("source").distinct().select(
            F.col("source").alias("source_id"),
            F.concat(F.lit("g"), (no % 8).cast("string")).alias("independence_group"),
            (no % 5 == 0).alias("is_official_source"),
            rnd(F.lit(0.70) + F.lit(0.01) * no, 2).alias("reliability"),
        )

    def geo_queries(self) -> DataFrame:
        return self.institutions().select(
            F.col("institution_id").alias("query_id"),
            F.col("latitude").alias("q_lat"), F.col("longitude").alias("q_lon"),
            F.lit(500.0).alias("radius_km"), F.lit(240).alias("hours_back"),
        )

    def readings(self) -> DataFrame:
        """One reported reading per part: a metric label, its raw text and a context phrase."""
        p = self.table("part")
        k = F.col("p_partkey")
        pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i % len(xs) + 1).cast("int"))
        cents = F.floor(F.col("p_retailprice") * 100).cast("bigint")
        n = (cents % 1000).cast("string")
        dec = F.concat((cents % 97).cast("string"), F.lit("."), (cents % 10).cast("string"))
        raw = F.element_at(F.array(
            F.concat(dec, F.lit("%")), n, F.concat(F.lit("~"), dec, F.lit("%")),
            F.concat(n, F.lit(" - "), (cents % 1000 + 7).cast("string")), F.concat(dec, F.lit(" LPA")),
            F.concat(F.lit("1,"), F.lpad(n, 3, "0"), F.lit(" lakhs")), F.lit("TBD"), F.lit(""),
            F.concat(F.lit("approx "), n), F.lit("2023-24")), (cents % 10 + 1).cast("int"))
        return p.select(
            k.alias("rid"), F.concat(F.lit("I"), F.col("p_size").cast("string")).alias("institution_id"),
            F.concat(pick(LABELS, k), F.when(k % 4 == 0, F.concat(F.lit(" - "), F.translate("p_brand", "#", " "))).otherwise("")).alias("label"),
            raw.alias("raw_value"), pick(CONTEXTS, F.floor(k / 7)).alias("ctx"),
            F.concat(F.lit("doc_"), (k % 40).cast("string"), F.lit("_report (2).xlsx")).alias("document"))

    def lines(self) -> DataFrame:
        """Text lines carrying one reading each, in the three spellings the extractors read."""
        r = self.readings()
        k = F.col("rid")
        return r.select(
            F.col("institution_id").alias("doc"), k.alias("line_no"), "ctx",
            F.when(k % 3 == 0, F.concat(F.lit("- "), F.regexp_replace("label", " - ", " / "), F.lit(": "), F.col("raw_value")))
            .when(k % 3 == 1, F.concat(F.lit("| "), F.col("label"), F.lit(" | "), F.col("raw_value"), F.lit(" |")))
            .otherwise(F.concat(F.lit("In AY 2022 the reported "), F.lower("label"), F.lit(" reached "), F.col("raw_value"), F.lit(" overall")))
            .alias("text"))


# Fixed values of the reading fixtures.
LABELS = ["Faculty Attrition Rate", "Research Grants", "Student Attendance %", "Pending Grievances", "Budget Deficit",
          "Lab Utilization", "Compliance Violations", "Placement Percentage", "Closing Rank", "NAAC Score",
          "Seat Vacancy", "Sanctioned Intake", "Median Salary", "Mentoring hours per cohort", "Hostel fee dues",
          "Retention Rate", "Internship Count", "Active MoUs", "Employer Satisfaction", "Pass Percentage",
          "Total admission enquiries", "Canteen hygiene index", "Library Volumes"]
CONTEXTS = ["Dept of Physics AY 2023-24", "B.E. in Computer Science and Engineering 2022", "MBA batch 2021-2022",
            "annual note", "Civil Engg 2019", "ECE report for AY 2020", "M.Tech in VLSI", "School of Law, session 2018 - 19"]

# Fixed values of the event fixtures.
EVENT_TYPES = ["infrastructure_disruption", "cyber_threat", "supply_chain", "climate_environmental", "conflict",
               "military", "humanitarian", "geopolitical", "general_osint"]
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
