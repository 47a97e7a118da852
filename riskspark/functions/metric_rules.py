"""Metric vocabulary, broad domain words, context patterns and header aliases."""

# Fixed values: (domain, pattern, metric, unit, polarity); the first pattern found in a lower-cased label wins.
METRIC_RULES = [
    ("admissions", r"sanctioned\s*intake|approved\s*intake|total\s*seats|seat\s*capacity", "sanctioned_intake", "count", "neutral"),
    ("admissions", r"admitted\s*students|total\s*admitted|enrolled\s*first\s*year|admissions\s*count|seats\s*filled", "admitted_students", "count", "higher_is_better"),
    ("admissions", r"vacancy\s*rate|seat\s*vacancy|unfilled\s*seats\s*%|vacant\s*ratio", "vacancy_rate", "ratio", "lower_is_better"),
    ("admissions", r"admission\s*fill\s*rate|enrollment\s*ratio|occupancy\s*rate", "admission_fill_rate", "%", "higher_is_better"),
    ("admissions", r"applications\s*received|applicant\s*count", "applications_received", "count", "higher_is_better"),
    ("placements", r"placement\s*percentage|placement\s*rate|placed\s*%|%\s*placed|campus\s*placement\s*rate", "placement_percentage", "%", "higher_is_better"),
    ("placements", r"eligible\s*students|placement\s*eligible", "eligible_students", "count", "neutral"),
    ("placements", r"placed\s*students|total\s*placed|students\s*placed|job\s*offers\s*accepted", "placed_students", "count", "higher_is_better"),
    ("placements", r"median\s*salary|average\s*package|median\s*package|avg\s*ctc|median\s*ctc", "median_salary_lpa", "LPA", "higher_is_better"),
    ("placements", r"highest\s*package|max\s*ctc|top\s*package", "highest_salary_lpa", "LPA", "higher_is_better"),
    ("ranking", r"closing\s*rank|cet\s*cutoff|cutoff\s*rank|last\s*admitted\s*rank", "closing_rank", "rank", "lower_is_better"),
    ("ranking", r"opening\s*rank|first\s*admitted\s*rank", "opening_rank", "rank", "lower_is_better"),
    ("ranking", r"nirf\s*rank|national\s*rank|institutional\s*rank", "institutional_rank", "rank", "lower_is_better"),
    ("faculty", r"faculty\s*attrition|faculty\s*turnover|teacher\s*attrition|faculty\s*resignation", "faculty_attrition_rate", "%", "lower_is_better"),
    ("faculty", r"faculty\s*count|total\s*faculty|teaching\s*staff\s*strength|faculty\s*strength", "faculty_count", "count", "higher_is_better"),
    ("faculty", r"phd\s*faculty|doctorate\s*faculty|faculty\s*with\s*phd", "phd_faculty_pct", "%", "higher_is_better"),
    ("faculty", r"faculty\s*vacancy|vacant\s*faculty\s*posts|unfilled\s*faculty", "faculty_vacancy_rate", "%", "lower_is_better"),
    ("faculty", r"student\s*faculty\s*ratio|sfr|student\s*teacher\s*ratio|str", "student_faculty_ratio", "ratio", "lower_is_better"),
    ("students", r"total\s*students|student\s*strength|total\s*enrollment|active\s*students", "total_student_strength", "count", "higher_is_better"),
    ("students", r"scholarship\s*recipients|students\s*on\s*scholarship", "scholarship_students", "count", "higher_is_better"),
    ("students", r"female\s*students\s*%|gender\s*diversity\s*%|women\s*enrollment", "female_enrollment_pct", "%", "higher_is_better"),
    ("students", r"hostel\s*occupancy", "hostel_occupancy_pct", "%", "higher_is_better"),
    ("academics", r"pass\s*percentage|pass\s*rate|exam\s*pass\s*%|graduation\s*rate|result\s*%", "pass_percentage", "%", "higher_is_better"),
    ("academics", r"backlog\s*rate|fail\s*percentage|arrears\s*%|students\s*with\s*backlogs", "backlog_rate", "%", "lower_is_better"),
    ("academics", r"average\s*cgpa|mean\s*gpa", "average_cgpa", "score", "higher_is_better"),
    ("academics", r"curriculum\s*revision|syllabus\s*update", "curriculum_revisions", "count", "higher_is_better"),
    ("research", r"research\s*publications|published\s*papers|scopus\s*papers|sci\s*publications|journal\s*papers", "research_publications", "count", "higher_is_better"),
    ("research", r"research\s*grants|sponsored\s*research|funded\s*projects|extramural\s*funding|grant\s*amount", "research_grants_lakhs", "INR_Lakhs", "higher_is_better"),
    ("research", r"patents\s*filed|patents\s*granted|intellectual\s*property", "patents_count", "count", "higher_is_better"),
    ("research", r"citations\s*count|citation\s*index|h-index", "citations_count", "count", "higher_is_better"),
    ("research", r"consultancy\s*revenue|consultancy\s*income", "consultancy_revenue_lakhs", "INR_Lakhs", "higher_is_better"),
    ("infrastructure", r"lab\s*utilization|laboratory\s*utilization|equipment\s*uptime|lab\s*readiness", "lab_utilization_pct", "%", "higher_is_better"),
    ("infrastructure", r"infrastructure\s*deficiency|lab\s*shortage|classroom\s*shortage|maintenance\s*backlog", "infrastructure_deficiency_pct", "%", "lower_is_better"),
    ("infrastructure", r"library\s*volumes|books\s*count|digital\s*library\s*resources", "library_volumes", "count", "higher_is_better"),
    ("infrastructure", r"internet\s*bandwidth|campus\s*wifi\s*mbps", "internet_bandwidth_mbps", "Mbps", "higher_is_better"),
    ("infrastructure", r"computer\s*student\s*ratio|pc\s*availability", "computer_student_ratio", "ratio", "higher_is_better"),
    ("finance", r"budget\s*deficit|operating\s*deficit|financial\s*deficit|revenue\s*shortfall|fee\s*deficit", "budget_deficit_pct", "%", "lower_is_better"),
    ("finance", r"fee\s*collection|tuition\s*collection\s*rate|revenue\s*realization", "fee_collection_pct", "%", "higher_is_better"),
    ("finance", r"annual\s*budget|total\s*expenditure|operational\s*budget|annual\s*revenue", "annual_budget_lakhs", "INR_Lakhs", "neutral"),
    ("finance", r"salary\s*delay|payroll\s*arrears|unpaid\s*salary\s*months", "salary_delay_months", "months", "lower_is_better"),
    ("finance", r"r&d\s*expenditure|research\s*spend\s*%", "rd_expenditure_pct", "%", "higher_is_better"),
    ("retention", r"retention\s*rate|student\s*retention|cohort\s*retention|continuation\s*rate", "student_retention_rate", "%", "higher_is_better"),
    ("retention", r"dropout\s*rate|student\s*attrition|withdrawal\s*rate|discontinuation\s*rate", "student_dropout_rate", "%", "lower_is_better"),
    ("attendance", r"student\s*attendance|average\s*attendance|class\s*attendance|attendance\s*rate|attendance\s*%", "student_attendance_pct", "%", "higher_is_better"),
    ("attendance", r"chronic\s*absenteeism|attendance\s*shortage|detained\s*for\s*attendance", "attendance_shortage_pct", "%", "lower_is_better"),
    ("attendance", r"faculty\s*attendance", "faculty_attendance_pct", "%", "higher_is_better"),
    ("grievances", r"pending\s*grievances|unresolved\s*grievances|open\s*complaints", "pending_grievances", "count", "lower_is_better"),
    ("grievances", r"grievances\s*filed|total\s*grievances|student\s*complaints|disciplinary\s*incidents|grievance\s*count", "grievances_filed", "count", "lower_is_better"),
    ("grievances", r"grievance\s*resolution\s*rate|complaints\s*resolved\s*%", "grievance_resolution_pct", "%", "higher_is_better"),
    ("internships", r"internship\s*percentage|internship\s*rate|students\s*interning\s*%|internship\s*coverage", "internship_percentage", "%", "higher_is_better"),
    ("internships", r"internship\s*count|total\s*internships|summer\s*internships|industrial\s*training\s*count", "internships_count", "count", "higher_is_better"),
    ("internships", r"ppo\s*conversion|pre-placement\s*offers", "ppo_conversion_count", "count", "higher_is_better"),
    ("industry", r"active\s*mous|industry\s*mous|corporate\s*partnerships|industry\s*collaborations|mou\s*count", "active_mous_count", "count", "higher_is_better"),
    ("industry", r"industry\s*sponsored\s*labs|centers\s*of\s*excellence", "industry_labs_count", "count", "higher_is_better"),
    ("industry", r"corporate\s*projects|live\s*industry\s*projects", "industry_projects_count", "count", "higher_is_better"),
    ("accreditation", r"naac\s*cgpa|naac\s*score|accreditation\s*score", "naac_cgpa", "score", "higher_is_better"),
    ("accreditation", r"nba\s*accredited|accredited\s*programs\s*%", "nba_accredited_programs_pct", "%", "higher_is_better"),
    ("compliance", r"compliance\s*score|statutory\s*compliance\s*%|regulatory\s*compliance", "compliance_score_pct", "%", "higher_is_better"),
    ("compliance", r"deficiency\s*flags|regulatory\s*notices|show\s*cause\s*notices|audit\s*non-compliance|compliance\s*violations", "compliance_deficiencies", "count", "lower_is_better"),
    ("feedback", r"student\s*feedback|student\s*satisfaction|teaching\s*feedback\s*score|course\s*rating", "student_feedback_score", "score", "higher_is_better"),
    ("feedback", r"employer\s*satisfaction|recruiter\s*feedback", "employer_satisfaction_pct", "%", "higher_is_better"),
    ("feedback", r"alumni\s*feedback|alumni\s*satisfaction", "alumni_satisfaction_pct", "%", "higher_is_better"),
]

# Words that place an unknown label in a domain, in this order.
DOMAIN_WORDS = [
    ("admissions", ["admission", "intake", "enrol", "seat", "applicant"]),
    ("placements", ["placement", "placed", "recruiter", "ctc", "package", "salary", "offer"]),
    ("ranking", ["rank", "cutoff", "cet", "comedk", "jee"]),
    ("faculty", ["faculty", "professor", "teacher", "lecturer", "staff", "sfr"]),
    ("research", ["research", "publication", "paper", "patent", "grant", "citation", "scopus", "consultancy"]),
    ("infrastructure", ["infrastructure", "lab", "classroom", "library", "wifi", "bandwidth", "hostel", "equipment"]),
    ("finance", ["finance", "budget", "revenue", "expenditure", "deficit", "surplus", "fee", "tuition", "audit", "fund"]),
    ("retention", ["retention", "dropout", "attrition", "continuation", "withdrawal"]),
    ("attendance", ["attendance", "absentee", "biometric", "present"]),
    ("grievances", ["grievance", "complaint", "harassment", "ragging", "disciplinary", "ombudsman", "protest"]),
    ("internships", ["internship", "intern", "stipend", "industrial training", "ppo"]),
    ("industry", ["industry", "mou", "corporate", "partner", "collaboration"]),
    ("accreditation", ["accreditation", "naac", "nba", "nirf", "autonomous", "iso"]),
    ("compliance", ["compliance", "statutory", "regulatory", "aicte", "ugc", "deficiency", "violation"]),
    ("feedback", ["feedback", "satisfaction", "rating", "survey", "evaluation"]),
    ("academics", ["academic", "exam", "pass", "cgpa", "gpa", "backlog", "syllabus", "curriculum", "grade"]),
    ("students", ["student", "scholar", "cohort", "learner"]),
]
# Words that tell the direction of an unknown label.
DOWN_WORDS = ["deficit", "attrition", "dropout", "vacancy", "grievance", "complaint", "backlog", "delay", "shortage", "deficiency", "violation"]
UP_WORDS = ["pass", "placement", "retention", "attendance", "satisfaction", "publication", "grant", "collection", "compliance", "utilization"]
# Marks of a figure that is not certain.
AMBIGUOUS = ["~", "approx", "about", "est", "tbd", "n/a", "unknown", "?", "maybe", "to"]

# Metric families of the risk contribution.
FALLING_BASE_40 = ["faculty_attrition_rate", "student_dropout_rate", "backlog_rate", "attendance_shortage_pct",
                   "budget_deficit_pct", "infrastructure_deficiency_pct", "faculty_vacancy_rate"]
RISING_BASE_60 = ["student_attendance_pct", "student_retention_rate", "pass_percentage", "fee_collection_pct",
                  "lab_utilization_pct", "compliance_score_pct", "grievance_resolution_pct"]
COUNT_BASE_25 = ["pending_grievances", "grievances_filed", "compliance_deficiencies"]

# Department patterns in order of precedence.
DEPARTMENT_PATTERNS = [
    (r"\bcse\b|computer\s*science\s*(?:and|&)?\s*eng", "CSE"),
    (r"\baiml\b|ai\s*(?:and|&)\s*ml|artificial\s*intelligence", "AIML"),
    (r"\bise\b|information\s*science", "ISE"),
    (r"\bece\b|electronics\s*(?:and|&)\s*communication", "ECE"),
    (r"\beee\b|electrical\s*(?:and|&)\s*electronics", "EEE"),
    (r"\bmech\b|mechanical\s*eng", "MECH"),
    (r"\bcivil\b|civil\s*eng", "CIVIL"),
    (r"\bmba\b|master\s*of\s*business", "MBA"),
    (r"\bmca\b|master\s*of\s*computer\s*applications", "MCA"),
    (r"\bphysics\b|dept\.?\s*of\s*physics", "PHYSICS"),
    (r"\bchemistry\b|dept\.?\s*of\s*chemistry", "CHEMISTRY"),
    (r"\bmathematics\b|\bmaths\b", "MATHEMATICS"),
    (r"\bbiotech\b|biotechnology", "BIOTECH"),
    (r"\bcommerce\b|b\.?com", "COMMERCE"),
    (r"\blaw\b|school\s*of\s*law", "LAW"),
    (r"\bmedicine\b|general\s*medicine", "MEDICINE"),
]
PROGRAM_PATTERN = (r"\b(?:B\.?E\.?|B\.?Tech\.?|M\.?Tech\.?|MBA|MCA|B\.?Sc\.?|M\.?Sc\.?|B\.?Com\.?|BBA|LL\.?B\.?|MBBS|Ph\.?D\.?)"
                   r"\b(?:\s+in\s+[A-Za-z &]+)?")
PERIOD_PATTERN = r"\b(?:AY\s*)?(20[12]\d(?:\s*-\s*\d{2,4})?)\b"
KEY_VALUE_PATTERN = r"^[-*•]?\s*([A-Za-z][A-Za-z0-9\s/&(),.-]{2,65}?)\s*[:=–—-]\s*([^:;]+)$"
CONTEXT_LABELS = ["department", "program", "institution", "organization", "academic year", "year", "period", "date",
                  "state", "city"]

# Header spellings of each column role, in order of precedence.
HEADER_ROLES = [
    ("institution", ["institution", "institution_id", "institution_name", "college", "college_name", "university", "entity"]),
    ("organization", ["organization", "organization_id", "organization_name", "group", "trust", "society"]),
    ("department", ["department", "dept", "branch", "discipline", "school", "stream"]),
    ("program", ["program", "programme", "course", "degree", "specialization"]),
    ("period", ["year", "academic_year", "ay", "period", "time_period", "graduation_year", "batch", "session", "semester"]),
    ("domain", ["domain", "category", "signal_domain", "area"]),
    ("metric", ["metric", "metric_name", "indicator", "signal", "parameter", "kpi", "measure"]),
    ("value", ["value", "observed_value", "score", "amount", "count", "rate", "percentage", "figure"]),
    ("unit", ["unit", "units", "uom"]),
]
