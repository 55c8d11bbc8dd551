"""Fixed values.

The word lists, patterns, thresholds and formats below are fixed: results are
only right when they are exactly these.  They are defaults of operator
parameters, so another vocabulary can be passed instead.
"""

# --- companies ---------------------------------------------------------------
COMPANY_GROUPS = {
    "amazon": ("amazon", "aws", "annapurna labs", "a2z", "amazon web services",
               "amazon.com", "amazon development center"),
    "google": ("google", "alphabet", "deepmind", "waymo", "youtube"),
    "meta": ("meta", "facebook", "instagram", "whatsapp", "oculus"),
    "microsoft": ("microsoft", "github", "linkedin", "azure"),
    "apple": ("apple",),
}
LEGAL_SUFFIX = r"\b(inc\.?|llc|ltd|corp\.?|co\.?|l\.?p\.?|services|u\.?s\.?)\b"

# --- search intent -----------------------------------------------------------
GENERIC_TITLE_WORDS = (
    "engineer", "developer", "software", "backend", "frontend", "full stack",
    "fullstack", "infrastructure", "platform", "data",
)
QUERY_STOPWORDS = (
    "and", "or", "the", "for", "with", "senior", "junior", "entry", "mid",
    "level", "role",
)
QUERY_TOKEN = r"[a-z0-9+#.-]+"

# --- places ------------------------------------------------------------------
STATE_CODES = (
    "al", "ak", "az", "ar", "ca", "co", "ct", "de", "fl", "ga", "hi", "id", "il",
    "in", "ia", "ks", "ky", "la", "me", "md", "ma", "mi", "mn", "ms", "mo", "mt",
    "ne", "nv", "nh", "nj", "nm", "ny", "nc", "nd", "oh", "ok", "or", "pa", "ri",
    "sc", "sd", "tn", "tx", "ut", "vt", "va", "wa", "wv", "wi", "wy", "dc",
)
FOREIGN_MARKERS = (
    "germany", "france", "spain", "italy", "netherlands", "sweden", "norway",
    "denmark", "finland", "switzerland", "austria", "belgium", "ireland",
    "poland", "uk", "united kingdom", "england", "scotland", "wales", "canada",
    "toronto", "vancouver", "montreal", "australia", "sydney", "melbourne",
    "india", "bangalore", "bengaluru", "singapore", "japan", "tokyo", "china",
    "hong kong", "uae", "dubai", "colombia", "brazil", "mexico", "argentina",
    "chile", "turkiye", "turkey", "latam", "emea", "apac", "europe",
    "european union", "eu",
)
DOMESTIC_PHRASES = ("united states", ", us")
DOMESTIC_CITIES = (
    "new york", "san francisco", "seattle", "chicago", "austin", "los angeles",
    "boston", "denver", "portland", "atlanta",
)
REMOTE_WORDS = ("remote", "anywhere", "distributed")

# --- titles and descriptions -------------------------------------------------
ROLE_TERMS = (
    "software engineer", "software developer", "backend engineer",
    "frontend engineer", "full stack", "fullstack", "full-stack",
    "platform engineer", "infrastructure engineer", "data engineer",
    "systems engineer", "site reliability", "sre ", "devops engineer",
    "machine learning engineer", "ml engineer", "ai engineer",
    "backend developer", "frontend developer", "web developer",
)
ROLE_EXCLUDES = (
    "curriculum", "solutions engineer", "sales engineer", "support engineer",
    "field engineer", "customer engineer", "technical account",
    "forward deployed", "enablement",
)
SENIOR_TERMS = (
    "senior", "staff", "principal", "lead", "manager", "director", "architect",
    "level 3", "l3", "iii",
)
MID_TERMS = ("mid", "ii", "level 2", "l2")
ENTRY_TERMS = (
    "junior", "entry", "associate", "apprentice", "graduate", "new grad",
    "level 1", "l1",
)
SENIOR_NUMERAL = r"\b(iii|3)\b"
MID_NUMERAL = r"\b(ii|2)\b"
ENTRY_NUMERAL = r"\b(i|1)\b"
MISMATCH_PHRASES = (
    "detection engineering", "incident response", "security operations",
    "curriculum developer", "training material", "instructor-led",
    "hands-on labs", "sales quota", "quota carrying", "book of business",
    "customer-facing sales", "consulting role",
)
MISMATCH_MIN_HITS = 2
EARLY_CAREER_TITLE = r"\b(new\s*grad|university\s*grad|intern(ship)?|co-?op)\b"
GENERIC_URL_PARTS = ("/jobs/search", "gh_jid=")
STALE_AFTER_DAYS = 30
YEARS_BUFFER = 1
REQUIRED_YEARS = (
    r"(\d+)\+?\s*years?\s*of\s*[\w\s]*experience",
    r"(\d+)\+?\s*years?\s*(?:relevant\s*)?experience",
    r"(\d+)\+?\s*yoe",
    r"experience[:\s]*(\d+)\+?\s*years?",
)

# --- profiles ----------------------------------------------------------------
PARSER_VERSION = 2
SKILL_VOCABULARY = (
    "python", "java", "javascript", "typescript", "go", "golang", "rust", "c++", "c#",
    "ruby", "php", "swift", "kotlin", "scala", "r", "matlab", "perl", "shell", "bash",
    "react", "angular", "vue", "svelte", "next.js", "nextjs", "nuxt", "gatsby",
    "html", "css", "sass", "tailwind", "webpack", "vite",
    "node.js", "nodejs", "express", "fastapi", "django", "flask", "spring boot",
    "spring", "rails", "laravel", ".net", "asp.net",
    "postgresql", "postgres", "mysql", "mongodb", "redis", "elasticsearch",
    "dynamodb", "cosmosdb", "cassandra", "sqlite", "sql", "nosql",
    "neo4j", "cockroachdb", "supabase",
    "aws", "azure", "gcp", "google cloud", "docker", "kubernetes", "k8s",
    "terraform", "ansible", "jenkins", "ci/cd", "github actions",
    "cloudformation", "pulumi",
    "kafka", "spark", "hadoop", "airflow", "flink", "databricks",
    "tensorflow", "pytorch", "scikit-learn", "pandas", "numpy",
    "git", "linux", "rest apis", "graphql", "grpc", "microservices",
    "distributed systems", "event-driven", "message queues", "rabbitmq",
    "oauth", "jwt", "websockets",
    "datadog", "grafana", "prometheus", "splunk", "new relic",
)
EXPLICIT_YEARS = (
    r"(\d+)\+?\s*years?\s*of\s*(?:professional\s*)?experience",
    r"(\d+)\+?\s*years?\s*(?:in|of|working)",
    r"experience[:\s]*(\d+)\+?\s*years?",
)
MONTH_NAME = (
    r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?"
    r"|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
)
# From its first digit; a month before it changes nothing.
YEAR_RANGE = (
    r"\d{4}\s*[-–—]+\s*"
    rf"(?:(?:{MONTH_NAME}\s+)?\d{{4}}|[Pp]resent|[Cc]urrent|[Nn]ow)"
)
NON_WORK_SECTION = (
    r"(education|university|college|school|degree|bachelor|master|phd|"
    r"intern(?:ship)?|project|personal|academic|certification|volunteer|"
    r"extracurricular|coursework|award|honor|fellowship)"
)
# The letters are looked for before the boundary in front of them, which is dear to test.
INTERN_WORD = r"intern\b(?<=\bintern)"
SECTION_HEADER_BELOW = 60
SECTION_RESET_BELOW = 40
FIRST_WORK_YEAR = 1990
JOB_TITLES = (
    r"((?:senior|junior|lead|staff|principal)?\s*software\s+engineer(?:\s+\w+)?)",
    r"((?:senior|junior|lead|staff|principal)?\s*(?:backend|frontend|full[\s-]?stack)\s+(?:developer|engineer))",
    r"((?:senior|junior|lead|staff|principal)?\s*data\s+(?:engineer|scientist))",
    r"((?:senior|junior|lead|staff|principal)?\s*(?:devops|sre|platform)\s+engineer)",
)
CAPITALISED_RUN = r"\b([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)\b"
KEYWORD_STOPWORDS = (
    "The", "And", "For", "With", "From", "This", "That", "Have", "Been", "Will",
    "Can", "May", "Also", "But", "Not", "All", "Any", "Each", "Our", "His",
    "Her", "Their", "About", "Into",
)

# --- scoring -----------------------------------------------------------------
SCORE_WEIGHTS = {"skill": 0.30, "company": 0.20, "location": 0.10, "yoe": 0.15, "recency": 0.25}
FULL_DESCRIPTION_CHARS = 500
NEUTRAL_SKILL_SCORE = 50.0
SKILL_SCALE = 3
RECENCY_STEPS = ((0, 100.0), (1, 90.0), (3, 70.0), (7, 50.0), (14, 30.0))
RECENCY_OLD = 10.0
RECENCY_UNKNOWN = 40.0
DEFAULT_MAX_YEARS = 4

# --- ranking, browsing, output -----------------------------------------------
PER_COMPANY_CAP = 2
PER_COMPANY_RELAXED = 3
STORED_DESCRIPTION_CHARS = 2000
PAGE_SIZE_DEFAULT = 50
PAGE_SIZE_MAX = 200
RECENT_MAX = 500
FACET_LIMITS = {"company": 500, "location": 500, "source": 50}
SORT_FIELDS = ("posted_date", "first_seen", "score", "company", "title", "location", "source")
SCORE_BANDS = ((85.0, "high"), (65.0, "medium"))
MATCH_CLASSES = ((70.0, "high"), (40.0, "mid"))

# --- sources -----------------------------------------------------------------
ASHBY_BOARD_URL = "https://jobs.ashbyhq.com"
AMAZON_BASE_URL = "https://www.amazon.jobs"
MICROSOFT_BASE_URL = "https://apply.careers.microsoft.com"
MICROSOFT_DOMAIN = "microsoft.com"
STRUCTURED_GENERIC_TITLE = "meta careers"
STRUCTURED_PATH_MARKER = "/profile/job_details/"
STRUCTURED_ID_PATTERN = r"/job_details/(\d+)"
SLUG_PATTERNS = {
    "lever": (
        r"jobs\.lever\.co/([A-Za-z0-9_-]+)",
        r"api\.lever\.co/v0/postings/([A-Za-z0-9_-]+)",
    ),
    "greenhouse": (
        r"boards\.greenhouse\.io/([A-Za-z0-9_-]+)",
        r"job-boards\.greenhouse\.io/([A-Za-z0-9_-]+)",
        r"boards-api\.greenhouse\.io/v1/boards/([A-Za-z0-9_-]+)",
    ),
    "ashby": (
        r"jobs\.ashbyhq\.com/([A-Za-z0-9_-]+)",
        r"api\.ashbyhq\.com/posting-api/job-board/([A-Za-z0-9_-]+)",
    ),
}
SLUG_IGNORED = {
    "lever": ("find", "jobs", "yourcompany"),
    "greenhouse": ("embed", "job_app", "job-board", "boards", "jobs", "api", "v1"),
    "ashby": ("jobs", "job", "job-board", "api", "posting-api"),
}
SLUG_PUNCTUATION = ").,;:\"'[]{}"
