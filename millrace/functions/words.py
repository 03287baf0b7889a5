"""Word lists and patterns the rules are defined by.

Everything here is data. The order of each table is part of its meaning: rules take the first entry that
matches. All words are lower case and are applied to lower-cased text; a few hold regex syntax (``.``,
``?``), as the rule they define does.
"""

from __future__ import annotations

from millrace.functions.patterns import first_of, prefix_pattern, word_start

_SYNTAX = set(r".?*+|\()[]{}^$")

# --- fixed values: role category by title and description, first match wins --------------------------------
ROLE_WORDS: list[tuple[str, list[str]]] = [
    ("LLM / Generative AI", [
        "llm", "large language model", "generative ai", "genai", "gen ai", "gpt", "foundation model",
        "prompt engineer",
    ]),
    ("Clinical AI", [
        "clinical ai", "medical ai", "healthcare ai", "clinical ml", "medical ml", "ambient", "ambient scribe",
        "ambient ai", "clinical nlp", "medical nlp",
    ]),
    ("ML Engineer", [
        "machine learning engineer", "ml engineer", "mle", "applied ml", "ml platform", "mlops",
        "ml infrastructure", "ml ops",
    ]),
    ("Applied Scientist", [
        "applied scientist", "research scientist", "research engineer", "applied research",
    ]),
    ("Data Scientist", [
        "data scientist", "healthcare data scientist", "clinical data scientist", "biostatistician",
        "health data scientist",
    ]),
    ("AI Platform / Infra", [
        "ai platform", "ai infrastructure", "ai infra", "model serving", "inference", "mlflow", "kubeflow",
        "model platform",
    ]),
    ("Computer Vision", [
        "computer vision", "image recognition", "medical imaging", "radiology ai", "pathology ai", "dicom",
    ]),
    ("NLP Engineer", [
        "nlp engineer", "natural language", "text mining", "information extraction", "ner", "named entity",
    ]),
    ("Data Engineer", [
        "data engineer", "data pipeline", "etl", "elt", "data platform", "data infrastructure", "spark",
        "airflow", "fhir engineer",
    ]),
    ("AI / ML", [
        "ai engineer", "artificial intelligence", "deep learning", "neural network", "ml scientist",
    ]),
]
DEFAULT_ROLE = "AI / ML"
ROLE_DESCRIPTION_CHARS = 2000

# --- fixed values: seniority by title, first match wins -----------------------------------------------------
SENIORITY_WORDS: list[tuple[str, list[str]]] = [
    ("VP / Director", ["vp", "vice president", "director", "head of"]),
    ("Principal / Staff", ["principal", "staff engineer", "distinguished", "fellow"]),
    ("Lead / Architect", ["lead", "tech lead", "architect", "senior staff"]),
    ("Senior", ["senior", r"sr\.?"]),
    ("Mid-level", ["ii", "2", "mid.level", "mid level"]),
    ("Junior / Associate", ["junior", r"jr\.?", "associate", "entry.level", "new grad", "ng"]),
]
DEFAULT_SENIORITY = "Mid-level"

# --- fixed values: relevance of a posting -------------------------------------------------------------------
EXCLUDED_TITLE_WORDS = [
    "intern", "internship", "co.op", "coop", "sales", "account executive", "marketing", "recruiter",
    "recruiting", "finance", "legal", "administrative", "office manager", "customer success",
    "account manager", "business development", "hr ", "human resources",
]

RELEVANT_TITLE_WORDS = [
    "ai", "ml", "machine learning", "deep learning", "data science", "nlp", "llm", "generative",
    "clinical ai", "medical ai", "healthcare ai", "mlops", "research engineer", "applied scientist",
    "data engineer", "platform engineer", "inference", "model", "neural", "computer vision",
    "bioinformatics", "genomics", "imaging", "radiology", "ambient", "scribe", "fhir", "ehr",
]

RELEVANT_DESCRIPTION_WORDS = [
    "machine learning", "deep learning", "neural network", "llm", "transformer", "pytorch", "tensorflow",
    "scikit", "xgboost", "nlp", "computer vision", "mlops", "clinical ai", "medical ai", "generative ai",
]
RELEVANT_DESCRIPTION_CHARS = 1500
RELEVANT_DESCRIPTION_MENTIONS = 3

# --- fixed values: light title check that decides which postings get a detail record -----------------------
DETAIL_TITLE_WORDS = [
    "ai", "ml", "machine learning", "data scientist", "data engineer", "nlp", "llm", "generative",
    "deep learning", "research scientist", "applied scientist", "computer vision", "platform engineer",
    "inference", "model", "neural", "analytics", "bioinformatics", "genomics", "clinical ai", "ambient",
    "fhir", "software engineer", "backend", "infrastructure", "devops", "mlops",
]

DETAIL_EXCLUDED_WORDS = [
    "intern", "sales", "account executive", "marketing", "recruiter", "legal", "counsel", "finance", "hr ",
    "human resources", "customer success", "nursing", "clinician", "clinical success", "physician",
    "office manager",
]
WORKDAY_EXTRA_EXCLUDED_WORDS = ["associate i"]

# --- fixed values: places kept, first place with a matching alias wins --------------------------------------
LOCATION_ALIASES: dict[str, list[str]] = {
    "San Francisco": [
        "san francisco", "sf", "bay area", "sf bay area", "south bay", "silicon valley", "palo alto",
        "mountain view", "sunnyvale", "menlo park", "san jose", "santa clara", "redwood city", "foster city",
        "burlingame", "san mateo", "oakland", "emeryville",
    ],
    "New York City": [
        "new york", "nyc", "new york city", "manhattan", "brooklyn", "queens", "new york, ny", "ny, ny",
        "ny office", "nyc office", "new york office",
    ],
    "Seattle": [
        "seattle", "bellevue", "redmond", "kirkland", "bothell", "seattle, wa", "puget sound",
        "seattle office",
    ],
    "Boston": [
        "boston", "cambridge, ma", "cambridge ma", "somerville", "waltham", "lexington, ma", "boston, ma",
        "boston office", "durham, nc", "durham office", "research triangle",
    ],
    "Los Angeles": [
        "los angeles", "santa monica", "culver city", "west hollywood", "los angeles, ca",
        "southern california", "socal", "pasadena", "los angeles office", "la office",
    ],
    "Austin": ["austin", "austin, tx", "round rock", "cedar park", "austin office"],
    "Chicago": ["chicago", "chicago, il", "evanston", "naperville", "schaumburg", "chicago office"],
    "Washington DC": [
        "washington dc", "washington, dc", "d.c.", "arlington, va", "arlington va", "bethesda", "mclean",
        "tysons", "northern virginia", "nova", "reston", "herndon", "dc office",
    ],
    "Miami": [
        "miami", "miami, fl", "miami beach", "brickell", "coral gables", "fort lauderdale", "boca raton",
    ],
    "San Diego": ["san diego", "san diego, ca", "la jolla", "del mar", "san diego office"],
    "Phoenix": ["phoenix", "phoenix, az", "scottsdale", "tempe", "mesa, az", "chandler, az"],
    "Remote": [
        "remote", "remote us", "remote usa", "work from home", "wfh", "fully remote", "100% remote",
        "us remote", "united states remote", "distributed", "remote - united states", "remote (us)",
        "remote, us", "remote, usa", "remote - us", "remote – us", "remote - usa",
        "remote (united states)", "us only", "usa only", "anywhere in the us", "anywhere in us",
        "united states", "nationwide", "national", "remote - tier 1", "remote - tier 2", "remote - tier 3",
        "remote – tier 1", "remote – tier 2", "remote – tier 3",
    ],
}

# --- fixed values: words that rule a place out --------------------------------------------------------------
FOREIGN_WORDS = [
    "united kingdom", "uk", "london", "england", "scotland", "canada", "toronto", "vancouver", "australia",
    "sydney", "melbourne", "germany", "berlin", "france", "paris", "india", "bangalore",
    r"remote\s*-\s*(?!us|usa|united states)", "eu remote", "europe",
]
LOCATION_FALLBACK_CHARS = 300
REMOTE = "Remote"

# --- fixed values: skill categories in the order a roadmap shows them ---------------------------------------
ROADMAP_ORDER = [
    "LLM Stack", "ML/DL", "Healthcare", "MLOps", "Data Engineering", "Infrastructure", "Cloud",
    "Programming", "Governance",
]

# --- fixed values: skills taken per category for the most common stack --------------------------------------
STACK_QUOTA = {"LLM Stack": 4, "Healthcare": 3, "ML/DL": 3, "MLOps": 3}


def bounded(words: list[str]) -> str:
    """A pattern that finds any of the words between (Unicode) word boundaries. Plain words share their first characters."""
    plain = [word for word in words if not set(word) & _SYNTAX]
    rest = [word for word in words if set(word) & _SYNTAX]
    options = ([prefix_pattern(plain)] if plain else []) + rest
    return f"(?U){first_of(words)}{word_start(words)}(?:" + "|".join(options) + r")\b"
