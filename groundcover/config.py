"""Domain tables. Every operator takes them as arguments; these are the defaults."""

# The lists, texts and numbers below must equal the ones planners
# already use, so that results agree row by row.

STATE_ALIASES = {
    "maharastra": "maharashtra",
    "nct of delhi": "delhi",
    "jammu & kashmir": "jammu and kashmir",
    "andaman & nicobar islands": "andaman and nicobar islands",
    "dadra and nagar haveli & daman and diu": "the dadra and nagar haveli and daman and diu",
}

DISTRICT_ALIASES = {
    ("karnataka", "bangalore"): "bengaluru urban",
    ("karnataka", "bangalore rural"): "bengaluru rural",
    ("karnataka", "belgaum"): "belagavi",
    ("karnataka", "bellary"): "ballari",
    ("karnataka", "chikmagalur"): "chikkamagaluru",
    ("karnataka", "gulbarga"): "kalaburagi",
    ("karnataka", "mysore"): "mysuru",
    ("karnataka", "shimoga"): "shivamogga",
    ("karnataka", "tumkur"): "tumakuru",
    ("karnataka", "bijapur"): "vijayapura",
    ("karnataka", "chamarajanagar"): "chamarajanagara",
    ("karnataka", "davanagere"): "davangere",
    ("haryana", "gurgaon"): "gurugram",
    ("west bengal", "north twenty four pargana"): "24 paraganas north",
    ("west bengal", "south twenty four pargana"): "24 paraganas south",
    ("west bengal", "hugli"): "hooghly",
    ("west bengal", "paschim medinipur"): "medinipur west",
    ("west bengal", "purba medinipur"): "medinipur east",
    ("west bengal", "koch bihar"): "coochbehar",
    ("uttar pradesh", "allahabad"): "prayagraj",
    ("uttar pradesh", "faizabad"): "ayodhya",
    ("andhra pradesh", "sri potti sriramulu nello"): "spsr nellore",
    ("punjab", "sahibzada ajit singh nagar"): "s.a.s nagar",
    ("punjab", "muktsar"): "sri muktsar sahib",
    ("tamil nadu", "thoothukkudi"): "tuticorin",
    ("jharkhand", "purbi singhbhum"): "east singhbum",
}

DISTRICT_BLOCKLIST = [("uttar pradesh", "kanshiram nagar", "kushi nagar")]
POLYGON_BLOCKLIST = [("west bengal", "purba bardhaman", "paschim barddhaman")]

CAPABILITY_QUERIES = {
    "ICU": "intensive care unit ICU critical care with ventilator support and continuous monitoring",
    "NICU": "neonatal intensive care unit NICU for newborn and premature infant critical care",
    "Emergency": "24/7 emergency department trauma bay emergency room casualty services",
    "Maternity": "maternity obstetrics labor and delivery gynecology childbirth services",
    "Oncology": "oncology cancer treatment chemotherapy radiation therapy tumor care",
    "Trauma": "trauma center trauma surgery major injury polytrauma emergency surgery",
}

CAPABILITY_KEYWORDS = {
    "ICU": ["icu", "intensive care", "critical care", "ventilator"],
    "NICU": ["nicu", "neonatal", "newborn intensive"],
    "Emergency": ["emergency", "24/7", "casualty", "trauma bay"],
    "Maternity": ["maternity", "obstetric", "gynecology", "labor", "delivery", "childbirth"],
    "Oncology": ["oncology", "cancer", "chemotherapy", "radiation therapy", "tumor"],
    "Trauma": ["trauma", "polytrauma", "major injury"],
}

FIELD_WEIGHTS = {"capability": 1.0, "procedure": 0.85, "equipment": 0.8, "description": 0.6}

STATUSES = ["verified", "likely", "weak_signal", "no_signal"]
SUPPORTED_STATUSES = ["verified", "likely"]
COVERAGE_STATUSES = ["verified_coverage", "weak_coverage", "no_facility", "no_data"]
HIGH_ACUITY = ["ICU", "NICU", "Trauma", "Oncology"]

STATUS_QUANTILES = (0.40, 0.70, 0.90)
STATUS_CAPS = {"no_signal": 30, "weak_signal": 60, "likely": 90}
FUZZY_CUTOFF = 0.72
TOP_K = 4000
CHUNK_ITEMS = 4
SPAN_CHARS = 2000
EMBED_BATCH = 10
EMBED_WORKERS = 6
EMBED_SECONDS = 20
EMBED_RETRY_SECONDS = 60
LISTING_LIMIT = 500
PREVIEW_MARKERS = 72
EARTH_RADIUS_KM = 6371.0
NEAREST_KM = 25.0

LATITUDE_RANGE = (6.0, 38.0)
LONGITUDE_RANGE = (68.0, 98.0)

SUPPRESSED_MARKERS = ["*", "NA", "N/A", ""]

LIST_COLUMNS = [
    "phone_numbers", "websites", "specialties", "procedure",
    "equipment", "capability", "source_types", "source_ids", "source_urls",
]
BOOLEAN_COLUMNS = ["affiliated_staff_presence", "custom_logo_presence", "acceptsVolunteers"]
SIGNAL_COLUMNS = [
    "recency_of_page_update", "distinct_social_media_presence_count",
    "number_of_facts_about_the_organization", "post_metrics_post_count",
    "engagement_metrics_n_followers", "engagement_metrics_n_likes",
    "engagement_metrics_n_engagements",
]

RULES = {
    "check_unsupported_claim": (
        "Verified or likely evidence has neither doctors_reported nor capacity_reported."
    ),
    "check_single_source_high_acuity": (
        "A verified or likely high-acuity capability has one or fewer source types."
    ),
    "check_low_legitimacy_signals": (
        "Verified evidence lacks affiliated staff and a custom logo and has fewer than "
        "three organization facts."
    ),
    "check_unverified_location": "The facility coordinates are not valid.",
    "check_geography_unresolved": "The facility district is unresolved.",
}

CONFIRM_MESSAGE = (
    "Every result must be confirmed by direct outreach to the facility — this is decision "
    "support, not a verified directory."
)

STATUS_GUIDANCE = {
    "verified": "Use verified/high-confidence language without overstating it.",
    "likely": "Use likely/moderate-confidence language, not certainty.",
    "weak_signal": (
        "Use explicitly uncertain language such as 'limited evidence suggests' or 'this could "
        "not be independently confirmed'."
    ),
    "no_signal": (
        "State that there is no signal or that the capability is unresolved; do not imply the "
        "capability exists."
    ),
}

REQUIRED_PHRASES = {
    "verified": ["verified", "high confidence"],
    "likely": ["likely", "moderate confidence"],
    "weak_signal": [
        "limited evidence suggests", "limited evidence indicates", "some evidence suggests",
        "some evidence indicates", "weak evidence suggests", "weak evidence indicates",
        "partial evidence suggests", "partial evidence indicates", "weak signal", "uncertain",
        "could not be independently confirmed", "not independently confirmed",
        "limited confidence", "low confidence",
    ],
    "no_signal": [
        "no signal", "did not find", "could not find", "not find any", "no evidence",
        "no indication", "could not be confirmed", "cannot be confirmed", "unresolved",
        "no-call", "lack of evidence", "absence of evidence",
    ],
}

OVERCONFIDENT_PHRASES = [
    "high confidence", "definitely", "clearly proves", "is confirmed", "is verified", "certainly",
]

FORBIDDEN_PHRASES = {
    "likely": ["definitely", "clearly proves", "certainly"],
    "weak_signal": OVERCONFIDENT_PHRASES,
    "no_signal": OVERCONFIDENT_PHRASES,
}

SENTENCE_END = r"[.!?](?:[\"']?)(?=\s|$)"

EXPLANATION_FIELDS = [
    "unique_id", "capability", "evidence_status", "trust_score", "trust_score_pct",
    "field_source", "text_span", "score", "richness_prior", "confirm_message",
]
