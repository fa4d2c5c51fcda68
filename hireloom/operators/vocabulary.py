"""Fixed values of the rules: enumerations, aliases, country groups, patterns."""

SENIORITY = ["intern", "entry", "mid", "senior", "staff", "principal", "lead", "manager", "director", "vp", "executive"]
LANGUAGE_LEVELS = ["basic", "conversational", "professional", "fluent", "native"]

COUNTRIES = {
    "austria": "AT", "belgium": "BE", "bulgaria": "BG", "croatia": "HR", "cyprus": "CY", "czechia": "CZ", "denmark": "DK", "estonia": "EE",
    "finland": "FI", "france": "FR", "germany": "DE", "greece": "GR", "hungary": "HU", "ireland": "IE", "italy": "IT", "latvia": "LV",
    "lithuania": "LT", "luxembourg": "LU", "malta": "MT", "netherlands": "NL", "poland": "PL", "portugal": "PT", "romania": "RO",
    "slovakia": "SK", "slovenia": "SI", "spain": "ES", "sweden": "SE", "united kingdom": "GB", "uk": "GB", "united states": "US", "usa": "US",
    "canada": "CA", "switzerland": "CH", "norway": "NO", "iceland": "IS",
}
EU = ["AT", "BE", "BG", "HR", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GR", "HU", "IE", "IT", "LT", "LU", "LV", "MT", "NL", "PL", "PT", "RO", "SE", "SI", "SK"]
EEA = [*EU, "IS", "LI", "NO"]
EUROPE = [*EEA, "AL", "AD", "BA", "BY", "CH", "GB", "MC", "MD", "ME", "MK", "RS", "SM", "UA", "VA"]
GROUPS = {"EU": EU, "EEA": EEA, "EUROPE": EUROPE}

#: Level, pattern that detects it, pattern that is removed from the title; first match wins.
SENIORITY_RULES = [
    ("executive", r"\b(?:chief (?:executive|technology|data|product) officer|c[etdpo]o)\b", None),
    ("vp", r"\b(?:vice president|vp)\b", r"\b(?:vice president|vp)(?:\s+of)?\b"),
    ("director", r"\b(?:managing director|director)\b", r"\b(?:managing director|director)(?:\s+of)?\b"),
    ("manager", r"\bmanager\b", None),
    ("principal", r"\bprincipal\b", None),
    ("staff", r"\bstaff\b", None),
    ("lead", r"\b(?:team|technical|engineering|data|product) lead\b|\blead (?:engineer|developer|scientist|architect)\b", r"\b(?:team|technical|engineering|data|product) lead\b|\blead(?=\s+(?:engineer|developer|scientist|architect))"),
    ("senior", r"\b(?:senior|sr\.?)(?=\s|$)", r"\b(?:senior|sr\.?)\b"),
    ("entry", r"\b(?:junior|jr\.?|entry[- ]level)\b", None),
    ("intern", r"\b(?:intern|internship)\b", None),
]
SENIORITY_EXCLUDED = r"\b(?:director of photography|executive assistant)\b"

SALARY = r"(?:\b(EUR|USD|GBP)\b|([€$£]))\s*([\d,.]+)(?:\s*[–-]\s*(?:\b(?:EUR|USD|GBP)\b|[€$£])?\s*([\d,.]+))?"
PERIODS = [("HOUR", r"\b(?:hour|hourly|hr)\b"), ("DAY", r"\b(?:day|daily)\b"), ("WEEK", r"\b(?:week|weekly)\b"), ("MONTH", r"\b(?:month|monthly)\b"), ("YEAR", r"\b(?:year|annual|annually)\b"), ("CONTRACT", r"\bcontract\b")]

EXPERIENCE_UP_TO = r"([^.!?\n]{0,80}?\bup to\s+(\d{1,2})\s+years?(?:\s+of)?\s+(?:relevant\s+)?experience[^.!?\n]{0,80})"
EXPERIENCE = r"([^.!?\n]{0,80}?\b(?<!up to )(\d{1,2})(?:\s*[–-]\s*(\d{1,2})|\+)?\s+years?(?:\s+of)?\s+(?:relevant\s+)?experience[^.!?\n]{0,80})"
EDUCATION = r"([^.!?\n]{0,100}\b(?:ph\.?d\.?|doctorate|master'?s?|bachelor'?s?)\b[^.!?\n]{0,100})"
EDUCATION_GATE = r"\b(?:required|must|minimum|preferred|nice to have|degree|qualification)\b"
EQUIVALENT = r"equivalent (?:professional |work )?experience|or equivalent"

LANGUAGES = [("en", "English", r"\benglish\b"), ("de", "German", r"\b(?:german|deutsch)\b"), ("fr", "French", r"\b(?:french|fran[cç]ais)\b"), ("es", "Spanish", r"\b(?:spanish|espa[nñ]ol)\b"), ("it", "Italian", r"\bitalian\b"), ("pt", "Portuguese", r"\bportuguese\b")]
LANGUAGE_GATE = r"\b(?:required|must|fluen|proficien|native|professional|preferred|nice to have|c[12]|b[12]|a[12])\b"
LANGUAGE_RULES = [("native", r"\bnative"), ("fluent", r"\b(?:c2|fluent)\b"), ("professional", r"\b(?:c1|professional)\b"), ("conversational", r"\b(?:b1|b2|conversational)\b"), ("basic", r"\b(?:a1|a2|basic)\b")]

#: Name, pattern, flags.
SKILLS = [("PostgreSQL", r"\b(?:postgres|postgresql)\b", "iu"), ("Node.js", r"\b(?:node\.?(?:js)?|node\.js)\b", "iu"), ("TypeScript", r"\btypescript\b", "iu"), ("JavaScript", r"\bjavascript\b", "iu"), ("Python", r"\bpython\b", "iu"), ("SQL", r"\bsql\b", "iu"), ("R", r"(?<![\p{L}\p{N}_])R(?![\p{L}\p{N}_])", "")]

AUTHORIZATION_GATE = r"\b(?:authori[sz]ed to work|right to work|sponsorship|citizens? only|security clearance)\b"
SPONSORED = r"\bsponsorship (?:is )?available|will sponsor\b"
NOT_SPONSORED = r"\bno sponsorship|unable to sponsor|without sponsorship\b"
CLEARANCE = r"\bsecurity clearance (?:is )?required|must (?:hold|obtain) (?:a )?security clearance\b"

EMPLOYMENT = {"contract": "contract", "contractor": "contract", "full-time": "full-time", "full time": "full-time", "internship": "internship", "intern": "internship", "part-time": "part-time", "part time": "part-time", "temporary": "temporary"}
REMOTE = {"hybrid": "hybrid", "on-site": "onsite", "onsite": "onsite", "remote": "remote"}

NORMALIZATION_VERSION, FILTER_VERSION, FINGERPRINT_VERSION = "normalization-v1", "hard-filters-v1", 1
MOST_CANDIDATES = 20
