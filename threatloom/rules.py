"""Rule tables: the values every detector and extractor is driven by.

Everything here is data.  Two rule sets (``DETECTOR_*`` and ``EXTRACTOR_*``)
are kept apart on purpose, because the scoring side and the feature side use
different lists.

All patterns are matched against *folded* text (see ``functions.text.fold``),
so they are written in lower case and need no case-insensitive flag.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    """One pattern.

    ``anchors``: literals of which every match contains at least one; they let
    Spark skip the regex for rows that cannot match (a byte search is far
    cheaper than a regex pass).  Empty means "always run the regex".
    ``scan``: an equivalent linear-time form used for *presence* tests on
    texts of any length; the pattern itself stays the reported name.
    """

    pattern: str
    anchors: tuple[str, ...] = ()
    scan: str | None = None


# ---------------------------------------------------------------------------
# Brands, suffixes, shorteners and keywords
# ---------------------------------------------------------------------------
EXTRACTOR_BRANDS = (
    "paypal", "amazon", "netflix", "apple", "microsoft", "google",
    "facebook", "instagram", "whatsapp", "chase", "wellsfargo",
    "bankofamerica", "citibank", "usps", "fedex", "ups", "dhl",
    "irs", "ssa", "walmart", "target", "ebay", "linkedin",
    "dropbox", "adobe", "spotify", "yahoo", "outlook", "office365",
    "docusign", "zoom", "slack", "github", "twitter",
)
DETECTOR_BRANDS = (
    "paypal", "amazon", "netflix", "apple", "microsoft", "google",
    "facebook", "instagram", "whatsapp", "chase", "wellsfargo",
    "bankofamerica", "citibank", "usps", "fedex", "ups", "dhl",
    "irs", "ssa", "walmart", "target", "ebay", "linkedin",
    "dropbox", "adobe", "spotify", "yahoo", "outlook", "office365",
)
EXTRACTOR_SUSPICIOUS_TLDS = (
    "tk", "ml", "ga", "cf", "gq", "xyz", "top", "work", "click",
    "link", "info", "online", "site", "website", "space", "pw",
    "cc", "su", "buzz", "fit", "loan", "download", "stream",
)
DETECTOR_SUSPICIOUS_TLDS = (
    "tk", "ml", "ga", "cf", "gq", "xyz", "top", "work", "click",
    "link", "info", "online", "site", "website", "space", "pw",
)
EXTRACTOR_SHORTENERS = (
    "bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd",
    "buff.ly", "adf.ly", "j.mp", "tr.im", "cli.gs", "short.to",
    "budurl.com", "clck.ru", "cutt.ly", "rb.gy", "shorturl.at",
)
DETECTOR_SHORTENERS = (
    "bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd",
    "buff.ly", "adf.ly", "j.mp", "tr.im", "cutt.ly", "rb.gy",
)
EXTRACTOR_URL_KEYWORDS = (
    "login", "signin", "verify", "secure", "account", "update",
    "confirm", "banking", "password", "credential", "authenticate",
    "validation", "suspend", "locked", "unusual", "activity",
)
DETECTOR_URL_KEYWORDS = ("login", "signin", "verify", "secure", "account", "update")
SUSPICIOUS_PHRASES = (
    "click here", "verify your", "confirm your", "update your",
    "unusual activity", "security alert", "account locked",
    "winner", "congratulations", "prize", "free gift",
)

# ---------------------------------------------------------------------------
# Pattern families of the feature extractor
# ---------------------------------------------------------------------------
EXTRACTOR_FAMILIES: dict[str, tuple[Rule, ...]] = {
    "urgency": (
        Rule(r"\b(urgent|immediately|asap|now|today|expires?|limited time)\b",
             ("urgent", "immediately", "asap", "now", "today", "expire", "limited time")),
        Rule(r"\b(act now|hurry|don't wait|final notice|last chance)\b",
             ("act now", "hurry", "don't wait", "final notice", "last chance")),
        Rule(r"\b(within \d+ (hours?|days?|minutes?))\b", ("within ",)),
        Rule(r"\b(deadline|expire|suspend|terminate)\b",
             ("deadline", "expire", "suspend", "terminate")),
    ),
    "threat": (
        Rule(r"\b(account (suspended|locked|compromised|restricted|disabled))\b", ("account ",)),
        Rule(r"\b(unauthorized (access|activity|transaction))\b", ("unauthorized ",)),
        Rule(r"\b(security (alert|warning|breach|issue))\b", ("security ",)),
        Rule(r"\b(suspicious (activity|login|attempt))\b", ("suspicious ",)),
        Rule(r"\b(will be (closed|terminated|deleted|suspended))\b", ("will be ",)),
    ),
    "credential": (
        Rule(r"\b(verify (your )?(account|identity|information|password))\b", ("verify ",)),
        Rule(r"\b(confirm (your )?(account|identity|details|password))\b", ("confirm ",)),
        Rule(r"\b(update (your )?(account|information|details|password))\b", ("update ",)),
        Rule(r"\b(enter (your )?(password|pin|ssn|credit card))\b", ("enter ",)),
        Rule(r"\b(provide (your )?(password|credentials|information))\b", ("provide ",)),
    ),
    "financial": (
        Rule(r"\b(bank|credit card|debit card|payment|transaction)\b",
             ("bank", "credit card", "debit card", "payment", "transaction")),
        Rule(r"\b(wire transfer|bitcoin|cryptocurrency|investment)\b",
             ("wire transfer", "bitcoin", "cryptocurrency", "investment")),
        Rule(r"\b(refund|reimbursement|compensation|prize|winner)\b",
             ("refund", "reimbursement", "compensation", "prize", "winner")),
        Rule(r"[$£€¥]\s?\d+[,\d]*", ("$", "£", "€", "¥")),
        Rule(r"\b\d+\s?(dollars?|pounds?|euros?|usd|gbp|eur)\b",
             ("dollar", "pound", "eur", "usd", "gbp")),
    ),
    "action": (
        Rule(r"\b(click (here|the link|below|this))\b", ("click ",)),
        Rule(r"\b(follow (this|the) link)\b", ("follow ",)),
        Rule(r"\b(visit (this|our) (website|page|link))\b", ("visit ",)),
        Rule(r"\b(download (the )?(attachment|file|document))\b", ("download ",)),
        Rule(r"\b(open (the )?(attachment|file|document))\b", ("open ",)),
    ),
    "impersonation": (
        Rule(r"\b(dear (customer|user|member|client|valued))\b", ("dear ",)),
        Rule(r"\b(from (the )?(support|team|department|administration))\b", ("from ",)),
        Rule(r"\b(official (notice|notification|communication))\b", ("official ",)),
        Rule(r"\b(customer (service|support|care))\b", ("customer ",)),
    ),
}
# Weights of the combined indicator score
INDICATOR_WEIGHTS = (
    ("urgency", 0.2), ("threat", 0.25), ("credential", 0.25),
    ("action", 0.15), ("impersonation", 0.15),
)

# ---------------------------------------------------------------------------
# Pattern families of the phishing detector
# family -> (rules, weight per hit, cap, indicator label)
# ---------------------------------------------------------------------------
DETECTOR_FAMILIES: dict[str, tuple[tuple[Rule, ...], float, float, str]] = {
    "urgency": ((
        Rule(r"\b(urgent|immediately|asap|now|today|expires?)\b",
             ("urgent", "immediately", "asap", "now", "today", "expire")),
        Rule(r"\b(act now|hurry|don't wait|final notice|last chance)\b",
             ("act now", "hurry", "don't wait", "final notice", "last chance")),
        Rule(r"\b(within \d+ (hours?|days?|minutes?))\b", ("within ",)),
        Rule(r"\b(account (suspended|locked|compromised|restricted))\b", ("account ",)),
        Rule(r"\b(verify (your )?(account|identity|password))\b", ("verify ",)),
    ), 0.1, 0.25, "Urgency language detected"),
    "credential": ((
        Rule(r"\b(enter (your )?(password|pin|ssn|credit card))\b", ("enter ",)),
        Rule(r"\b(confirm (your )?(account|identity|details))\b", ("confirm ",)),
        Rule(r"\b(update (your )?(information|password|credentials))\b", ("update ",)),
    ), 0.15, 0.3, "Credential request detected"),
    "financial": ((
        Rule(r"\b(bank|credit card|debit card|payment|transaction)\b",
             ("bank", "credit card", "debit card", "payment", "transaction")),
        Rule(r"\b(wire transfer|bitcoin|cryptocurrency)\b",
             ("wire transfer", "bitcoin", "cryptocurrency")),
        Rule(r"[$£€¥]\s?\d+[,\d]*", ("$", "£", "€", "¥")),
    ), 0.1, 0.2, "Financial keywords detected"),
}
PHRASE_WEIGHT, PHRASE_CAP, PHRASE_LABEL = 0.08, 0.25, "Suspicious phrases detected"

# Per-URL weights, reasons and thresholds of the phishing detector
URL_WEIGHTS = {
    "ip": 0.4, "tld": 0.3, "brand_subdomain": 0.3, "shortener": 0.2,
    "at": 0.4, "dots": 0.2, "keywords": 0.2,
}
URL_SUSPICIOUS_AT = 0.3
REASON_IP = "URL uses IP address instead of domain"
REASON_TLD = "Suspicious TLD: ."
REASON_BRAND = "Brand name in subdomain (possible typosquatting)"
REASON_SHORTENER = "URL shortener detected"
REASON_AT = "URL contains @ symbol (possible obfuscation)"
REASON_DOTS = "Excessive subdomains"
REASON_KEYWORDS = "Suspicious keywords in URL"
INDICATOR_DOMAIN = "Suspicious domain: "
INDICATOR_SHORTENER = "URL shortener used (may hide destination)"

# Ensemble weights, boost and decision thresholds
ENSEMBLE_WEIGHTS = {"ml": 0.30, "rule": 0.25, "url": 0.20, "brand": 0.10, "transformer": 0.15}
SIGNAL_THRESHOLDS = {"ml": 0.6, "rule": 0.3, "url": 0.3, "transformer": 0.6}
BRAND_SIMILARITY = 0.8
NEUTRAL_SCORE = 0.5
BOOST_SIGNALS, BOOST_FACTOR = 3, 1.2
PHISHING_THRESHOLD = 0.5
# level, minimum score, minimum number of indicators (first hit wins)
THREAT_LEVELS = (
    ("CRITICAL", 0.85, 5), ("HIGH", 0.7, 3), ("MEDIUM", 0.5, 2), ("LOW", 0.3, 1),
)
EMPTY_RECOMMENDATION = "No suspicious content detected."
RECOMMENDATIONS = {
    "NONE": "This message appears to be safe. However, always verify sender identity for sensitive requests.",
    "LOW": "Some suspicious elements detected. Verify the sender before taking any action.",
    "MEDIUM": "This message contains suspicious content. Do not click links or provide personal information. Verify directly with the organization.",
    "HIGH": "This message is likely a phishing attempt. Do not respond, click links, or provide any information. Report and delete.",
    "CRITICAL": "DANGER: This is a phishing attack. Do not interact with this message in any way. Report to your IT department and delete immediately.",
}
# Phrases that mark a short message as SMS
SMS_RULES = (
    Rule(r"\b(txt|sms|text me)\b", ("txt", "sms", "text me")),
    Rule(r"\b(click link|tap here)\b", ("click link", "tap here")),
)
SMS_MAX_CHARS = 500
URL_MAX_TOKENS = 3
ECHO_CHARS = 100
# Labels a model may use for its positive class
PHISHING_POSITIVE_LABELS = ("phishing", "spam", "1", "positive")
THREAT_POSITIVE_LABELS = ("PHISHING", "LABEL_1", "1")

# ---------------------------------------------------------------------------
# Threat categories (order decides the threat type)
# ---------------------------------------------------------------------------
THREAT_CATEGORIES: dict[str, tuple[Rule, ...]] = {
    "phishing_keywords": (
        Rule(r"\b(verify|confirm|account|suspended|urgent|immediately|click here|act now)\b",
             ("verify", "confirm", "account", "suspended", "urgent", "immediately", "click here", "act now")),
        Rule(r"\b(winner|prize|claim|free|congratulations|won)\b",
             ("winner", "prize", "claim", "free", "congratulations", "won")),
        Rule(r"\b(password|credit card|social security|bank account|payment)\b",
             ("password", "credit card", "social security", "bank account", "payment")),
        Rule(r"\b(expired|limited time|offer|discount|deal)\b",
             ("expired", "limited time", "offer", "discount", "deal")),
    ),
    "malicious_urls": (
        Rule(r"bit\.ly|tinyurl|goo\.gl", ("bit.ly", "tinyurl", "goo.gl")),
        Rule(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"),
        Rule(r"\.tk|\.ml|\.ga|\.cf|\.gq", (".tk", ".ml", ".ga", ".cf", ".gq")),
        Rule(r"http.*?@", ("http",), r"(?m)^(?>.*?http).*@"),
    ),
    "scam_indicators": (
        Rule(r"western union|moneygram|wire transfer", ("western union", "moneygram", "wire transfer")),
        Rule(r"nigerian prince|inheritance|beneficiary", ("nigerian prince", "inheritance", "beneficiary")),
        Rule(r"\$\d+,?\d*,?\d+ (million|thousand)", (" million", " thousand"),
             r"\$(?:\d{2,}|\d+,\d+|\d+,\d*,\d+) (?:million|thousand)"),
        Rule(r"cryptocurrency|bitcoin|ethereum.*?(giveaway|investment)",
             ("cryptocurrency", "bitcoin", "ethereum"),
             r"(?m)cryptocurrency|bitcoin|^(?>.*?ethereum).*?(?:giveaway|investment)"),
    ),
    "social_engineering": (
        Rule(r"ceo|director|manager.*?(urgent|immediate)", ("ceo", "director", "manager"),
             r"(?m)ceo|director|^(?>.*?manager).*?(?:urgent|immediate)"),
        Rule(r"gift card|itunes|amazon.*?card", ("gift card", "itunes", "amazon"),
             r"(?m)gift card|itunes|^(?>.*?amazon).*?card"),
        Rule(r"w-2|w2|tax.*?form", ("w-2", "w2", "tax"), r"(?m)w-2|w2|^(?>.*?tax).*?form"),
        Rule(r"wire.*?transfer.*?(urgent|today)", ("wire",),
             r"(?m)^(?>.*?wire)(?>.*?transfer).*?(?:urgent|today)"),
    ),
    "malware_indicators": (
        Rule(r"\.exe|\.scr|\.bat|\.cmd|\.vbs|\.js", (".exe", ".scr", ".bat", ".cmd", ".vbs", ".js")),
        Rule(r"download.*?(now|here|click)", ("download",),
             r"(?m)^(?>.*?download).*?(?:now|here|click)"),
        Rule(r"install.*?(update|patch|fix)", ("install",),
             r"(?m)^(?>.*?install).*?(?:update|patch|fix)"),
        Rule(r"macro.*?(enable|allow)", ("macro",), r"(?m)^(?>.*?macro).*?(?:enable|allow)"),
    ),
}
CATEGORY_WEIGHT = 0.2
MAX_REPORTED_PATTERNS = 3
MAX_REPORTED_URLS = 5
# Category -> threat type (malicious_urls names no type)
CATEGORY_TYPES = {
    "phishing_keywords": "PHISHING",
    "scam_indicators": "SCAM",
    "social_engineering": "SOCIAL_ENGINEERING",
    "malware_indicators": "MALWARE",
}
# URL risks of the threat detector, (feature, regex or None, weight)
THREAT_URL_RISKS = (
    ("IP address in URL", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", 0.3),
    ("Suspicious TLD", r"\.(tk|ml|ga|cf|gq)", 0.4),
    ("@ symbol in URL", "@", 0.5),
    ("Excessive subdomains", r"^[^.]*\.[^.]*\.[^.]*\.[^.]*\.[^.]*\.", 0.2),
    ("URL shortener", r"(bit\.ly|tinyurl|goo\.gl|ow\.ly)", 0.3),
)
THREAT_WEIGHTS = {"ml": 0.4, "rule": 0.3, "url": 0.2, "features": 0.1}
THREAT_THRESHOLD = 0.5
CONFIDENCE_LEVELS = (("VERY HIGH", 0.8), ("HIGH", 0.6), ("MEDIUM", 0.4))
THREAT_SAFE = "Message appears safe. No action needed."
# minimum confidence, text before and after the threat type
THREAT_RECOMMENDATIONS = (
    (0.8, "CRITICAL: High-confidence ", " detected. Block immediately and report."),
    (0.6, "WARNING: Likely ", ". Exercise caution and verify sender."),
    (0.0, "SUSPICIOUS: Possible ", ". Review carefully before taking action."),
)
TOO_SHORT_REASON = "Text too short to analyze"
MIN_ANALYSED_CHARS = 3

# ---------------------------------------------------------------------------
# Spam decision and explainability features
# ---------------------------------------------------------------------------
SPAM_THRESHOLD = 0.75
EXPLAIN_URGENCY = Rule(r"\b(urgent|asap|now|immediately|hurry)\b",
                       ("urgent", "asap", "now", "immediately", "hurry"))
EXPLAIN_SPAM = Rule(r"\b(free|win|winner|prize|claim|click|buy|offer|deal)\b",
                    ("free", "win", "prize", "claim", "click", "buy", "offer", "deal"))

# ---------------------------------------------------------------------------
# Intrusion payloads and files
# ---------------------------------------------------------------------------
ATTACK_FAMILIES: dict[str, tuple[Rule, ...]] = {
    "sql_injection": (
        Rule(r"' or '1'='1", ("' or '1'='1",)),
        Rule(r"'; drop table", ("'; drop table",)),
        Rule(r"union select", ("union select",)),
    ),
    "xss": (
        Rule(r"<script>", ("<script>",)),
        Rule(r"javascript:", ("javascript:",)),
        Rule(r"onerror=", ("onerror=",)),
    ),
    "command_injection": (
        Rule(r";\s*cat\s+", ("cat",)),
        Rule(r"&&\s*ls", ("&&",)),
        Rule(r"\|\s*whoami", ("whoami",)),
    ),
    "path_traversal": (
        Rule(r"\.\./", ("../",)),
        Rule(r"\.\.\\", ("..\\",)),
    ),
}
ATTACK_CONFIDENCE, CLEAN_CONFIDENCE = 0.9, 0.1
SUSPICIOUS_EXTENSIONS = (".exe", ".dll", ".bat", ".cmd", ".scr")
EXTENSION_RISK, ENTROPY_RISK, ENTROPY_LIMIT = 0.3, 0.2, 7.0
MALICIOUS_ABOVE, SUSPICIOUS_ABOVE = 0.7, 0.4

# ---------------------------------------------------------------------------
# Labels, sources and request limits
# ---------------------------------------------------------------------------
LABEL_MAP = {
    "phishing": "phishing", "spam": "phishing", "smishing": "phishing",
    "scam": "phishing", "malicious": "phishing",
    "legitimate": "legitimate", "ham": "legitimate", "safe": "legitimate",
    "benign": "legitimate",
}
POSITIVE, NEGATIVE = "phishing", "legitimate"
# source, content type, ingest priority
FEED_SOURCES = (
    ("phishtank", "url", 0), ("openphish", "url", 1), ("tranco", "url", 2), ("uci_sms", "sms", 3),
)
SEED = 42
TRAIN_RATIO, VALIDATION_RATIO = 0.7, 0.15
SCAN_TYPES = ("email", "sms", "url", "auto")
REQUEST_LIMITS = {"message": (1, 10000), "text": (1, 50000), "url": (5, 2000)}
