"""Fixed values that decide results: word lists, keyword rules, field names, patterns, formats."""

from __future__ import annotations

# English stop words left out of keyword tables.
STOP_WORDS = """
the a an and or but in on at to for of with by from up about into through during before after
above below between under along following behind beyond within without is are was were be been
being have has had do does did will would could should may might must can shall it its this that
these those i you he she we they them their what which who when where why how all each every both
few more most other some such no nor not only own same so than too very just
""".split()

# Patterns for entities, searched with case as written.
ENTITY_PATTERNS = {
    "emails": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone_numbers": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "urls": r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+",
    "dates": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    "times": r"\b\d{1,2}:\d{2}\s?(?:AM|PM|am|pm)?\b",
    "money": r"\$\d+(?:,\d{3})*(?:\.\d{2})?",
}

# Masking order, pattern and replacement.
MASKS = [
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL]"),
    ("phone", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "[PHONE]"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
    ("credit_card", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", "[CREDIT_CARD]"),
]

# Patterns of the column checks.
EMAIL_FORM = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
US_PHONE_FORM = r"^1?\d{10}$"
OTHER_PHONE_FORM = r"^\+?\d{7,15}$"
URL_FORM = (
    r"^https?://(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}"
    r"\.[a-zA-Z0-9()]{1,6}\b[-a-zA-Z0-9()@:%_\+.~#?&/=]*$"
)
ID_FORM = r"^[a-zA-Z0-9_-]+$"

# Timestamp formats of the import, tried in this order. A single letter
# takes one or two digits.
IMPORT_FORMATS = [
    "yyyy-M-d H:m:s",
    "yyyy-M-d",
    "M/d/yyyy H:m:s",
    "M/d/yyyy",
    "yyyy-M-d'T'H:m:s",
    "yyyy-M-d'T'H:m:s'Z'",
]

# Timestamp formats of the flexible parse, tried in this order.
FLEXIBLE_FORMATS = [
    "yyyy-M-d H:m:s",
    "yyyy/M/d H:m:s",
    "M/d/yyyy H:m:s",
    "d/M/yyyy H:m:s",
    "yyyy-M-d",
    "M/d/yyyy",
    "d/M/yyyy",
    "yyyyMMdd",
    "yyyy-M-d'T'H:m:s",
    "yyyy-M-d'T'H:m:s'Z'",
    "yyyy-M-d'T'H:m:s.SSSSSS",
]

# Header patterns used when no field table is given, first header hit wins.
DEFAULT_HEADER_PATTERNS = {
    "call_id": r"(call[\s_-]?id|id|identifier|record[\s_-]?id)",
    "phone_number": r"(phone|telephone|number|contact|mobile|cell)",
    "timestamp": r"(time|date|timestamp|created|started|datetime)",
    "duration": r"(duration|length|call[\s_-]?time|call[\s_-]?length|seconds|minutes)",
    "agent_id": r"(agent|employee|staff|representative|rep[\s_-]?id)",
    "campaign": r"(campaign|project|program|initiative)",
    "outcome": r"(outcome|result|status|disposition)",
    "call_type": r"(type|category|classification|reason)",
    "notes": r"(notes|comments|remarks|description|transcript)",
    "revenue": r"(revenue|amount|value|price|cost|sale)",
}

# Columns that an import adds as null when a file lacks them.
OPTIONAL_COLUMNS = [
    "agent_id",
    "campaign",
    "customer_name",
    "phone_number",
    "product_name",
    "amount",
    "revenue",
    "outcome",
    "call_type",
    "notes",
]

# The field table: name, label, required, aliases, header patterns.
FIELD_TABLE = [
    ("call_id", "Call ID", True,
     ["call_id", "callid", "interaction_id"],
     [r"call[\s_-]?id", "identifier", r"record[\s_-]?id"]),
    ("timestamp", "Call Timestamp", True,
     ["timestamp", "start_time", "call_timestamp", "datetime"],
     ["time", "date", r"start[\s_-]?time", "timestamp"]),
    ("duration", "Duration (seconds)", True,
     ["duration", "duration_seconds", "call_duration", "length"],
     ["duration", "length", r"call[\s_-]?time", "seconds", "minutes"]),
    ("transcript", "Transcript", True,
     ["transcript", "notes", "call_notes", "conversation", "summary"],
     ["transcript", "notes", "remarks", "description", "conversation"]),
    ("phone_number", "Phone Number", False,
     ["phone_number", "phone", "contact_number", "customer_phone"],
     ["phone", "telephone", "mobile", "contact", "cell"]),
    ("agent_id", "Agent", False,
     ["agent_id", "agent", "employee_id", "rep_id"],
     ["agent", "employee", "representative", "rep"]),
    ("agent_name", "Agent Name", False,
     ["agent_name", "agent", "agent_full_name", "agent_name_full"],
     [r"agent\b", "agent.*name", "representative.*name"]),
    ("campaign", "Campaign", False,
     ["campaign", "project", "program", "initiative"],
     ["campaign", "project", "program", "initiative"]),
    ("outcome", "Outcome", False,
     ["outcome", "result", "status", "disposition"],
     ["outcome", "result", "status", "disposition"]),
    ("call_type", "Call Type", False,
     ["call_type", "type", "category"],
     ["type", "category", "classification", r"call[\s_-]?type"]),
    ("notes", "Notes", False,
     ["notes", "comments", "remarks", "summary_notes"],
     ["notes", "comments", "remarks", "summary"]),
    ("revenue", "Revenue / Amount", False,
     ["revenue", "amount", "sale_value", "total_amount"],
     ["revenue", "amount", "value", "price", "cost", "sale"]),
    ("customer_name", "Customer Name", False,
     ["customer_name", "client_name", "buyer_name"],
     ["customer.*name", "client.*name", "buyer.*name"]),
    ("product_name", "Product", False,
     ["product_name", "item_name", "service_name"],
     ["product", "item", "service", "plan"]),
    ("quantity", "Quantity", False,
     ["quantity", "qty", "units"],
     ["quantity", "qty", "units", "volume"]),
    ("order_id", "Order ID", False,
     ["order_id", "orderid", "purchase_id"],
     ["order", "purchase", "invoice"]),
    ("language", "Language", False,
     ["language", "locale", "lang"],
     ["language", "locale", "lang"]),
    ("priority", "Priority", False,
     ["priority", "urgency"],
     ["priority", "urgency", "severity"]),
]

# The default labelling rules.
LABEL_RULES = {
    "connection": {
        "min_duration_seconds": 30,
        "min_transcript_words": 40,
        "disconnection_keywords": [
            "voicemail", "leave a message", "unavailable", "call back later",
            "no one available", "mailbox", "beep after the tone",
        ],
        "connection_keywords": [
            "speaking", "how can I help", "thank you for calling", "good morning",
            "good afternoon", "my name is",
        ],
    },
    "call_types": {
        "inquiry": [
            "information", "question about", "wondering", "could you tell me", "want to know",
            "curious about", "details about", "explain", "how does", "what is",
        ],
        "billing_sales": [
            "invoice", "bill", "payment", "charge", "price", "cost", "purchase", "buy", "order",
            "subscription", "upgrade", "discount", "refund", "credit",
        ],
        "support": [
            "not working", "broken", "error", "problem", "issue", "trouble", "help with", "fix",
            "technical", "doesn't work", "crashed", "failed", "bug",
        ],
        "complaint": [
            "complaint", "unhappy", "disappointed", "poor service", "unacceptable", "frustrated",
            "angry", "escalate", "manager", "supervisor", "terrible", "worst",
        ],
    },
    "outcomes": {
        "resolved": [
            "resolved", "fixed", "solved", "sorted out", "taken care of", "all set",
            "working now", "happy to help", "glad we could", "anything else",
        ],
        "callback": [
            "call you back", "callback", "follow up", "get back to you", "return your call",
            "schedule another call", "speak again", "reach out later",
        ],
        "refund": [
            "refund processed", "money back", "credit issued", "reimbursement",
            "return approved", "refund your", "credited to your account",
        ],
        "sale_close": [
            "purchase complete", "order placed", "payment received", "transaction successful",
            "thank you for your order", "confirmation number", "receipt sent",
            "subscription activated",
        ],
        "unresolved": [
            "still not working", "problem persists", "need to escalate", "couldn't resolve",
            "ongoing issue", "will investigate", "need more time",
        ],
    },
    "scoring": {
        "keyword_weight": 1.0,
        "phrase_weight": 2.0,
        "exact_match_weight": 3.0,
        "min_confidence_score": 0.6,
        "fuzzy_matching": True,
        "fuzzy_threshold": 0.85,
    },
    "priorities": {
        "call_type_priority": ["complaint", "support", "billing_sales", "inquiry"],
        "outcome_priority": ["unresolved", "refund", "callback", "sale_close", "resolved"],
    },
    "custom_rules": {
        "urgent_complaint": r"(?i)(extremely|very|really)\s+(unhappy|disappointed|frustrated)",
        "vip_customer": r"(?i)(premium|vip|gold|platinum)\s+(member|customer|client)",
        "technical_escalation": r"(?i)(critical|severe|major)\s+(bug|issue|problem)",
    },
}

# Column lists and date formats of the CSV export profiles.
EXPORT_PROFILES = {
    "standard": (
        ["call_id", "timestamp", "phone_number", "agent_id", "campaign", "outcome", "duration",
         "revenue", "notes"],
        "yyyy-MM-dd HH:mm:ss",
    ),
    "detailed": (None, "yyyy-MM-dd HH:mm:ss"),
    "summary": (["call_id", "timestamp", "outcome", "duration", "revenue"], "yyyy-MM-dd"),
}

# The audio suffixes and the largest audio file.
AUDIO_SUFFIXES = [".wav", ".mp3", ".m4a", ".ogg", ".flac"]
AUDIO_MAX_BYTES = 500 * 1024 * 1024

# Names that ask for the same metric.
METRIC_ALIASES = {
    "average_duration": ["duration", "average_duration", "avg_duration"],
    "total_calls": ["total_calls", "count", "volume"],
    "connection_rate": ["connection_rate", "success_rate"],
    "total_revenue": ["revenue", "total_revenue"],
}

# Currency symbols of the report columns.
CURRENCY_SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥", "CNY": "¥"}

# Month names in question texts.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4,
    "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9,
    "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12,
    "december": 12,
}

# Patterns in lower-case question texts.
QUESTION_PATTERNS = {
    "last_n_days": r"last\s+(\d+)\s+days?",
    "last_n_hours": r"last\s+(\d+)\s+hours?",
    "yesterday": r"\byesterday\b",
    "today": r"\btoday\b",
    "this_week": r"this\s+week",
    "last_week": r"last\s+week",
    "this_month": r"this\s+month",
    "last_month": r"last\s+month",
    "agent": r"agent\s+(\w+)",
    "campaign": r'campaign\s+"([^"]+)"',
    "call_type": r"(inquiry|support|complaint|billing|sales)",
    "outcome": r"(resolved|callback|refund|sale)",
    "count": r"\b(count|number|how many)\b",
    "average": r"\b(average|avg|mean)\b",
    "sum": r"\b(sum|total)\b",
    "max": r"\b(max|maximum|highest)\b",
    "min": r"\b(min|minimum|lowest)\b",
    "greater_than": r"(greater than|more than|over|above|>)\s*(\d+)",
    "less_than": r"(less than|fewer than|under|below|<)\s*(\d+)",
    "between": r"between\s+(\d+)\s+and\s+(\d+)",
    "find": r"\b(find|search|look for)\b",
    "compare": r"\b(compare|versus|vs)\b",
    "analyze": r"\b(analyze|analysis|breakdown)\b",
    "day_ymd": r"\b(\d{4})[-/](0?[1-9]|1[0-2])[-/](0?[1-9]|[12]\d|3[01])\b",
    "day_mdy": r"\b(0?[1-9]|1[0-2])[-/](0?[1-9]|[12]\d|3[01])[-/](\d{4})\b",
    "month_ym": r"\b(\d{4})[-/](0?[1-9]|1[0-2])\b",
    "month_my": r"\b(0?[1-9]|1[0-2])[-/](\d{4})\b",
}

# Strings that each of these patterns needs: one of every tuple.
QUESTION_HINTS: dict[str, list[tuple[str, ...]]] = {
    "last_n_days": [("last",), ("day",)],
    "last_n_hours": [("last",), ("hour",)],
    "yesterday": [("yesterday",)],
    "today": [("today",)],
    "this_week": [("this",), ("week",)],
    "last_week": [("last",), ("week",)],
    "this_month": [("this",), ("month",)],
    "last_month": [("last",), ("month",)],
    "agent": [("agent",)],
    "campaign": [("campaign",)],
    "call_type": [("inquiry", "support", "complaint", "billing", "sales")],
    "outcome": [("resolved", "callback", "refund", "sale")],
    "count": [("count", "number", "how many")],
    "average": [("average", "avg", "mean")],
    "sum": [("sum", "total")],
    "max": [("max", "highest")],
    "min": [("min", "lowest")],
    "greater_than": [("greater than", "more than", "over", "above", ">")],
    "less_than": [("less than", "fewer than", "under", "below", "<")],
    "between": [("between",), ("and",)],
    "find": [("find", "search", "look for")],
    "compare": [("compare", "versus", "vs")],
    "analyze": [("analyze", "analysis", "breakdown")],
    "day_ymd": [("-", "/")],
    "day_mdy": [("-", "/")],
    "month_ym": [("-", "/")],
    "month_my": [("-", "/")],
}

# Patterns of the one-line filter questions.
FILTER_QUESTION_PATTERNS = {
    "date_range": r"(?i)between\s+(\d{4}-\d{2}-\d{2})\s+and\s+(\d{4}-\d{2}-\d{2})",
    "last_n_days": r"(?i)last\s+(\d+)\s+days?",
    "call_type": r"(?i)(inquiry|billing|sales|support|complaint)",
    "outcome": r"(?i)(resolved|callback|refund|sale|connected|failed)",
    "duration": r"(?i)duration\s*([<>])\s*(\d+)",
    "amount": r"(?i)\$(\d+(?:\.\d{2})?)\s*(?:to|-)\s*\$(\d+(?:\.\d{2})?)",
}

# First words of the explanation of a question.
ACTION_WORDS = {
    "search": "Searching for",
    "filter": "Filtering",
    "aggregate": "Calculating statistics for",
    "compare": "Comparing",
    "analyze": "Analyzing",
}
