"""Fixed values.

Section 1 holds values that must equal the behaviour we re-implement
(patterns, label table, prompt texts, sizes); they are stated as plain text,
in their natural order. Section 2 holds our own detector patterns: they
replace a statistical analyzer and are written to mean the same in Java regex
(Spark) and RE2 (DuckDB oracle): no look-around, ``[0-9]`` instead of ``\\d``,
``\\b`` only next to digits or ``_``.
"""

# ---------------------------------------------------------------------------
# 1. Fixed values that must match the re-implemented behaviour
# ---------------------------------------------------------------------------

# Ticket id: extraction ignores case and keeps the original case; the first
# match wins.
TICKET_ID_EXTRACT = r"(?i)\b(IN[0-9]{4,7})\b"

# Chunk sizes (characters) and overlap per store; retrieval depth.
KB_CHUNK_SIZE, KB_CHUNK_OVERLAP = 1000, 200
SLA_CHUNK_SIZE, SLA_CHUNK_OVERLAP = 512, 200
TOP_K = 10

# Recursive splitter separators, coarsest first.
RECURSIVE_SEPARATORS = ["\n\n", "\n", " ", ""]

# Friendly label table, applied as literal replacements in this order.
FRIENDLY_LABELS = [
    ("<DATE_TIME>", "[REDACTED DATE/TIME]"),
    ("<PERSON>", "[REDACTED NAME]"),
    ("<PHONE_NUMBER>", "[REDACTED PHONE]"),
    ("<EMAIL_ADDRESS>", "[REDACTED EMAIL]"),
    ("<CREDIT_CARD>", "[REDACTED CARD]"),
    ("<SSN>", "[REDACTED SSN]"),
]
# Generic label rule for the remaining <TAG>s: special names first, else drop a
# leading 1-3 letter prefix with its underscore, underscores to spaces, title case.
SPECIAL_LABELS = [("IN_PAN", "PAN")]
GENERIC_TAG = r"<([A-Z0-9_]+)>"
GENERIC_TAG_PREFIX = r"^[A-Z]{1,3}_"

# Answer post-processing: a redaction token after the word "ticket".
TICKET_REDACTION = r"(?i)(ticket(?:\s*(?:number|no\.?|#)?)\s*)(__?\[REDACTED[^\]]+\]__?)"
REDACTION_TOKEN = r"__?\[REDACTED[^\]]+\]__?"
TICKET_HEADER = "Ticket: {id}\n\n"

# Prompt texts.
KB_PROMPT_HEAD = (
    "\nYou are a support assistant that answers questions based only on the retrieved data.\n"
    "\n"
    "Important: The context and question have been anonymized; any PII values were replaced by placeholders\n"
    "like __PII_0__, __PII_1__, etc. When you refer to ticket identifiers please use the exact ticket id provided\n"
    "in the question (it will be visible as a preserved token). Do not invent new PII.\n"
    "\n"
    "Context:\n"
)
KB_PROMPT_MID = "\n\nQuestion: "
KB_PROMPT_TAIL = "\nAnswer:"
SLA_PROMPT_MID = (
    "\n\nImportant: The context and question have been anonymized; any PII values were replaced by "
    "placeholders like __PII_0__. When returning the answer, do NOT invent new PII values. "
    "Use the preserved ticket id as provided.\n\nQuestion: "
)
SLA_PROMPT_TAIL = "\nAnswer:"

# ---------------------------------------------------------------------------
# 2. Our detector patterns (re-aim of the statistical analyzer)
# ---------------------------------------------------------------------------

# Preserved tokens: ticket ids (case-insensitive, deviation V5). While the
# detectors run, the i-th preserved token is masked as U+E000 <i> U+E001
# (private-use characters: no detector matches them); text that already holds
# such a mask is preserved as well, so masking and unmasking round-trip.
PRESERVE = r"(?i)\bIN[0-9]{4,7}\b|\x{E000}[0-9]+\x{E001}"
MASK_OPEN, MASK_CLOSE = "\ue000", "\ue001"
MASK_NUMBER = r"\x{E000}([0-9]+)\x{E001}"
PRESERVE_PREFIX = "__PRESERVED__"
PII_PREFIX = "__PII_"
# Everything restore() maps back, in one pass.
PLACEHOLDER = r"__PII_[CQ]?[0-9]+__|__PRESERVED__[CQ]?[0-9]+__"

# (entity, pattern, needs Luhn check). Order is the detector priority.
DETECTORS = [
    ("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", False),
    ("PHONE_NUMBER", r"(?:\+[0-9]{1,3} ?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}", False),
    ("CREDIT_CARD", r"\b[0-9]{13,16}\b", True),
    ("IP_ADDRESS", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", False),
    ("US_SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", False),
    ("IBAN_CODE", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", False),
    ("IN_PAN", r"[A-Z]{5}[0-9]{4}[A-Z]", False),
    ("DATE_TIME", r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}(?: [0-9]{2}:[0-9]{2}(?::[0-9]{2})?)?\b", False),
]
# Text that already looks like one of our placeholders is itself treated as
# a span, so a literal "__PII_0__" in the input is restored as that literal.
PLACEHOLDER_DETECTOR = ("PLACEHOLDER", PLACEHOLDER, False)

# A text a detector can match must contain this literal, or any digit when
# None: a necessary condition checked before the regex passes run.
DETECTOR_GUARD = {"EMAIL_ADDRESS": "@", "PLACEHOLDER": "__"}

# Per-language detector choice (A14): US-specific formats only for English.
US_ONLY = {"US_SSN"}
LANG_DETECTORS = {
    lang: [d for d in DETECTORS if lang == "en" or d[0] not in US_ONLY]
    for lang in ("en", "de", "fr", "es")
}

# Sparse embedding: the lower-cased text is cut at everything that is no
# letter, mark or digit of any script; scripts written without spaces give one
# token a character. A token's bucket is the first 32 bits of its md5.
TOKEN_SPLIT = r"[^\p{L}\p{M}\p{N}]+"
SPACELESS = r"([\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}])"
