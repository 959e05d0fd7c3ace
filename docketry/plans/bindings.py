"""Parameters that bind the operators to the sample tables: lexicons and rule
tables made of fragments that occur in their invented prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketry.functions.scale import small_table
from docketry.operators.intake import accepted_length, normalize
from docketry.sources.loaders import table, with_keyword_signals

DEPARTMENTS = (("north", "North desk"), ("south", "South desk"), ("spare", "Spare desk"))
UNITS = (("intake-a", "Intake A", "north"), ("intake-b", "Intake B", "north"), ("records", "Records", "south"), ("spare-unit", "Spare unit", "spare"))
TYPES = (
    # id, label, unit, {language: keywords}
    ("street-works", "Street works", "intake-a",
     {"en": ("thble", "attion", "oning", "erble", "retion"), "de": ("enlich", "erung", "einheit", "schung", "einlich")}),
    ("permits", "Permits", "intake-b",
     {"en": ("thtion", "ering", "onble", "antion", "ining"), "fr": ("ément", "étion", "ouaux", "letre", "queque")}),
    ("billing", "Billing", "records",
     {"en": ("thing", "ertion", "ontion", "heble", "reing"), "es": ("ciónado", "ciónos", "mente", "asción", "esque")}),
    ("archive", "Archive", "records",
     {"de": ("erkeit", "enver", "chver", "erheit", "enung"), "fr": ("èment", "oument", "aique", "outre", "ouier")}),
)
SIGNALS = (
    # request type, language, concept groups of alternative forms
    ("street-works", "en", (("thble$", "thbleo"), ("attion",), ("oning", "onin"), ("of the erble", "was the"), ("edble",))),
    ("street-works", "de", (("enlich",), ("erung$", "einheit"), ("für das", "schung"))),
    ("permits", "en", (("thtion$",), ("eriner", "ering"), ("onble", "inble"), ("with the on", "by the"))),
    ("permits", "fr", (("ement",), ("etion", "ouaux$"), ("dans les", "queque"), ("letre",))),
    ("billing", "en", (("thing",), ("ertion$", "estion"), ("hat",), ("heble", "reing"))),
    ("billing", "es", (("cionado", "cionos"), ("mente$",), ("esque", "por la"))),
)
TAXONOMY_VERSION = "sample-v1"
CHAIN = tuple((t, label, u, ul, d, dl) for t, label, u, _ in TYPES for uid, ul, d in UNITS if uid == u for did, dl in DEPARTMENTS if did == d)
KEYWORDS = tuple((t, lang, n, w) for t, _l, _u, lists in TYPES for lang, words in lists.items() for n, w in enumerate(words))
FORMS = tuple((t, lang, g, n, form) for t, lang, groups in SIGNALS for g, forms in enumerate(groups) for n, form in enumerate(forms))

LANGUAGE_MARKERS = {
    "en": ("the", "of", "and", "to", "is", "that", "it", "for", "was", "with", "by", "this", "are", "from"),
    "fr": ("le", "et", "les", "des", "du", "une", "pour", "est", "qui", "par", "dans", "sur", "au", "avec"),
    "de": ("der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "auf", "ist", "nicht", "dem"),
    "es": ("el", "y", "los", "se", "del", "las", "por", "con", "su", "una", "para", "al", "lo"),
}
DOCUMENT_RULES = (
    ("petition", "basic", ("the", "with", "thing", "erble", "oning", "attion", "ouaux", "enlich")),
    ("complaint", "full", ("der", "nicht", "enver", "chver", "thtion", "ering", "onble", "antion", "ining", "aning")),
    ("question", "short", ("que", "les", "ciónado", "mente", "ément", "étion", "retion", "heble")),
)
SALUTATION = ("petition", "the", 0.1)
OPENING = (("complaint", 0.15), ("question", 0.15))
DEPARTMENT_RULES = (
    ("Works office", ("thble", "ertion", "eriner", "enein", "ersch", "oueau")),
    ("Permit office", ("ontion", "retion", "aning", "einbe", "letre", "ciónue", "thanea")),
    ("Finance office", ("reing", "ining", "anble", "ungein", "aieau", "ciónos")),
)
REQUIRED_FIELDS = {
    "petition_basic": ("Email", "Phone", "Number"),
    "complaint_full": ("Email", "Address", "Token", "Number"),
    "question_short": ("Email", "Word"),
}
FIELD_PATTERNS = {
    "Email": r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+",
    "Phone": r"\+1 \(\d{3}\) 555-\d{4}",
    "Number": r"\d{4,}",
    "Address": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
    "Token": r"token",
    "Word": r"(?i)elle",
}
LEGISLATION = (("thanedble", ("Act one", "Act two")), ("einheit", ("Act three", "Act four")), ("ouaux", ("Act five", "Act six", "Act seven")))
LETTERS = (("petition", "Works office", ("Result letter",)), ("complaint", "*", ("Inquiry letter",)), ("question", "Permit office", ("Answer letter",)))
PRIORITY_RULES = (
    ("critical", 100, "thanedble", "Safety"), ("critical", 100, "einheit", "Structure"),
    ("high", 70, "ouaux", "Water"), ("high", 70, "ciónado", "Hygiene"),
)
BEHAVIOR = (("nicht", 1.0), ("enver", .45), ("letre", .35), ("les des", .7), ("mente", .3), ("que", .2))
BEHAVIOR_EN = (("thble", .35), ("attion", .4), ("of the", .45), ("erble", .7))
PII_PATTERNS = (
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), ("PHONE", r"\+1 \([0-9]{3}\) 555-[0-9]{4}"),
    ("IP", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), ("CARD", r"[0-9]{16}"),
)
CHARSET = "a-zà-öø-ÿ0-9"
STOPWORDS = ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "with", "be", "by", "as", "this", "are", "at", "from", "an")


def sample_taxonomy(spark: SparkSession) -> dict[str, DataFrame]:
    make = lambda rows, schema: small_table(spark, rows, schema)
    keywords = make(list(KEYWORDS), "request_type_id string, language string, keyword_ord int, keyword string")
    forms = make(list(FORMS), "request_type_id string, language string, group_ord int, form_ord int, form string")
    return {
        "departments": make([(*d, True) for d in DEPARTMENTS], "department_id string, department_label string, active boolean"),
        "units": make([(*u, True) for u in UNITS], "unit_id string, unit_label string, department_id string, active boolean"),
        "request_types": make([(n, t, label, u, TAXONOMY_VERSION) for n, (t, label, u, _k) in enumerate(TYPES)],
                              "type_ord int, request_type_id string, request_type_label string, unit_id string, taxonomy_version string"),
        "keywords": keywords, "signals": with_keyword_signals(keywords, forms),
    }


def normalized_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", spread="doc_id").select("doc_id", "source", "lang", "text")
    return normalize(docs, "text").drop("text")


def accepted_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Normalised documents that pass the length gate."""
    docs = normalized_documents(spark, folder)
    return docs.where(accepted_length(F.col("normalized_text")))


# The same two steps in SQL, shared by the oracle texts.
SQL_NORMAL = r"""norm AS (SELECT doc_id, source, lang, regexp_replace(nfc_normalize(regexp_replace(text, '\r\n?', chr(10), 'g')),
  '[\x00-\x08\x0B-\x1F\x7F-\x9F\x{200B}-\x{200F}\x{FEFF}\x{00AD}]', '', 'g') AS t FROM documents),
gated AS (SELECT * FROM norm WHERE length(regexp_replace(t, '^\s+|\s+$', '', 'g')) > 0 AND length(t) >= 40)"""
SQL_FOLD = "replace(lower(nfc_normalize({0})), 'ß', 'ss')"
SQL_LOOSE = "translate(replace(lower(nfc_normalize({0})), 'ß', 'ss'), 'ışğüöçâîûêô', 'isguocaiueo')"
