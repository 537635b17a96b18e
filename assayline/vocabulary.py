"""Fixed values.

The word lists, patterns, labels and limits below decide the results, so they are stated here once, as plain
text, and nothing else in the package repeats them.
"""

from __future__ import annotations

# --- fixed values: corpus columns, in file order ---------------------------------------------------------
CORPUS_COLUMNS = (
    "id", "source", "document_id", "court", "esas_no", "karar_no", "karar_tarihi",
    "year", "month", "text", "text_len", "masked_count", "raw_sha256",
)
METADATA_KEY = ("source", "court", "esas_no", "karar_no")

# --- fixed values: template placeholders left in a text, most severe first -------------------------------
PLACEHOLDERS = {
    "placeholder_deneme": "deneme karar metni",
    "placeholder_ilgili_ceza_mah": "ilgilicezamahadi",
    "placeholder_dava_turu": "davaturu",
}

# --- fixed values: words that mark a real decision text --------------------------------------------------
MARKERS = {
    "has_court_name": ("yargıtay", "yargitay"),
    "has_karar": ("karar",),
    "has_esas": ("esas",),
    "has_terminal_marker": ("sonuç", "sonuc", "hüküm", "hukum"),
}

# --- fixed values: text length limits --------------------------------------------------------------------
SHORT_LIMITS = (100, 300, 500)
SHORT_TEXT = 300

# --- fixed values: direct identifiers, in masking order (label, name of the row counter, pattern) ---------
DIRECT_PATTERNS = (
    ("IBAN", "iban_tr_unmasked",
     r"(?i)(^|[^A-Z0-9])TR[0-9]{24}([^A-Z0-9]|$)"),
    ("EPOSTA", "email_unmasked",
     r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"),
    ("TELEFON", "turkish_mobile_unmasked",
     r"(?i)(^|[^0-9])(?:\+?90[ .-]?)?0?5[0-9]{2}[ .-]?[0-9]{3}[ .-]?[0-9]{2}[ .-]?[0-9]{2}([^0-9]|$)"),
    ("TCKN", "tckn_labeled_11_digits",
     r"(?i)(?:t\.?c\.?|tc|türkiye cumhuriyeti)[ ]*(?:kimlik)?[ ]*(?:no|numarası|numaralı|numara)?"
     r"[^0-9]{0,12}[1-9][0-9]{10}"),
    ("KART", "card_labeled_13_19_digits",
     r"(?i)(?:kart|kredi kartı|banka kartı)[^0-9]{0,20}[0-9][0-9 .-]{11,25}[0-9]"),
)

# A literal each match must hold: a cheap test that spares the regular expression on most rows.
NEEDLES = {"EPOSTA": "@"}
# The middle of a pattern without its edges, which are slow to try at every character.
CORES = {"IBAN": "(?i)TR[0-9]{24}"}
# What each match of the four number patterns holds: ten characters of digits and separators, from a digit on.
DIGIT_RUN = "[0-9][0-9 .-]{9}"

# --- fixed values: the same two identifiers with guards that do not eat the neighbouring character --------
GUARDED_PATTERNS = {
    "IBAN": r"(?i)(?<![A-Z0-9])TR[0-9]{24}(?![A-Z0-9])",
    "TELEFON": r"(?i)(?<![0-9])(?:\+?90[ .-]?)?0?5[0-9]{2}[ .-]?[0-9]{3}[ .-]?[0-9]{2}[ .-]?[0-9]{2}(?![0-9])",
}

# --- fixed values: mask tokens set by the publisher of a corpus -------------------------------------------
MASK_TOKENS = {
    "mask_tckn_rows": "[TCKN]",
    "mask_iban_rows": "[IBAN]",
    "mask_telefon_rows": "[TELEFON]",
    "mask_eposta_rows": "[EPOSTA]",
    "mask_kart_rows": "[KART]",
}

# --- fixed values: contextual signals ---------------------------------------------------------------------
CONTEXT_PATTERNS = {
    "party_role_label":
        r"(?i)\b(sanık|mağdur|müşteki|katılan|şüpheli|davacı|davalı|hükümlü|suça sürüklenen çocuk)\b",
    "address_signal":
        r"(?i)\b(adres|ikametg[aâ]h|mahallesi|mah\.|sokak|sok\.|cadde|cad\.)\b",
    "health_sensitive_signal":
        r"(?i)\b(hiv|aids|kanser|şizofren|bipolar|epilepsi|gebelik|hamile|psikiyatr|engelli|özürlü)\b",
    "minor_signal":
        r"(?i)\b(çocuk|küçük|reşit olmayan|suça sürüklenen çocuk)\b",
    "victim_signal":
        r"(?i)\b(mağdur|müşteki|katılan)\b",
    "name_like_after_role":
        r"(?i)\b(sanık|mağdur|müşteki|katılan|şüpheli|davacı|davalı)\s*[:\-]?\s+"
        r"[A-ZÇĞİÖŞÜ][a-zçğıöşü]+(?:\s+[A-ZÇĞİÖŞÜ][a-zçğıöşü]+){1,3}\b",
}

# --- fixed values: character classes and key pattern ------------------------------------------------------
NAME_CHARS = "0-9a-zçğıöşü"
NORMAL_CHARS = "0-9a-zçğıöşü /.:,-"
KEY_PATTERN = r"([0-9]{4})\s*/\s*0*([0-9]+)"

# --- fixed values: eras, sample sizes, limits -------------------------------------------------------------
MODERN_YEARS = (2016, 2026)
MIDDLE_YEARS = (2006, 2015)
COMPLETE_YEARS = (2016, 2025)
GAP_YEARS = (2017, 2024)
MODERN_PER_YEAR = 70
MIDDLE_PER_YEAR = 19
OLD_TOTAL = 40
MODERN, MIDDLE, OLD = "modern_2016_2026", "mid_2006_2015", "old_pre_2006"
VERIFY_ALLOCATION = {MODERN: 70, MIDDLE: 20, OLD: 10}
CONTEXT_SAMPLE = {1: 40_000, 0: 10_000}
ENTITY_SAMPLE = {1: 200, 0: 50}
ENTITY_THRESHOLDS = (0.80, 0.90)
WINDOW_CHARS = 1500
WINDOW_OVERLAP = 100
GAP_FLOOR = 1000
SIMILARITY_LIMITS = (0.95, 0.90)
RATIO_LIMITS = (0.98, 0.95)
SAMPLE_SEED = 20260919
REVIEW_COLUMNS = ("official_source_status", "metadata_match", "text_match", "reviewer_note")
SAFE_FIELDS = (
    "documentId", "document_id", "id", "itemType", "kararTarihi", "karar_tarihi",
    "esasNo", "esas_no", "kararNo", "karar_no", "birimAdi", "daire", "court",
)
PHRASES = ("karar", "esas", "mahkeme", "karar OR esas", "karar OR esas OR mahkeme", "dosya")

# --- fixed values: acceptance targets (metric, comparison, threshold) -------------------------------------
TARGETS = (
    ("metadata_accuracy", ">=", 0.995),
    ("valid_document_rate", ">=", 0.995),
    ("full_text_rate", ">=", 0.99),
    ("exact_duplicate_rate", "<", 0.001),
    ("near_duplicate_rate", "<", 0.01),
    ("critical_coverage_gaps", "<=", 0.0),
    ("official_match_rate", ">=", 0.99),
)
ACCEPT, CONDITIONAL, REJECT = "ACCEPT", "ACCEPT_WITH_CONDITIONS", "REJECT"
