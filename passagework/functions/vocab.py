"""Fixed values.

Everything in this module is a value the results depend on: character tables,
word lists, lexicons, keyword lists, thresholds and allowed enum values. They are
stated as plain data in their natural order. Every operator takes them as keyword
arguments, so another corpus or language can pass its own.
"""

# --------------------------------------------------------------------------
# Characters (fixed values)
# --------------------------------------------------------------------------

#: White space as Unicode-aware string methods see it, for Java and RE2 classes.
WHITESPACE = r"\t-\r\x1c-\x20\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

DIACRITICS = r"\u064b-\u065f\u0670\u06d6-\u06dc\u06df-\u06e8\u06ea-\u06ed\u08d3-\u08ff\ufe00-\ufe0f"
TATWEEL = r"\u0640"
WAQF_MARKS = r"\u06d6-\u06ed\u08e2"
ORNAMENTS = r"\u06de\u06e9\ufd3e\ufd3f\u200b-\u200f\u202a-\u202e\u2066-\u2069"
HAMZA = r"\u0621"
ARABIC_LETTERS = r"\u0621-\u063a\u0641-\u064a\u0671-\u06d3"
URDU_LETTERS = r"\u0679\u0688\u0691\u06ba\u06d2\u06c1\u06be\u06af\u0686\u067e\u0698\u06c2\u06d3\u0674"

ALEF_FOLDS = {
    "آ": "ا",
    "أ": "ا",
    "إ": "ا",
    "ٱ": "ا",
    "ٲ": "ا",
    "ٳ": "ا",
    "ٵ": "ا",
}
LETTER_FOLDS = {
    "ى": "ي",
    "ی": "ي",
    "ة": "ه",
    "ؤ": "و",
    "ئ": "ي",
    "ک": "ك",
    "ں": "ن",
    "ہ": "ه",
    "ۃ": "ه",
    "ە": "ه",
}
DIGIT_FOLDS = dict(zip("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"))
PUNCTUATION_FOLDS = {
    "،": ",",
    "؛": ";",
    "؟": "?",
    "٪": "%",
    "٫": ".",
    "٬": ",",
    "٭": "*",
    "۔": ".",
    "‐": "-",
    "‑": "-",
    "‒": "-",
    "–": "-",
    "—": "-",
    "“": "\"",
    "”": "\"",
    "‘": "'",
    "’": "'",
    "«": "\"",
    "»": "\"",
}

# --------------------------------------------------------------------------
# Words (fixed values)
# --------------------------------------------------------------------------

URDU_FUNCTION_WORDS = [
    "کا", "کی", "کے", "میں", "سے", "پر", "ہے", "ہیں", "نے", "کو", "اور", "یہ", "وہ", "کیا", "کیوں", "کہ", "تھا",
    "تھی", "ہوتا", "کرنا", "والے", "والا", "بارے", "مطابق", "تفسیر", "کون", "کہاں",
]

ARABIC_FUNCTION_WORDS = [
    "في", "من", "على", "عن", "الى", "إلى", "هذا", "هذه", "ذلك", "التي", "الذي", "ما", "هل", "كيف", "لماذا", "متى",
    "اين", "أين", "قال", "وقال", "تفسير", "معنى", "الاية", "الآية", "سورة", "بين", "عند",
]

#: Words that never make a run of canonical words evidence of a treatment.
CLAUSE_FUNCTION_WORDS = [
    "ما", "في", "من", "علي", "الي", "عن", "هو", "هي", "هم", "لا", "الا", "ان", "انه", "اني", "الذي", "التي", "له",
    "لها", "لهم", "به", "بها", "عليه", "عليها", "ذلك", "هذا", "هذه", "ثم", "قد", "كان", "كانت", "يكون",
]

#: Words left out when lexical support is measured.
SUPPORT_STOP_WORDS = [
    "ما", "في", "من", "علي", "الي", "عن", "هو", "هي", "هم", "لا", "الا", "ان", "انه", "اني", "الذي", "التي", "وهو",
    "وهي", "له", "لها", "لهم", "به", "بها", "عليه", "عليها", "ذلك", "هذا", "هذه", "ثم", "قد", "كان", "كانت", "يكون",
    "قال", "وقد", "وقال", "ايضا", "بين", "عند", "كل", "اذا", "حتي", "لكن", "او", "ام", "بل",
]

#: Clitics, in the order they are tried.
CLITICS = [
    "وال", "فال", "بال", "كال", "لل", "ال", "و", "ف", "ب", "ك", "ل",
]

#: Headers that announce a clause under discussion.
CLAUSE_HEADERS = [
    "القول في تأويل قوله تعالى",
    "القول في تأويل قوله",
    "قوله عز وجل",
    "قوله تعالى",
    "وقوله تعالى",
    "وقوله عز وجل",
]

#: Headers that open a new unit when commentary is chunked.
UNIT_HEADERS = [
    "القول في تأويل قوله",
    "وقوله تعالى",
    "وقوله",
    "القول في",
    "تفسير قوله تعالى",
    "يقول تعالى ذكره",
]

LATIN_ARTICLES = [
    "al", "an", "ar", "as", "ash", "at", "az", "ad", "adh", "ath", "a",
]
NAME_FILLER_WORDS = ["ال", "من", "في", "عن", "الكريمة", "الكريم", "رقم"]

#: Conventional names of well-known places: names, chapter, first and last verse.
PLACE_ALIASES = [
    (["Ayat al-Kursi", "Ayatul Kursi", "آية الكرسي", "آیت الکرسی", "aayat ul kursi"], 2, 255, 255),
    (["Al-Fatiha", "Surah Fatiha", "سورة الفاتحة"], 1, 1, 7),
    (["Al-Ikhlas", "سورة الإخلاص"], 112, 1, 4),
]

#: Verses per chapter of the canonical text, chapters 1 to 114.
CHAPTER_VERSE_COUNTS = [
    7, 286, 200, 176, 120, 165, 206, 75, 129, 109, 123, 111, 43, 52, 99, 128, 111, 110, 98, 135,
    112, 78, 118, 64, 77, 227, 93, 88, 69, 60, 34, 30, 73, 54, 45, 83, 182, 88, 75, 85,
    54, 53, 89, 59, 37, 35, 38, 29, 18, 45, 60, 49, 62, 55, 78, 96, 29, 22, 24, 13,
    14, 11, 11, 18, 12, 12, 30, 52, 52, 44, 28, 28, 20, 56, 40, 31, 50, 40, 46, 42,
    29, 19, 36, 25, 22, 17, 19, 26, 30, 20, 15, 21, 11, 8, 8, 19, 5, 8, 8, 11,
    11, 8, 3, 9, 5, 4, 7, 3, 6, 3, 5, 4, 5, 6,
]

#: Prefixes stripped from a chapter's full name when the chapter table is derived.
CHAPTER_NAME_PREFIXES = ["سُورَةُ ", "سُورَة ", "سورة "]

# --------------------------------------------------------------------------
# Lexicons into the pivot language (fixed values)
# --------------------------------------------------------------------------

LEXICON_EN = {
    "occasion of revelation": "سبب النزول", "occasions of revelation": "أسباب النزول",
    "reason for revelation": "سبب النزول", "abrogation": "النسخ", "abrogated": "منسوخ",
    "commentary": "تفسير", "tafsir": "تفسير", "tafseer": "تفسير", "tafasir": "تفسير",
    "tafaseer": "تفسير", "mufassir": "المفسر", "mufassirun": "المفسرون",
    "commentators": "المفسرون", "exegetes": "المفسرون", "scholars": "العلماء",
    "interpretation": "تأويل", "exegesis": "تفسير", "variant reading": "قراءة",
    "variant readings": "القراءات", "recitation": "قراءة", "chain of narration": "إسناد",
    "narration": "رواية", "tradition": "حديث", "hadith": "حديث", "companion": "صحابي",
    "companions": "الصحابة", "successor": "تابعي", "successors": "التابعون",
    "consensus": "إجماع", "legal ruling": "حكم", "ruling": "حكم", "rulings": "الأحكام",
    "jurisprudence": "الفقه", "creed": "العقيدة", "theology": "الكلام", "grammar": "النحو",
    "syntax": "الإعراب", "rhetoric": "البلاغة", "morphology": "الصرف", "meaning": "معنى",
    "meanings": "معاني", "word": "لفظ", "verse": "آية", "verses": "آيات", "chapter": "سورة",
    "monotheism": "التوحيد", "oneness of god": "التوحيد", "divine attributes": "الصفات",
    "attributes of god": "صفات الله", "sovereignty": "الملك", "dominion": "الملك",
    "throne": "الكرسي", "intercession": "الشفاعة", "forgiveness": "المغفرة",
    "mercy": "الرحمة", "repentance": "التوبة", "punishment": "العذاب", "reward": "الثواب",
    "paradise": "الجنة", "hellfire": "النار", "resurrection": "البعث",
    "judgement": "الحساب", "prophet": "النبي", "messenger": "الرسول", "revelation": "الوحي",
    "guidance": "الهداية", "disbelief": "الكفر", "faith": "الإيمان", "worship": "العبادة",
    "prayer": "الصلاة", "knowledge": "العلم", "life": "الحياة", "living": "الحي",
    "eternal": "القيوم", "sleep": "النوم", "slumber": "سنة", "heavens": "السماوات",
    "earth": "الأرض", "compulsion": "إكراه", "religion": "الدين",
}

LEXICON_UR = {
    "شان نزول": "سبب النزول", "سبب نزول": "سبب النزول", "تفسیر": "تفسير", "معنی": "معنى",
    "مطلب": "معنى", "آیت": "آية", "آیات": "آيات", "سورہ": "سورة", "حدیث": "حديث",
    "روایت": "رواية", "صحابہ": "الصحابة", "قراءت": "القراءات", "احکام": "الأحكام",
    "فقہ": "الفقه", "عقیدہ": "العقيدة", "نحو": "النحو", "اعراب": "الإعراب",
    "بلاغت": "البلاغة", "توحید": "التوحيد", "شفاعت": "الشفاعة", "مغفرت": "المغفرة",
    "رحمت": "الرحمة", "توبہ": "التوبة", "عذاب": "العذاب", "جنت": "الجنة", "دوزخ": "النار",
    "قیامت": "البعث", "نبی": "النبي", "رسول": "الرسول", "وحی": "الوحي", "ہدایت": "الهداية",
    "کفر": "الكفر", "ایمان": "الإيمان", "عبادت": "العبادة", "نماز": "الصلاة", "علم": "العلم",
    "زندگی": "الحياة", "آسمان": "السماوات", "زمین": "الأرض", "دین": "الدين",
    "اختلاف": "اختلاف", "کرسی": "الكرسي",
}

# --------------------------------------------------------------------------
# Query classification (fixed values)
# --------------------------------------------------------------------------

QUERY_KEYWORDS = {
    "COMPARATIVE": [
        "compare", "comparison", "versus", "difference between", "differ",
        "قارن", "مقارنه", "الفرق بين", "بين", "موازنه", "فرق", "تقابل",
    ],
    "ASBAB_AL_NUZUL": [
        "occasion of revelation", "reason for revelation", "why was revealed",
        "asbab al nuzul", "sabab", "سبب النزول", "اسباب النزول", "نزلت في",
        "شان نزول", "سبب نزول",
    ],
    "QIRAAT": [
        "recitation", "qiraat", "qira'at", "variant reading", "readings",
        "قراءات", "القراءات", "قراءه", "الرسم", "قرات",
    ],
    "FIQH": [
        "ruling", "legal", "permissible", "forbidden", "obligation", "fiqh",
        "احكام", "حكم", "الفقه", "فقهي", "حلال", "حرام", "واجب", "مسيله", "شرعي",
    ],
    "AQEEDAH": [
        "creed", "belief", "theology", "attributes of god", "aqeedah",
        "العقيده", "عقيده", "الصفات", "التوحيد", "الايمان", "عقايد",
    ],
    "HADITH": [
        "hadith", "narration", "reported", "isnad", "chain",
        "حديث", "الحديث", "روايه", "اسناد", "روي",
    ],
    "LINGUISTIC": [
        "grammar", "syntax", "morphology", "irab", "i'rab", "rhetorical", "balagha",
        "linguistic", "اعراب", "نحو", "صرف", "البلاغه", "لغه", "لغوي", "قواعد", "گرامر",
    ],
    "WORD_MEANING": [
        "meaning of the word", "what does the word", "definition of",
        "معني كلمه", "معني لفظ", "دلاله", "لفظ كا مطلب", "معني",
    ],
    "HISTORICAL": [
        "develop", "development", "over time", "through history", "historically",
        "evolution", "chronological", "تطور", "عبر التاريخ", "تاريخيا", "تاريخ",
        "تاريخي", "ارتقا",
    ],
    "SCHOLARLY_DISAGREEMENT": [
        "disagree", "disagreement", "dispute", "controversy", "differing opinions",
        "اختلاف", "خلاف", "اراء مختلفه", "تنازع", "اختلافات",
    ],
    "MUFASSIR_BIOGRAPHY": [
        "who was", "biography", "born", "died", "life of", "when did he live",
        "من هو", "ترجمه", "سيره", "ولد", "توفي", "وفاته", "كون تهے", "سوانح",
    ],
    "THEMATIC": [
        "theme", "topic", "concept", "throughout the quran", "in the quran",
        "موضوع", "مفهوم", "في القران", "موضوعي",
    ],
    "SOURCE_SEARCH": [
        "which book", "what source", "find the passage", "where does",
        "اي كتاب", "المصدر", "اين ذكر",
    ],
}

#: Types tried in this order once the signal-driven decisions are past.
KEYWORD_PRIORITY = [
    "ASBAB_AL_NUZUL", "QIRAAT", "SCHOLARLY_DISAGREEMENT", "HISTORICAL", "FIQH", "AQEEDAH",
    "LINGUISTIC", "HADITH", "MUFASSIR_BIOGRAPHY", "WORD_MEANING", "SOURCE_SEARCH",
]

COMMENTARY_TERMS = [
    "tafsir", "tafseer", "commentary", "explain", "explanation", "interpret",
    "interpretation", "meaning", "say about", "تفسير", "معني", "شرح", "بيان", "تاويل",
    "مطلب", "وضاحت",
]

# --------------------------------------------------------------------------
# Rules and enum domains (fixed values)
# --------------------------------------------------------------------------

RULE_TIERS = [
    "SYSTEM_INTEGRITY", "SOURCE_PROVENANCE", "SCHOLARLY_METHOD", "QUERY_STRATEGY",
    "EVIDENCE_QUALITY", "RESPONSE_STRUCTURE", "LANGUAGE_GENERATION",
]

#: rule_key, tier, priority, query types (empty = all), effects
BASELINE_RULES = [
    ("integrity.no_unsourced_claim", "SYSTEM_INTEGRITY", 10, [], {"enforce": "citation_verification"}),
    ("integrity.insufficient_evidence_is_an_answer", "SYSTEM_INTEGRITY", 20, [],
     {"on_empty_evidence": "declare_insufficient"}),
    ("integrity.evidence_types_stay_distinct", "SYSTEM_INTEGRITY", 30, [], {"label_evidence_type": "true"}),
    ("provenance.published_only", "SOURCE_PROVENANCE", 10, [], {"source_view": "published_passage"}),
    ("provenance.citation_carries_edition", "SOURCE_PROVENANCE", 20, [],
     {"require_edition_in_citation": "true", "disclose_missing_page": "true"}),
    ("provenance.quotation_is_never_translated_silently", "SOURCE_PROVENANCE", 30, [],
     {"preserve_source_language": "true"}),
    ("strategy.independent_retrieval_per_work", "QUERY_STRATEGY", 10,
     ["AYAH_TAFSIR", "COMPARATIVE", "THEMATIC", "SCHOLARLY_DISAGREEMENT"],
     {"partition_by": "work", "per_work_cap": "3"}),
    ("strategy.hybrid_retrieval", "QUERY_STRATEGY", 20, [],
     {"strategies": '["structural", "sparse", "dense"]', "fusion": "rrf"}),
    ("strategy.comparative_isolates_each_source", "QUERY_STRATEGY", 30, ["COMPARATIVE"],
     {"isolate_named_works": "true"}),
    ("strategy.historical_orders_by_death_year", "QUERY_STRATEGY", 40, ["HISTORICAL"],
     {"order_by": "author_death_year_hijri", "unknown": "separate_group"}),
    ("evidence.rank_is_not_authority", "EVIDENCE_QUALITY", 10, [], {"forbid_score_as_authority": "true"}),
    ("evidence.surface_confidence_dimensions", "EVIDENCE_QUALITY", 20, [],
     {"report_dimensions": '["ocr_confidence", "verification_status", "citation_precision", "attribution_confidence"]'}),
    ("response.preserve_disagreement", "RESPONSE_STRUCTURE", 10, [],
     {"group_by_position": "true", "never_manufacture_consensus": "true"}),
    ("response.separate_quran_from_commentary", "RESPONSE_STRUCTURE", 20, [], {"separate_ayah_block": "true"}),
    ("language.arabic_pivot", "LANGUAGE_GENERATION", 10, [],
     {"pivot": "ar", "user_languages": '["ar", "en", "ur"]'}),
    ("language.translation_is_labelled", "LANGUAGE_GENERATION", 20, [], {"label_machine_translation": "true"}),
]

CORPUS_STATES = [
    "DISCOVERED", "ACQUIRED", "SCANNED", "OCR_COMPLETE", "NORMALIZED", "AYAH_ALIGNED",
    "METADATA_COMPLETE", "HUMAN_REVIEW", "VERIFIED", "INDEXED", "PUBLISHED",
]
VERIFICATION_STATES = [
    "FIXTURE", "UNVERIFIED", "MACHINE_PROPOSED", "IN_REVIEW", "DISPUTED", "VERIFIED",
]
LANGUAGES = ["ar", "en", "ur", "fa", "tr", "ms", "other"]
TRADITIONS_SUNNI = ["SUNNI", "SUNNI_SUFI", "SUNNI_SALAFI"]
COMMENTARY_METHODS = [
    "BI_AL_MATHUR", "BI_AL_RAY", "FIQHI", "BALAGHI", "SUFI_ISHARI", "KALAMI", "MIXED",
]

#: preset key, traditions (None = any), methods (None = any), default works only
PRESETS = [
    ("sunni-core", TRADITIONS_SUNNI, None, True),
    ("sunni-all", TRADITIONS_SUNNI, None, False),
    ("mathur", None, ["BI_AL_MATHUR"], False),
    ("fiqhi", None, ["FIQHI"], False),
    ("lughawi", None, ["LUGHAWI", "BALAGHI", "GHARIB"], False),
    ("qiraat", None, ["QIRAAT"], False),
    ("commentaries", None, COMMENTARY_METHODS, False),
    ("everything", None, None, False),
]
