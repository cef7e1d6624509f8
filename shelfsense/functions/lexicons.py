"""Lexicons and word lists.

FIXED VALUES — these must equal the reference's lists for identical
results.  They are plain data, stated in natural order; the logic that uses
them lives in the operators.
"""

from __future__ import annotations

# FIXED VALUES: harmful-ingredient lexicon, (keyword, display name, severity 1-10, reason).
HARMFUL_TERMS: list[tuple[str, str, int, str]] = [
    ("paraben", "Parabens", 7, "Endocrine disruptor; linked to hormonal imbalances"),
    ("methylparaben", "Methylparaben", 7, "Paraben-class preservative; endocrine disruptor"),
    ("propylparaben", "Propylparaben", 7, "Paraben-class preservative; endocrine disruptor"),
    ("butylparaben", "Butylparaben", 7, "Paraben-class preservative; endocrine disruptor"),
    ("sodium lauryl sulfate", "Sodium Lauryl Sulfate (SLS)", 5, "Skin irritant; strips natural oils"),
    ("sodium laureth sulfate", "Sodium Laureth Sulfate (SLES)", 6,
     "Potentially contaminated with carcinogen 1,4-dioxane"),
    ("sls", "SLS", 5, "Surfactant; skin and eye irritant"),
    ("sles", "SLES", 6, "Surfactant; possible carcinogen contamination"),
    ("oxybenzone", "Oxybenzone", 8, "Endocrine disruptor; coral reef bleaching agent"),
    ("phthalate", "Phthalates", 8, "Endocrine disruptor; reproductive toxicant"),
    ("diethyl phthalate", "Diethyl Phthalate", 8, "Phthalate plasticiser; reproductive toxicant"),
    ("formaldehyde", "Formaldehyde", 10, "Known human carcinogen (IARC Group 1)"),
    ("quaternium-15", "Quaternium-15", 9, "Formaldehyde releaser; carcinogen risk"),
    ("dmdm hydantoin", "DMDM Hydantoin", 9, "Formaldehyde releaser; carcinogen risk"),
    ("imidazolidinyl urea", "Imidazolidinyl Urea", 8, "Formaldehyde releaser"),
    ("peg", "PEGs (Polyethylene Glycols)", 5, "Potential contamination with carcinogenic 1,4-dioxane"),
    ("polyethylene glycol", "Polyethylene Glycol", 5, "PEG compound; potential carcinogen contamination"),
    ("petroleum", "Petroleum / Petrolatum", 5, "Risk of polycyclic aromatic hydrocarbon (PAH) contamination"),
    ("mineral oil", "Mineral Oil", 4, "Petroleum derivative; pore-clogging in high concentrations"),
    ("phenoxyethanol", "Phenoxyethanol", 4, "Potential skin sensitiser; toxic to immune system at high levels"),
    ("triclosan", "Triclosan", 8, "Antibiotic resistance; endocrine disruptor"),
    ("talc", "Talc", 6, "Possible asbestos contamination; lung irritant"),
    ("hydroquinone", "Hydroquinone", 7, "Skin bleaching agent; linked to ochronosis; restricted in EU"),
    ("coal tar", "Coal Tar", 9, "Known carcinogen; restricted in many countries"),
    ("lead", "Lead", 10, "Heavy metal; neurotoxicant"),
    ("mercury", "Mercury", 10, "Heavy metal; neurotoxicant and nephrotoxic"),
]

# FIXED VALUES: family grouping of the family scorer.
FAMILY_SUBSTRINGS = [("paraben", "paraben_family"), ("formaldeh", "formaldehyde_family")]
FAMILY_PREFIXES = [("peg-", "peg_family")]
FORMALDEHYDE_RELEASERS = ["dmdm hydantoin", "imidazolidinyl urea", "quaternium-15"]

# FIXED VALUES: 0-10 hit counter terms (safety_hits).
HIT_TERMS = ["parabens", "formaldehyde", "phthalates", "lead", "mercury", "triclosan", "oxybenzone",
             "coal tar", "bha", "bht", "petroleum", "sodium lauryl sulfate", "sls"]

# FIXED VALUES: stop words of the token cleaner.
STOPWORDS = ["i", "me", "my", "the", "a", "an", "and", "or", "but", "is", "was", "are", "were",
             "it", "its", "this", "that", "to", "of", "in", "on", "for", "with", "at", "by",
             "from", "as", "be", "been", "being", "have", "has", "had", "do", "does", "did",
             "will", "would", "could", "should", "may", "might", "not", "no", "so", "we", "they",
             "he", "she", "you", "your", "our", "their", "his", "her", "if", "then", "there",
             "when", "where", "which", "who", "what", "how", "all", "just", "also", "very"]

# FIXED VALUES: skin-term vote classes, in class order (ties -> first class).
SKIN_VOTE_CLASSES = [
    ("oily", ["oily", "shine", "sebum", "grease", "pore", "pores"]),
    ("dry", ["dry", "flaky", "tight", "rough", "dehydrated"]),
    ("sensitive", ["sensitive", "irritation", "redness", "allergy", "sting"]),
]

# FIXED VALUES: keyword boosts of the hybrid skin detector, in class order.
SKIN_BOOST_CLASSES = [
    ("oily", ["oily", "greasy", "shine", "sebum", "clogged"]),
    ("dry", ["dry", "flaky", "tight", "dehydrated", "rough"]),
    ("sensitive", ["sensitive", "red", "sting", "irritat", "itch"]),
    ("acne", ["acne", "pimple", "breakout", "blemish", "spot"]),
]

# FIXED VALUES: strong sentiment terms (+0.4 / -0.4 each).
STRONG_POSITIVE = ["love", "amazing", "best", "perfect", "favorite", "holy grail"]
STRONG_NEGATIVE = ["worst", "terrible", "waste", "breakout", "horrible", "avoid"]

# FIXED VALUES: ordered product-category rules of the forecast service
# (first rule whose any keyword is contained wins; default "default").
CATEGORY_RULES = [
    ("sunscreen", ["spf", "sunscreen", "sun protection", "solar", "uv"]),
    ("serum", ["serum", "ampoule", "concentrate", "shot", "booster"]),
    ("eye", ["eye cream", "eye gel", "eye serum", "under eye"]),
    ("lip", ["lip balm", "lip butter", "lip serum", "lip mask"]),
    ("cleanser", ["cleanser", "face wash", "foaming wash", "micellar", "scrub", "exfoliant", "cleansing"]),
    ("mask", ["mask", "masque", "clay", "sheet mask", "mud"]),
    ("oil", ["face oil", "facial oil", "rosehip", "beauty oil", "argan", "jojoba oil"]),
    ("toner", ["toner", "tonic", "mist", "essence", "clarifying"]),
    ("cream", ["cream", "moisturizer", "moisturiser", "lotion", "balm", "butter", "emulsion", "overnight"]),
]

# FIXED VALUES: season of month.
SEASONS = [("winter", [12, 1, 2]), ("spring", [3, 4, 5]), ("rainy", [6, 7, 8, 9]), ("autumn", [10, 11])]

# FIXED VALUES: missing-value sentinels.
NULL_SENTINELS = ["", "nan", "none", "null", "na", "n/a", "-"]

# Own small valence lexicon for the compound sentiment score (valence -4..4).
VALENCE = [
    ("love", 3.2), ("amazing", 2.8), ("great", 3.1), ("good", 1.9), ("nice", 1.8), ("best", 3.2),
    ("perfect", 2.7), ("happy", 2.7), ("excellent", 2.7), ("recommend", 1.5), ("soft", 1.0),
    ("smooth", 1.2), ("gentle", 1.0), ("fresh", 1.2), ("favorite", 2.0), ("glow", 1.5),
    ("pretty", 1.6), ("well", 1.1), ("like", 1.5), ("clean", 1.7),
    ("bad", -2.5), ("worst", -3.1), ("terrible", -2.1), ("horrible", -2.5), ("awful", -2.0),
    ("hate", -2.7), ("waste", -1.8), ("disappointed", -1.9), ("disappointing", -2.2),
    ("poor", -2.1), ("broke", -1.6), ("breakout", -1.5), ("irritation", -1.6), ("rash", -1.5),
    ("burn", -1.6), ("sticky", -0.9), ("greasy", -1.0), ("avoid", -1.2), ("not", -0.5),
    ("problem", -1.7), ("error", -1.4), ("fail", -2.3),
]

# Test binding only: terms that occur in the driver's generated prose, so that
# the lexicon operators have matches to score (severity 1-10).
PROSE_TERMS: list[tuple[str, str, int, str]] = [
    ("license", "License line", 8, "license text in an ingredient field"),
    ("apache", "Apache", 6, "license name"),
    ("token", "Token", 5, "secret-like token"),
    ("mit", "MIT", 4, "license name"),
    ("peg-", "PEG-", 6, "prefix family test"),
    ("eaux", "Eaux", 5, "frequent fragment"),
    ("ndre", "Ndre", 7, "frequent fragment"),
    ("thr", "Thr", 3, "frequent fragment"),
]


def test_lexicon() -> list[tuple[str, str, int, str]]:
    """Reference lexicon followed by the prose terms (order is the tie order)."""
    return HARMFUL_TERMS + PROSE_TERMS
