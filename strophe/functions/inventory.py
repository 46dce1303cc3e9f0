"""Symbol inventories and lookup tables.

Fixed values: these must equal the published ones for results to agree.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELETE = "<DEL>"

# The 39 phone symbols; id 0 is the frame blank, ids 1..39 are these.
PHONES = (
    "AA", "AE", "AH", "AO", "AW", "AY", "B", "CH", "D", "DH", "EH", "ER", "EY", "F", "G", "HH", "IH", "IY", "JH", "K",
    "L", "M", "N", "NG", "OW", "OY", "P", "R", "S", "SH", "T", "TH", "UH", "UW", "V", "W", "Y", "Z", "ZH",
)
# Intermediate symbols folded into the 39, and the vowels.
PROJECTION = {"AX": "AH", "DX": "T"}
VOWELS = ("AA", "AE", "AH", "AO", "AW", "AX", "AY", "EH", "ER", "EY", "IH", "IY", "OW", "OY", "UH", "UW")

# Labels that are not speech, and allophones of annotated labels.
DROPPED_LABELS = (
    "h#", "pau", "sil", "sp", "spn", "epi", "q", "noi", "noise",
    "bcl", "dcl", "gcl", "kcl", "pcl", "tcl", "vcl", "eng-cl", "xx", "**", "#", "@",
)
ALLOPHONES = {
    "ax-h": "AX", "axr": "ER", "ix": "IH", "ux": "UW", "el": "L", "em": "M", "en": "N", "eng": "NG", "nx": "N", "hv": "HH",
}
# A closure label and the release that must follow it.
CLOSURE_RELEASE = {"bcl": "b", "dcl": "d", "gcl": "g", "kcl": "k", "pcl": "p", "tcl": "t"}
OTHER_CLOSURES = ("vcl", "eng-cl")

# Texts that count as noise, and image suffixes.
NOISE_TEXTS = ("", "xxx", "noise", "silence")
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png")

# Vowel descriptors (height, backness, rounding).
VOWEL_FEATURES = {
    "IY": (1.00, 0.00, 0), "IH": (0.85, 0.10, 0), "EY": (0.70, 0.00, 0), "EH": (0.50, 0.00, 0), "AE": (0.15, 0.10, 0),
    "AA": (0.00, 1.00, 0), "AH": (0.40, 0.60, 0), "ER": (0.50, 0.50, 0), "AO": (0.30, 1.00, 1), "OW": (0.60, 1.00, 1),
    "UH": (0.85, 0.85, 1), "UW": (1.00, 1.00, 1), "AY": (0.10, 0.40, 0), "AW": (0.10, 0.60, 0), "OY": (0.40, 1.00, 1),
}
# Consonant descriptors (place, manner, voiced) and the order of places.
CONSONANT_FEATURES = {
    "B": ("bilabial", "stop", 1), "P": ("bilabial", "stop", 0), "M": ("bilabial", "nasal", 1), "W": ("bilabial", "glide", 1),
    "F": ("labiodental", "fricative", 0), "V": ("labiodental", "fricative", 1),
    "TH": ("dental", "fricative", 0), "DH": ("dental", "fricative", 1),
    "T": ("alveolar", "stop", 0), "D": ("alveolar", "stop", 1), "S": ("alveolar", "fricative", 0),
    "Z": ("alveolar", "fricative", 1), "N": ("alveolar", "nasal", 1), "L": ("alveolar", "liquid", 1),
    "SH": ("postalveolar", "fricative", 0), "ZH": ("postalveolar", "fricative", 1),
    "CH": ("postalveolar", "affricate", 0), "JH": ("postalveolar", "affricate", 1),
    "R": ("postalveolar", "liquid", 1), "Y": ("palatal", "glide", 1),
    "K": ("velar", "stop", 0), "G": ("velar", "stop", 1), "NG": ("velar", "nasal", 1), "HH": ("glottal", "fricative", 0),
}
PLACES = ("bilabial", "labiodental", "dental", "alveolar", "postalveolar", "palatal", "velar", "glottal")

# Phonetic alphabet symbols and the phone (or phones) they stand for.
IPA_SYMBOLS = {
    "ɑ": "AA", "ɑː": "AA", "ɒ": "AA", "æ": "AE", "ʌ": "AH", "ɐ": "AH", "ɔ": "AO", "ɔː": "AO", "aʊ": "AW", "ə": "AX",
    "ɚ": "ER", "ɝ": "ER", "ɜ": "ER", "ɜː": "ER", "aɪ": "AY", "ɛ": "EH", "e": "EH", "eɪ": "EY", "ɪ": "IH", "ᵻ": "IH",
    "i": "IY", "iː": "IY", "oʊ": "OW", "əʊ": "OW", "ɔɪ": "OY", "ʊ": "UH", "u": "UW", "uː": "UW", "b": "B", "tʃ": "CH",
    "d": "D", "ð": "DH", "ɾ": "DX", "f": "F", "g": "G", "ɡ": "G", "h": "HH", "dʒ": "JH", "k": "K", "l": "L", "ɫ": "L",
    "m": "M", "n": "N", "ŋ": "NG", "p": "P", "r": "R", "ɹ": "R", "s": "S", "ʃ": "SH", "t": "T", "θ": "TH", "v": "V",
    "w": "W", "j": "Y", "z": "Z", "ʒ": "ZH",
}
IPA_SEQUENCES = {
    "ɔːɹ": ("AO", "R"), "ɛɹ": ("EH", "R"), "əl": ("AX", "L"), "ʊɹ": ("UH", "R"), "ɑːɹ": ("AA", "R"), "ɪɹ": ("IH", "R"),
    "aɪɚ": ("AY", "ER"), "iə": ("IY", "AX"), "aɪə": ("AY", "AX"), "ʔ": ("T",),
}
# Combining marks and stress marks that are ignored.
IPA_IGNORED = ("̩", "̯", "̥", "̬", "ʰ", "ˈ", "ˌ")

# Directed confusions between phonetic symbols.
IPA_CONFUSIONS = {
    "p": ("b", "m"), "b": ("p", "m"), "t": ("d", "ɾ", "n"), "d": ("t", "ɾ", "n"), "k": ("g", "ŋ"), "g": ("k", "ŋ"),
    "ʔ": (), "f": ("v",), "v": ("f",), "θ": ("ð", "f"), "ð": ("θ", "v", "d"), "s": ("z", "ʃ"), "z": ("s", "ʒ"),
    "ʃ": ("ʒ", "tʃ", "s"), "ʒ": ("ʃ", "dʒ"), "tʃ": ("ʃ", "dʒ"), "dʒ": ("ʒ", "tʃ"), "m": ("n", "p", "b"),
    "n": ("m", "ŋ", "ɾ"), "ŋ": ("n", "k", "g"), "ɹ": ("l", "w"), "l": ("ɹ", "ɫ"), "ɫ": ("o", "ʊ"), "j": ("dʒ",),
    "w": ("v",), "i": ("ɪ", "iː"), "ɪ": ("i", "e"), "e": ("ɛ", "ɪ"), "ɛ": ("æ", "e"), "æ": ("ɑ", "ɛ"), "ɑ": ("ɔ", "ʌ"),
    "ɔ": ("ɑ", "o"), "o": ("ɔ", "ʊ"), "u": ("ʊ", "o"), "ʊ": ("u", "o"), "ʌ": ("ə", "ɜ"), "ə": ("ʌ", "ɜ", "ɚ"),
    "ɜ": ("ə", "ɚ"), "ɚ": ("ɜ", "ə"), "aɪ": ("ɑ", "e"), "aʊ": ("æ", "ʌ"), "ɔɪ": ("ɔ", "ɪ"), "oʊ": ("o", "ʊ"),
    "ɾ": ("t", "d"), "n̩": ("n", "ən"),
}
# Two symbols the confusion table projects in its own way.
IPA_CONFUSION_ALIASES = {"o": "OW", "n̩": "N"}

# The short candidate list of each phone with its weights.
SHORT_LIST = {
    "P": {"B": 1.0, "F": 0.7, "M": 0.45}, "B": {"P": 1.0, "V": 0.7, "M": 0.45},
    "T": {"D": 1.0, "S": 0.7, "N": 0.45, "K": 0.35}, "D": {"T": 1.0, "Z": 0.7, "N": 0.45, "G": 0.35},
    "K": {"G": 1.0, "T": 0.5}, "G": {"K": 1.0, "D": 0.5},
    "CH": {"JH": 1.0, "SH": 0.8, "T": 0.5}, "JH": {"CH": 1.0, "ZH": 0.8, "D": 0.5},
    "F": {"V": 1.0, "TH": 0.7, "P": 0.5}, "V": {"F": 1.0, "DH": 0.7, "B": 0.5},
    "TH": {"DH": 1.0, "F": 0.7, "S": 0.5}, "DH": {"TH": 1.0, "V": 0.7, "Z": 0.5},
    "S": {"Z": 1.0, "SH": 0.7, "TH": 0.55, "T": 0.45}, "Z": {"S": 1.0, "ZH": 0.7, "D": 0.45},
    "SH": {"ZH": 1.0, "S": 0.7, "CH": 0.45}, "ZH": {"SH": 1.0, "Z": 0.7, "JH": 0.45},
    "HH": {"F": 0.45, "TH": 0.45}, "M": {"N": 0.8, "B": 0.5}, "N": {"M": 0.7, "NG": 0.7, "D": 0.45},
    "NG": {"N": 0.8, "G": 0.45}, "L": {"R": 1.0, "W": 0.55}, "R": {"L": 1.0, "W": 0.55, "ER": 0.45},
    "W": {"R": 0.7, "UW": 0.55}, "Y": {"IY": 0.55},
    "AA": {"AH": 1.0, "AO": 0.65}, "AE": {"EH": 1.0, "AH": 0.85}, "AH": {"AA": 0.75, "AE": 0.75, "IH": 0.75, "ER": 0.55},
    "AO": {"AA": 0.75, "OW": 0.65}, "AW": {"AA": 0.55, "OW": 0.55}, "AY": {"AA": 0.55, "EY": 0.55},
    "EH": {"AE": 1.0, "IH": 0.75, "AH": 0.55}, "ER": {"R": 0.65, "AH": 0.65}, "EY": {"EH": 0.75, "IH": 0.55},
    "IH": {"IY": 0.85, "EH": 0.75, "AH": 0.65}, "IY": {"IH": 1.0, "Y": 0.55}, "OW": {"AO": 0.75, "UH": 0.55},
    "OY": {"AO": 0.55, "IY": 0.45}, "UH": {"UW": 0.85, "AH": 0.65}, "UW": {"UH": 1.0, "W": 0.55},
}

# The vowel pair accepted as a variant, and words never given variants.
WEAK_PAIRS = (("AH0", "IH0"),)
HOMOGRAPHS = (
    "bass", "bow", "close", "content", "contract", "convert", "convict", "desert", "does", "dove", "entrance", "excuse",
    "export", "import", "incense", "invalid", "lead", "live", "minute", "object", "permit", "polish", "present",
    "produce", "progress", "project", "read", "rebel", "record", "refuse", "reject", "resume", "separate", "sow",
    "subject", "suspect", "tear", "use", "wind", "wound",
)


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def literal_map(mapping: Mapping) -> Column:
    """A small fixed mapping as a map column (tuples become arrays)."""
    cells = []
    for k, v in mapping.items():
        cells += [F.lit(k), strings(v) if isinstance(v, (tuple, list)) else F.lit(v)]
    return F.create_map(*cells)


def phone_name(index: Column) -> Column:
    """Name of phone id 1..39."""
    return F.element_at(strings(PHONES), index.cast("int"))



def phone_table(spark: SparkSession) -> DataFrame:
    """One row per phone with its descriptors; 39 rows, safe to broadcast."""
    rows = []
    for i, p in enumerate(PHONES, 1):
        if p in VOWEL_FEATURES:
            h, b, r = VOWEL_FEATURES[p]
            rows.append((i, p, True, h, b, r, None, None, None, None))
        else:
            place, manner, voice = CONSONANT_FEATURES[p]
            rows.append((i, p, False, None, None, None, place, PLACES.index(place), manner, voice))
    return spark.createDataFrame(
        rows, "id int, phone string, vowel boolean, height double, backness double, rounding int, "
              "place string, place_rank int, manner string, voiced int")
