"""Fixed values of the speech-assessment domain."""

# The 39 stress-free phones and their display symbols.
PHONE_SYMBOLS = {
    "AA": "a", "AE": "ae", "AH": "ah", "AO": "o", "AW": "aʊ", "AY": "aɪ", "B": "b", "CH": "tʃ", "D": "d", "DH": "ð",
    "EH": "e", "ER": "ɝ", "EY": "eɪ", "F": "f", "G": "g", "HH": "h", "IH": "ɪ", "IY": "i", "JH": "dʒ", "K": "k",
    "L": "l", "M": "m", "N": "n", "NG": "ŋ", "OW": "oʊ", "OY": "ɔɪ", "P": "p", "R": "ɹ", "S": "s", "SH": "ʃ",
    "T": "t", "TH": "θ", "UH": "ʊ", "UW": "u", "V": "v", "W": "w", "Y": "j", "Z": "z", "ZH": "ʒ",
}
PHONES = sorted(PHONE_SYMBOLS)

# Relative durations of phone classes; every other phone weighs 1.0.
VOWELS = ("AA", "AE", "AH", "AO", "AW", "AY", "EH", "ER", "EY", "IH", "IY", "OW", "OY", "UH", "UW")
DURATION_WEIGHTS = {
    1.8: VOWELS,
    1.35: ("DH", "F", "S", "SH", "TH", "V", "Z", "ZH", "HH"),
    1.25: ("CH", "JH"),
    0.85: ("B", "D", "G", "K", "P", "T"),
    1.1: ("M", "N", "NG"),
}

# Pronunciation classes in index order, their target scores and human scores.
CLASSES = ("wrong_or_missed", "accented", "correct")
CLASS_TARGETS = (15.0, 60.0, 92.0)
CLASS_HUMAN = (0.0, 1.0, 2.0)
# Fixed values: (accented from, correct from) of a target score, by version of the report.
THRESHOLDS = {"v1": (34.25, 72.75), "v2": (37.5, 76.0)}
# Confidence of an alignment by its source.
ALIGNMENT_CONFIDENCE = {"manual": 0.98, "mfa": 0.92}
OTHER_CONFIDENCE = 0.85
SILENCE_LABELS = ("", "sp", "sil", "spn", "<eps>")
OMITTED_PHONES = ("", "<unk>", "unk", "\\")
ENCODER_WIDTH, ACOUSTIC_WIDTH = 768, 771
