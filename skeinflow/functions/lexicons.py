"""Word lists and patterns of the Hebrew defaults. All are fixed values; every function takes others as arguments."""

# Fixed values.
SLANG = [
    "צו 8", 'חמ"ל', "שמירה", "קו", "עמדה", "צוות", "פלוגה", "מילואים", "סדיר", "ווסט",
    'נגמ"ש', "מדים", "בסיס", "מפקד", "קשר", "אימון", "שטח", "סבב", "כוננות", "משימה",
    "חוליה", "גדוד", "מחלקה", "נקודת מפגש",
]
FORBIDDEN = ["PTSD", "פוסט טראומה", "אבחון", "הפרעה", "diagnosis", "disorder", "post trauma", "psychiatric"]
META_TEXT = ["(תרגום", "(translation", "(כתובה", "ניסיוני לשמור", "שכתוב:", "פלט עברית", "־"]
META_PHRASES = ["translation:", "תרגום:", "here is", "here's the", "english:", "output:", "note:", "explanation:", "i have written", "```", "sure!", "certainly!", "of course!", "here you go"]
ARCHAIC = ["אינני", "אינו", "הנני"]
ARCHAIC_IN_POLISH = ["אינני", "אינו", "הנני", "הנה כי כן", "אמנם כי"]
DANGLING = ["בתוך", "מתוך", "בתוך-", "לתוך"]
SUBJECT_NOUNS = ["השינה", "הלילות", "החלומות", "הזיכרונות", "המחשבות", "הקולות", "האשמה", "הגוף", "התחושות", "התגובות", "הרגשות"]
INTERROGATIVES = ["למה", "איך", "מה", "איפה", "מתי"]
DEFINITE_PREFIX, DEFINITE_SUFFIXES = "ה", ["ים", "ות", "ה", "ן"]
BROKEN_SYNTAX = ["אני ה[א-ת]{2,}", "אני (?:למה|איך|מה|איפה|מתי)", "מאז.{0,40}—[%s]*מאז", "(?:בערך|וואלה|כרגיל)[.%s]*$"]
LETTERS, BLOCK, LATIN, VOWEL_POINTS = "[א-ת]", "[֐-׿]", "[A-Za-z]", "[ְ-ׇ]"
LABEL_SETS = [
    ["sleep_disturbance"], ["hypervigilance"], ["avoidance"], ["anger_irritability"], ["intrusive_memories"], ["emotional_numbing"], ["functional_impairment"], ["guilt_shame"],
    ["sleep_disturbance", "hypervigilance"], ["sleep_disturbance", "intrusive_memories"], ["anger_irritability", "guilt_shame"], ["avoidance", "emotional_numbing"],
    ["hypervigilance", "avoidance"], ["functional_impairment", "emotional_numbing"], ["sleep_disturbance", "anger_irritability"], ["guilt_shame", "intrusive_memories"],
    ["sleep_disturbance", "hypervigilance", "avoidance"], ["anger_irritability", "functional_impairment", "guilt_shame"],
]
LABEL_SET_WEIGHTS = [5, 5, 4, 4, 2, 2, 2, 1, 4, 2, 2, 2, 2, 1, 1, 1, 1, 1]
PLATFORMS = ["whatsapp", "reddit", "tweet", "diary"]
SEVERITIES = ["mild", "medium", "strong"]
#: Dimension of the rubric, and the code that a low or missing score gives, in order.
RUBRIC = {"naturalness": "LOW_NATURALNESS", "idiomaticity": "TRANSLATIONESE", "register_fit": "UNNATURAL_ROBOTIC", "label_grounding": "LABEL_MISMATCH", "coherence": "INCOHERENT"}
