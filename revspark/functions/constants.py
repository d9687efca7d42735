"""Fixed values.

Everything in this module is data that must keep exactly these values for the
results to be right. Lists are given in their natural order.
"""

# --- Fixed values: title aliases appended to the product-title dictionary ----
TITLE_ALIASES = [
    "dota", "wc3", "nwn", "eso", "ygo", "poe", "skyrim", "oblivion",
    "new vegas", "fallout", "fallout nv", "morrowind", "bf1", "bf2", "bf3",
    "bad company", "bfbc",
]

# --- Fixed values: review languages (canonical name, short code, native name) -
LANGUAGES = [
    ("all", "all", "All"),
    ("arabic", "ar", "العربية"),
    ("bulgarian", "bg", "български език"),
    ("schinese", "zh-CN", "简体中文"),
    ("tchinese", "zh-TW", "繁體中文"),
    ("czech", "cs", "čeština"),
    ("danish", "da", "Dansk"),
    ("dutch", "nl", "Nederlands"),
    ("english", "en", "English"),
    ("finnish", "fi", "Suomi"),
    ("french", "fr", "Français"),
    ("german", "de", "Deutsch"),
    ("greek", "el", "Ελληνικά"),
    ("hungarian", "hu", "Magyar"),
    ("italian", "it", "Italiano"),
    ("japanese", "ja", "日本語"),
    ("koreana", "ko", "한국어"),
    ("norwegian", "no", "Norsk"),
    ("polish", "pl", "Polski"),
    ("portuguese", "pt", "Português"),
    ("brazilian", "pt-BR", "Português-Brasil"),
    ("romanian", "ro", "Română"),
    ("russian", "ru", "Русский"),
    ("spanish", "es", "Español-España"),
    ("latam", "es-419", "Español-Latinoamérica"),
    ("swedish", "sv", "Svenska"),
    ("thai", "th", "ไทย"),
    ("turkish", "tr", "Türkçe"),
    ("ukrainian", "uk", "Українська"),
    ("vietnamese", "vi", "Tiếng Việt"),
]
# Extra spellings accepted when parsing a language (alias -> canonical name).
LANGUAGE_EXTRA_ALIASES = [("fl", "finnish"), ("el el", "greek"), ("vn", "vietnamese")]

# --- Fixed values: review score labels, ordinal 1..9 in this order -----------
SCORE_LABELS = [
    "Overwhelmingly Negative", "Very Negative", "Negative", "Mostly Negative", "Mixed",
    "Mostly Positive", "Positive", "Very Positive", "Overwhelmingly Positive",
]

# --- Fixed values: emoticons and masked words --------------------------------
# A run of four or more of the same symbol from this set is one masked word.
MASK_SYMBOLS = ["♥", "|", "*", "@", "$", "%"]
MASK_REPLACEMENT = "fuck"
SMILE_EMOTICONS = [":)", ":D", "=)", "=D", "☺", "☻"]
SMILE_WORD = "smile"
SAD_EMOTICONS = [":(", "=(", ":-("]
SAD_WORD = "sad"

# --- Fixed values: request limits --------------------------------------------
PAGE_SIZE_DEFAULT = 20
PAGE_SIZE_MAX = 100
MISSING_TITLE = "NA"

# --- Fixed values: Spark's default English stop-word list --------------------
# (pyspark.ml.feature.StopWordsRemover.loadDefaultStopWords("english"); kept here
# so oracle SQL can be written without a JVM. tests/test_functions.py checks the
# two stay equal.)
STOP_WORDS_EN = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours",
    "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself",
    "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by",
    "for", "with", "about", "against", "between", "into", "through", "during", "before",
    "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when", "where", "why",
    "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will",
    "just", "don", "should", "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll",
    "i'd", "you'd", "he'd", "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's",
    "it's", "we're", "they're", "i've", "we've", "you've", "they've", "isn't", "aren't",
    "wasn't", "weren't", "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't",
    "won't", "wouldn't", "shan't", "shouldn't", "mustn't", "can't", "couldn't", "cannot",
    "could", "here's", "how's", "let's", "ought", "that's", "there's", "what's", "when's",
    "where's", "who's", "why's", "would",
]

# Random seed used by every split, fold and sampled search.
SEED = 42
