"""Fixed values that results depend on.

Everything in this module is a plain list of literal values that must stay
equal to the behaviour being reproduced; nothing here is computed.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES
# ---------------------------------------------------------------------------

# The 32 ASCII punctuation marks (Python's ``string.punctuation``), in order.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# The ten ASCII digits.
DIGITS = "0123456789"

# Default English stop-word list (the widely published 174-word English list
# distributed with the ``stop-words`` package).
EN_STOP_WORDS = [
    "a", "about", "above", "after", "again", "against", "all", "am", "an",
    "and", "any", "are", "aren't", "as", "at", "be", "because", "been",
    "before", "being", "below", "between", "both", "but", "by", "can't",
    "cannot", "could", "couldn't", "did", "didn't", "do", "does", "doesn't",
    "doing", "don't", "down", "during", "each", "few", "for", "from",
    "further", "had", "hadn't", "has", "hasn't", "have", "haven't", "having",
    "he", "he'd", "he'll", "he's", "her", "here", "here's", "hers", "herself",
    "him", "himself", "his", "how", "how's", "i", "i'd", "i'll", "i'm",
    "i've", "if", "in", "into", "is", "isn't", "it", "it's", "its", "itself",
    "let's", "me", "more", "most", "mustn't", "my", "myself", "no", "nor",
    "not", "of", "off", "on", "once", "only", "or", "other", "ought", "our",
    "ours", "ourselves", "out", "over", "own", "same", "shan't", "she",
    "she'd", "she'll", "she's", "should", "shouldn't", "so", "some", "such",
    "than", "that", "that's", "the", "their", "theirs", "them", "themselves",
    "then", "there", "there's", "these", "they", "they'd", "they'll",
    "they're", "they've", "this", "those", "through", "to", "too", "under",
    "until", "up", "very", "was", "wasn't", "we", "we'd", "we'll", "we're",
    "we've", "were", "weren't", "what", "what's", "when", "when's", "where",
    "where's", "which", "while", "who", "who's", "whom", "why", "why's",
    "with", "won't", "would", "wouldn't", "you", "you'd", "you'll", "you're",
    "you've", "your", "yours", "yourself", "yourselves",
]

# Words the shipped configuration adds to the stop list.
CONFIG_EXCLUDE_WORDS = ["excludeme", "andme"]

# File extensions the shipped configuration excludes (case-sensitive).
CONFIG_EXCLUDE_FORMATS = [".jpg", ".JPG", ".mp3", ".wav"]

# File-name suffixes accepted for text extraction (the accepted set; the
# original also misses plain ".HTM", which is accepted here as well).
EXTRACTABLE_SUFFIXES = [
    ".txt", ".TXT", ".pdf", ".PDF", ".xml", ".XML", ".doc", ".DOC",
    ".htm", ".HTM;1", ".HTM", ".html", ".HTML", ".jpg", ".JPG",
]

# Suffixes handled by the HTML/XML-to-text extractor.
MARKUP_SUFFIXES = [".htm", ".html", ".HTML", ".xml", ".XML", ".HTM;1", ".HTM"]

# Seventeen-item stop list of the rare-word trim on line documents.
RARE_TRIM_STOP_WORDS = [
    "a", "an", "the", "of", "to", "for", "as", "from", "is", "was", "were",
    "are", ",", "-", "|", "@", ".",
]

# Sector size used to turn a partition start sector into a byte offset.
SECTOR_BYTES = 512

# Minimum doc-topic probability kept in doc-topic results.
MIN_TOPIC_PROBABILITY = 0.01

# Near-zero TF-IDF weights at or below this are dropped.
TFIDF_EPS = 1e-12

# Topic-summary defaults: terms shown per view and relevance lambda step.
SUMMARY_TERMS = 30
RELEVANCE_STEPS = 100

# Default number of topics and iterations of the line-document model.
DEFAULT_TOPICS = 10
DEFAULT_LINE_ITERATIONS = 200
