"""Names, line wordings and patterns that results depend on.

Everything here is data. Nothing in this module may change without changing
results.
"""

# Special vocabulary entries and their ids; words start at 3.
PAD, UNK, MASK = "<pad>", "<unk>", "<mask>"
PAD_ID, UNK_ID, MASK_ID, FIRST_WORD_ID = 0, 1, 2, 3

# Separators.
KEYWORD_SEPARATOR = " | "
PAIR_SEPARATOR = " @separator@ "

# Class names of the four-way news corpus, by label.
NEWS_CLASSES = ["World", "Sports", "Business", "SciTech"]

# Topic names of the ten-way answer corpus, by topic id.
ANSWER_TOPICS = [
    "society", "science", "health", "education", "computer",
    "sports", "business", "entertainment", "family", "politics",
]

# Configurations of the multi-task benchmark.
BENCHMARK_CONFIGS = [
    "cola", "sst2", "mrpc", "qqp", "stsb", "mnli",
    "mnli_mismatched", "mnli_matched", "qnli", "rte", "wnli", "ax",
]

# Per task, stored split name -> exported split name.
SPLIT_NAMES = {
    "mrpc": {"train": "train", "validation": "val", "test": "test"},
    "news-summary": {"train": "train", "test": "test"},
    "wiki80": {"train": "train", "val": "val", "test": "test"},
    "yahoo_answers_topics": {"train": "train", "val": "dev", "test": "test"},
    "rotten_tomatoes": {"train": "train", "validation": "val", "test": "test"},
    "imdb": {"train": "train", "val": "val", "test": "test"},
    "yelp_polarity": {"train": "train", "val": "val", "test": "test"},
}

# Line patterns, {} filled left to right.
LINE_PATTERNS = {
    "nli_prompt_0": "{} Is it true that {} ?",
    "nli_prompt_1": "{} @separater@ {}",
    "text2rel_source_prompt_0": "{} <mask> is <mask> of <mask>",
    "text2rel_target_prompt_0": "{} is {} of {}",
}

# Outer characters dropped when a line is cleaned
# (tab..carriage return, file..unit separators, space, NEL, Unicode spaces).
LINE_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Penn Treebank word splitting (Marcus et al. 1993) as ordered
# (when, pattern, replacement) steps on text padded by a blank at both ends. Only
# constructs shared by Java and RE2 are used (no look-around); blanks are
# doubled first so that neighbouring matches never share one. A step other than
# "always" can only match in a text with a quote mark or with a fused word.
WORD_STEPS = [
    # any white space -> two blanks
    ("always", r"[\t-\r\x1c-\x20\x{85}\p{Z}]+", "  "),
    # double quotes that open a quotation
    ("quote", r"""([ (\[{<])(?:"|'')""", "$1 `` "),
    # symbols, brackets, typographic quotes, ellipses and dashes stand alone
    ("always", r"([;@#$%&?!*\[\](){}<>«»“”‘’„]|\.\.+|--|`+)", " $1 "),
    # all other double quotes close a quotation
    ("quote", r"""(?:"|'')""", " '' "),
    # a period ending a sentence
    ("always", r"([^.])\.( |' )", "$1 . $2"),
    # colon and comma, except before a digit
    ("always", r"([:,])([^\p{Nd}])", " $1 $2"),
    # a closing single quote
    ("quote", r"([^'])' ", "$1 ' "),
    # an opening single quote before a one-character word
    ("quote", r"'([A-CE-LO-RU-Za-ce-lo-ru-z0-9_])([^\p{L}\p{N}_])", "' $1$2"),
    # clitics
    ("quote", r"([^' ])('[sSmMdD]) ", "$1 $2 "),
    ("quote", r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
    # fused words
    ("fused", r"(?i)([^\p{L}\p{N}_])(?:(can)(not)|(gim|lem)(me)|(gon|wan)(na))([^\p{L}\p{N}_])",
     "$1 $2$4$6 $3$5$7 $8"),
    ("fused", r"(?i)([^\p{L}\p{N}_])(?:(got)(ta)|(d)('ye)|(more)('n))([^\p{L}\p{N}_])",
     "$1 $2$4$6 $3$5$7 $8"),
    ("fused", r"(?i)([^\p{L}\p{N}_])('t)(is|was)([^\p{L}\p{N}_])", "$1 $2 $3 $4"),
]
QUOTE_MARKS = ["'", '"']
FUSED_WORDS = [
    "cannot", "gimme", "lemme", "gonna", "wanna", "gotta", "d'ye", "more'n", "'tis", "'twas",
]

# A term for the TF-IDF features is a run of 2+ word characters.
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"

# The English stop words that Spark ML ships (Spark's own order).
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his
himself she her hers herself it its itself they them their theirs themselves what which
who whom this that these those am is are was were be been being have has had having do
does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on
off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will
just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't
wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't
shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's
what's when's where's who's why's would
""".split()
