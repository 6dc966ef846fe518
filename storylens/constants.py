"""Domain constants.

FIXED VALUES: every list below must equal the behaviour being reproduced
(dimension names, method names, label sets, pronoun lists, limits). They are
stated once here, in their natural order, and used everywhere else by name.
"""

# --- fixed values: analysis grid -------------------------------------------
DIMENSIONS = ["valence", "arousal", "dominance", "power", "appearance", "intellect"]
ATTR_METHODS = ["all", "sub", "comet"]
SCORE_METHODS = ["avg", "axis", "sim"]
# best score method per dimension, best attribute method
BEST_SM = {
    "valence": "axis",
    "arousal": "axis",
    "dominance": "axis",
    "power": "axis",
    "appearance": "sim",
    "intellect": "sim",
}
BEST_AM = "comet"
# dimension/method cells that are declared meaningless (blanked to null)
BLANK_DIMS_FOR_AXIS = ["appearance", "intellect"]

WRITERS = ["human", "gpt-3.5"]

# --- fixed values: point of view ---------------------------------------------
POV_RULE_LABELS = ["first_person", "second_person", "male", "female", "unknown"]
POV_LABELS = ["TP-M", "TP-F", "FP", "SP", "Other"]
POV_TABLE_LABELS = ["TP-M", "TP-F", "FP", "Other"]
# rule label -> analysis label (inferred mapping)
POV_LABEL_MAP = {
    "male": "TP-M",
    "female": "TP-F",
    "first_person": "FP",
    "second_person": "SP",
    "unknown": "Other",
}

# Pronoun lists of the POV rule, per variant. 'extended' includes reflexives
# and 'mine'; 'basic' does not.
POV_PRONOUNS = {
    "extended": {
        "male": ["He", "he", "him", "Him", "his", "His", "Himself", "himself"],
        "female": ["She", "she", "Her", "her", "herself", "Herself"],
        "first": ["I", "Me", "My", "Mine", "Myself", "me", "my", "i", "mine", "myself"],
        "second": ["You", "you", "Your", "your", "Yourself", "yourself"],
    },
    "basic": {
        "male": ["He", "he", "him", "Him", "his", "His"],
        "female": ["She", "she", "Her", "her"],
        "first": ["I", "Me", "My", "me", "my", "i"],
        "second": ["You", "you", "Your", "your"],
    },
}

# Pronouns that make a coreference cluster a character cluster.
CHARACTER_PRONOUNS = {
    "narrow": ["She", "she", "Her", "her", "He", "he", "him", "Him", "I", "Me", "me"],
    "wide": [
        "She", "she", "Her", "her", "herself", "Herself",
        "He", "he", "him", "Him", "his", "His", "Himself", "himself",
        "I", "Me", "My", "Mine", "Myself", "me", "my", "i", "mine", "myself",
        "You", "you", "Your", "your", "Yourself", "yourself",
    ],
}

# --- fixed values: text processing -------------------------------------------
PROTAGONIST_TOKENS = ["protagonistA", "ProtagonistA"]
PLACEHOLDER_PREFIX = "Protagonist"
WORD_LIMIT = 500
PROMPT_DELIMITER = " <endprompt> "
NEWLINE_MARKERS = ["<newline>", "< newline >"]
# ( or [, one whitespace, two letters, one whitespace, ) or ]
TAG_PATTERN = r"(\[|\()(\s[A-Za-z][A-Za-z]\s)(\]|\))"
# dependency labels that turn a placeholder into a possessive
POSSESSIVE_DEPS = ["poss", "case"]
# ASCII punctuation removed from inferred phrases
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
GENERATION_ROLE = (
    "You're writing a Reddit story and you want other reddit users to like and upvote your story."
)
GENERATION_INSTRUCTION = "Write a 400 words story for the following prompt: "

# --- fixed values: evaluation and sampling ----------------------------------
TEST_RATIO = 0.3
EVAL_TRIALS = 5
EVAL_SEED = 42
EVAL_METHODS = ["sim", "axis_with_con", "axis_no_con"]
SAMPLE_SIZE = 2
SAMPLE_TRIALS = 5
SPLIT_MIN_STORIES = 4
BOOTSTRAP_RESAMPLES = 1000
