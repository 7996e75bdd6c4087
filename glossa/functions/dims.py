"""Fixed tables of the linguistic layers, and small DataFrames made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters of each phonetic class in the order of their places.
PHONETIC = {0: "aeiou", 1: "bdgkpt", 2: "fhsvxz", 3: "mn", 4: "lr", 5: "cjqwy"}
# Signs that follow the letters of class 5, one place each; $ keeps its marker's place.
PUNCTUATION = ",;:!?-'\"()[]{}/\\@#$%&*+=<>~|`_"
DIGITS = "0123456789"
# Word start, word end and full stop.
MARKERS = {"^": (6, 0), "$": (6, 1), ".": (6, 3)}
UNKNOWN = (6, 4)


def coordinates(separator: tuple[int, int] | None = None) -> dict[str, tuple[int, int]]:
    """Character -> (class, place). separator: another place for _, as in older published figures: (6, 2)."""
    out = {c: (k, i) for k, row in PHONETIC.items() for i, c in enumerate(row)} | MARKERS
    start = len(PHONETIC[5])
    out |= {c: (5, start + i) for i, c in enumerate(PUNCTUATION) if c not in out}
    out |= {c: (5, start + len(PUNCTUATION) + i) for i, c in enumerate(DIGITS)}
    return out | ({"_": separator} if separator else {})


# Morph codes in the order of their numbers.
MORPH_CODES = "BASE PLURAL PAST_TENSE PRESENT_PART PAST_PART THIRD_SING COMPARATIVE SUPERLATIVE ADVERBIAL NEGATION AGENT NOMINALIZE IRREGULAR".split()
# Root and irregular past.
IRREGULAR = {
    "be": "was", "begin": "began", "break": "broke", "come": "came", "do": "did", "drive": "drove",
    "eat": "ate", "get": "got", "give": "gave", "go": "went", "have": "had", "leave": "left",
    "make": "made", "run": "ran", "say": "said", "swim": "swam", "see": "saw", "sit": "sat",
    "speak": "spoke", "take": "took", "write": "wrote",
}
# Words that are their own root and stay as they are.
IDENTITY = (
    "are were been me him her us them my his its our their your myself himself herself itself ourselves themselves yourself yourselves "
    "most best worst least more better worse less further furthest many much"
).split()
# Irregular comparatives and superlatives.
COMPARATIVES = {"good": "better", "well": "better", "bad": "worse", "far": "further", "little": "less", "many": "more", "much": "more"}
SUPERLATIVES = {"good": "best", "well": "best", "bad": "worst", "far": "furthest", "little": "least", "many": "most", "much": "most"}

# Discourse connectives by relation.
CONNECTIVES = {
    "CAUSE": ["because", "since", "due to"],
    "CONTRAST": ["but", "however", "though", "although", "yet", "whereas", "while", "nevertheless", "nonetheless"],
    "SEQUENCE": ["then", "next", "after", "before", "subsequently", "finally", "first", "second", "lastly"],
    "ELABORATION": ["for example", "for instance", "in particular", "such as", "namely", "specifically"],
    "ADDITION": ["also", "furthermore", "moreover", "additionally", "besides"],
    "CONDITION": ["if", "unless", "provided"],
    "CONCLUSION": ["therefore", "thus", "hence", "consequently", "as a result", "so"],
}
# Terms of boilerplate, and pronouns.
BOILERPLATE = "gutenberg ebook project tm trademark foundation license copyright electronic".split()
PRONOUNS = "he she it they him her his their them we i".split()

# Alphabets of the symbol registry.
SENTENCE_TYPES = "DECLARATIVE INTERROGATIVE IMPERATIVE EXCLAMATORY".split()
PHRASES = "NP VP PP ADJP ADVP SBAR S".split()
RELATIONS = "CAUSE CONTRAST SEQUENCE ELABORATION ADDITION CONDITION SUMMARY".split()
SPECIALS = "START END PAD UNK".split()
POS_TAGS = "ADJ ADP ADV AUX CCONJ DET INTJ NOUN NUM PART PRON PROPN PUNCT SCONJ SYM VERB X".split()
DEPENDENCIES = (
    "acl acomp advcl advmod agent amod appos attr aux auxpass cc ccomp compound conj csubj dative dep det dobj expl intj mark meta neg nmod "
    "npadvmod nsubj nsubjpass nummod oprd pcomp pobj poss preconj prep prt punct ROOT"
).split()

#: Words of the default tagger, a closed list for each tag (ours: no tagging model is assumed).
TAGGER = {
    "DET": "the a an this that these those each every some any no all both",
    "PRON": "i you he she it we they me him her us them my your his its our their who whom whose what which",
    "ADP": "of in on at by for from with to into over under about after before between through during against",
    "CCONJ": "and or but nor yet",
    "SCONJ": "if because although though while since unless whereas when where",
    "AUX": "is are was were be been being am do does did has have had will would can could shall should may might must",
    "PART": "not n't",
    "INTJ": "oh ah hey hello yes please",
}
TAG_SUFFIXES = {"ADV": ["ly"], "VERB": ["ing", "ed", "ize", "ise"], "ADJ": ["ous", "ful", "able", "ible", "ive", "less", "ish"]}


def coordinates_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, k, p) for c, (k, p) in coordinates().items()], "ch string, cls int, pos int")


def morph_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(MORPH_CODES)), "code int, name string")


def connectives_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, r, len(c.split())) for r, cs in CONNECTIVES.items() for c in cs], "connective string, relation string, n_words int")


def alphabet(spark: SparkSession) -> DataFrame:
    """(symbol, id) of the default registry: all alphabets one after the other, repeats kept."""
    names = [*SENTENCE_TYPES, *PHRASES, *RELATIONS, *SPECIALS, *POS_TAGS, *DEPENDENCIES, *MORPH_CODES]
    return spark.createDataFrame([(s, i) for i, s in enumerate(names)], "symbol string, id int")


def symbol_id(table: DataFrame, symbols: DataFrame, name: str = "symbol") -> DataFrame:
    """symbols with the id of each in an alphabet (the first, where it stands twice), -1 for unknown ones."""
    ids = table.groupBy(F.col("symbol").alias(name)).agg(F.min("id").alias("id"))
    return symbols.join(F.broadcast(ids), name, "left").withColumn("id", F.coalesce("id", F.lit(-1)))


def symbol_name(table: DataFrame, ids: DataFrame, name: str = "id") -> DataFrame:
    """ids with the symbol of each, UNKNOWN for unknown ones."""
    return ids.join(F.broadcast(table.withColumnRenamed("id", name)), name, "left").withColumn("symbol", F.coalesce("symbol", F.lit("UNKNOWN")))
