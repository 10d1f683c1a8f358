"""Text and URL expressions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our ours out over own same she should so some such than that the their theirs them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours".split()
)
#: Countries and other names by which texts mention them.
GAZETTEER = tuple("Argentina Australia Austria Belgium Brazil Canada Chile China Colombia Cuba Denmark Egypt Finland France Germany Greece Hungary India Indonesia Iran Iraq Ireland Israel Italy Japan Kenya Mexico Netherlands Nigeria Norway Pakistan Peru Poland Portugal Russia Spain Sweden Switzerland Syria Thailand Turkey Ukraine Venezuela Vietnam".split())
LANGUAGE_WORDS = {
    "de": ("der", "die", "und", "das", "nicht", "ein", "ist", "von", "mit"),
    "en": ("the", "and", "of", "to", "is", "that", "was", "for", "with"),
    "es": ("el", "los", "que", "por", "una", "las", "para", "con", "del"),
    "fr": ("le", "les", "des", "et", "est", "une", "dans", "pour", "qui"),
}
ISO_639_3 = {"ar": "ara", "da": "dan", "de": "deu", "el": "ell", "en": "eng", "es": "spa", "fr": "fra", "hi": "hin", "it": "ita", "ja": "jpn", "ko": "kor", "nl": "nld", "no": "nor", "pt": "por", "ru": "rus", "sv": "swe", "zh": "zho"}
POSITIVE = ("gain", "good", "great", "growth", "improve", "profit", "rise", "strong", "success", "win")
NEGATIVE = ("bad", "crisis", "decline", "fall", "fear", "loss", "poor", "risk", "war", "weak")


def let(value: Column, f) -> Column:
    """f(value), with value worked out once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def all_text(title: Column, text: Column) -> Column:
    """title, '. ' and text; null if either is."""
    return F.concat(title, F.lit(". "), text)


def words(text: Column) -> Column:
    """Lower-case words without anything but letters."""
    return F.filter(_split(text), lambda x: x != "")


def _split(text: Column) -> Column:
    return F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\s]+", ""), r"\s+")


def tokens(text: Column, stop_words=STOP_WORDS) -> Column:
    """words without stop words; null for null."""
    return without(words(text), stop_words)


#: A character outside these scripts may have another lower case in Arrow than in the JVM, or be a letter in one of them only.
FOREIGN = r"[^\x00-\x{36F}\x{400}-\x{52F}\x{2000}-\x{206F}\x{3040}-\x{30FF}\x{4E00}-\x{9FEF}\x{AC00}-\x{D7A3}\x{1F300}-\x{1FAFF}]"


def parted(name: str) -> list[Column]:
    """(name, name_words): a text, and its words, with maybe empty ones, if Arrow functions may not split it as words does; else null."""
    c = F.col(name)
    foreign = F.when(c.rlike(r"[\x{370}-\x{10FFFF}]"), F.when(c.rlike(FOREIGN), c))  # the first is quick and mostly decides
    return [c, _split(foreign).alias(f"{name}_words")]


def without(w: Column, stop_words=STOP_WORDS) -> Column:
    return F.filter(w, lambda x: ~x.isin(*stop_words))


def lemmatise(df: DataFrame, token_col: str, lemmas: DataFrame) -> DataFrame:
    """Replaces tokens by their lemma where the dictionary (word, lemma) has one; the planner picks the join.

    Rows are told apart by a digest of their tokens, which a second reading gives again.
    """
    at = df.withColumn("__row", F.sha2(F.array_join(token_col, " "), 256))
    flat = at.select("__row", F.col(token_col).alias("__t")).dropDuplicates(["__row"]).select("__row", F.posexplode("__t").alias("__pos", "word"))
    flat = flat.join(lemmas.select("word", "lemma").dropDuplicates(["word"]), "word", "left")
    back = flat.groupBy("__row").agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", F.coalesce("lemma", "word").alias("w")))), lambda x: x["w"]).alias("__tokens"))
    joined = at.join(back, "__row", "left")
    return joined.withColumn(token_col, F.when(F.col(token_col).isNotNull(), F.coalesce("__tokens", F.array().cast("array<string>")))).drop("__row", "__tokens")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(text: Column, parts) -> Column:
    return any_of([text.contains(p) for p in parts])


def countries(text: Column, gazetteer=GAZETTEER) -> Column:
    """The names of the gazetteer that the text has as whole words, in the gazetteer's order; null for null."""
    padded = F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}]+", " "), F.lit(" "))
    found = let(padded, lambda p: F.filter(F.array(*map(F.lit, gazetteer)), lambda c: p.contains(F.concat(F.lit(" "), c, F.lit(" ")))))
    return F.when(text.isNotNull(), found)


def _hits(w: Column, own) -> Column:
    return F.size(F.filter(w, lambda x: x.isin(*own)))


def language(text: Column) -> Column:
    """The language whose frequent words make up most of the text, ties to the first in order; null without any."""

    def best(w):
        scores = [F.struct(_hits(w, own).alias("n"), F.lit(-k).alias("k"), F.lit(code).alias("code")) for k, (code, own) in enumerate(sorted(LANGUAGE_WORDS.items()))]
        return F.greatest(*scores)

    return let(let(words(text), best), lambda b: F.when(b["n"] > 0, b["code"]))


def mood(w: Column) -> Column:
    """positive_1, negative_1 or neutral_1 of words by a small lexicon."""
    score = F.when(w.isNotNull(), _hits(w, POSITIVE) - _hits(w, NEGATIVE))
    return let(score, mood_of)


def mood_of(score: Column) -> Column:
    return F.when(score > 0, "positive_1").when(score < 0, "negative_1").when(score == 0, "neutral_1")


def sentiment(text: Column) -> Column:
    return let(words(text), mood)


def host(url: Column) -> Column:
    """Host in lower case; null for a URL without one, or one that can't be parsed."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def netloc(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("AUTHORITY"))


def on_host(url: Column, sites) -> Column:
    """Whether the host is one of the sites or lies below it."""
    h = host(url)
    return F.coalesce(any_of([(h == s.lower()) | h.endswith("." + s.lower()) for s in sites]), F.lit(False))


def allowed_domain(url: Column, allow_subdomains: bool = True) -> Column:
    """The host without www., or its last two labels."""
    h = F.regexp_replace(host(url), r"^www\.", "")
    return h if allow_subdomains else F.regexp_extract(h, r"([^.]+\.[^.]+)$", 1)


def is_root_domain(url: Column, root: Column) -> Column:
    """Whether a URL isn't from a subdomain of the root."""
    return F.coalesce(allowed_domain(url) == allowed_domain(root, False), F.lit(False))


def wildcard(pattern: str) -> str:
    return pattern.replace("*", "%")


#: What the classifier's tokenizer drops before it splits at blanks.
_DROPPED = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n"


def token_ids(text: Column, vocabulary: dict[str, int], length: int) -> Column:
    """The ids of a text's known words, in order, cut and padded on the left to `length`; null for null.

    The vocabulary, a file's worth, travels with the function; texts are read in Arrow batches.
    """
    table = str.maketrans(_DROPPED, " " * len(_DROPPED))

    @F.pandas_udf("array<int>")
    def run(texts):
        def one(t):
            if t is None:
                return None
            ids = [i for w in t.lower().translate(table).split(" ") if (i := vocabulary.get(w)) is not None][-length:]
            return [0] * (length - len(ids)) + ids

        return texts.map(one)

    return run(text)


def database_uri(connection: str, database: str, collection: str) -> str:
    """The connection string with its path replaced by database.collection; the query string stays."""
    base, mark, query = connection.partition("?")
    scheme, sep, rest = base.partition("://")
    return f"{scheme}{sep}{rest.split('/', 1)[0]}/{database}.{collection}{mark}{query}"


def pad_tokens(ids: Column, length: int) -> Column:
    """Ids cut to their last `length` and padded with zeros on the left."""
    kept = F.slice(ids, F.greatest(F.size(ids) - length + 1, F.lit(1)), length)
    return F.concat(F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(kept), F.lit(0))), kept)
