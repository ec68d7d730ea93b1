"""Text preparation as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators of the whitespace tokenizer.
SPACE = r"[ \t\n\x0B\f\r]+"
OOV = "_OOV_"

#: A short stop list of our own; longer ones are read with ``sources.read_stop_list``.
STOP_WORDS = ("a", "and", "as", "at", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with", "de", "la", "le", "el", "en", "der", "die", "und")

#: Named category sets of the newsgroup collection.
CATEGORY_SETS = {
    "null": ("null",),
    "diff3": ("alt.atheism", "rec.sport.baseball", "sci.space"),
    "sim3": ("comp.graphics", "comp.os.ms-windows.misc", "comp.windows.x"),
    "rel3": ("talk.politics.guns", "talk.politics.mideast", "talk.politics.misc"),
    "tng": (
        "alt.atheism", "comp.graphics", "comp.os.ms-windows.misc", "comp.sys.ibm.pc.hardware", "comp.sys.mac.hardware",
        "comp.windows.x", "misc.forsale", "rec.autos", "rec.motorcycles", "rec.sport.baseball", "rec.sport.hockey", "sci.crypt",
        "sci.electronics", "sci.med", "sci.space", "soc.religion.christian", "talk.politics.guns", "talk.politics.mideast",
        "talk.politics.misc", "talk.religion.misc",
    ),
}


def categories(name: str) -> tuple[str, ...]:
    """A named set, or for a number n the categories '0' to 'n-1'."""
    return tuple(str(k) for k in range(int(name))) if name.isdigit() else CATEGORY_SETS[name]


def nonalpha_tokens(text: Column) -> Column:
    """Runs of letters; empty strings at the ends stay, as for any splitter."""
    return F.split(text, "[^a-zA-Z]+", -1)


def whitespace_tokens(text: Column) -> Column:
    """Tokens between white space that hold letters only."""
    return F.filter(F.split(text, SPACE, -1), lambda t: ~t.rlike("[^a-zA-Z]"))


TOKENIZERS = {"nonalpha": nonalpha_tokens, "whitespace": whitespace_tokens}


def nonempty(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t != "")


def lowered(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def without(tokens: Column, stop: Iterable[str]) -> Column:
    """Drops exact, case-sensitive matches. The list becomes one literal set
    that the codegen'd IN tests by hash."""
    words = list(stop)
    return F.filter(tokens, lambda t: ~t.isin(words)) if words else tokens


def prepared(text: Column, tokenizer: str = "nonalpha", lower: bool = True, stop: Iterable[str] = ()) -> Column:
    """Tokenize, drop empty tokens, lower-case, drop stop words, in this order."""
    tokens = nonempty(TOKENIZERS[tokenizer](text))
    return without(lowered(tokens) if lower else tokens, stop)


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def after_header(of: Column) -> Column:
    """Lines after the first blank one; none if there is no blank line."""
    blank = F.array_position(F.transform(of, lambda x: F.trim(F.regexp_replace(x, SPACE, " ")) == ""), True)
    return F.when(blank > 0, F.slice(of, blank.cast("int") + 1, F.size(of))).otherwise(F.array().cast("array<string>"))


def without_walls(of: Column) -> Column:
    """Lines that have white space inside, once their right end is trimmed."""
    return F.filter(of, lambda x: F.regexp_replace(x, SPACE + r"\z", "").rlike(SPACE))


def paragraphs(text: Column) -> Column:
    """The insides of <p> or <p ...> up to </p>, in any case of letters."""
    return F.regexp_extract_all(text, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), 1)


def metric_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"\W", "_")
