"""Text as column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
CLOSING = "\"'”’)]»"
TERMINAL = ".!?…"

#: The marks that are dropped after a letter, and letters that count as another one.
MARKS = "\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u0309\u030a\u030b\u030c\u030f\u0311\u031b\u0323\u0324\u0325\u0326\u0327\u0328\u032d\u032e\u0330\u0331"
VARIANTS = {"µ": "μ", "ſ": "s", "ς": "σ", "ϐ": "β", "ϑ": "θ", "ϕ": "φ", "ϖ": "π", "ϰ": "κ", "ϱ": "ρ", "ϵ": "ε", "ẛ": "s", "\u1fbe": "ι"}

#: Latin-1 to Latin Extended-B, and Latin Extended Additional.
_BLOCKS = ((0x00C0, 0x0250), (0x1E00, 0x1F00))


def _folded() -> tuple[str, str]:
    """Lower-case letters that are a Latin letter and one mark by canonical decomposition, with those letters, and the
    variants. Letters with two marks and those of other scripts stay as they are."""
    pairs = dict(VARIANTS)
    for a, b in _BLOCKS:
        for c in map(chr, range(a, b)):
            base, *marks = unicodedata.normalize("NFD", c)
            if c == c.lower() and len(marks) == 1 and unicodedata.combining(marks[0]) and "a" <= base <= "z":
                pairs[c] = base
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _folded()
#: What tokens consist of, after folding.
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(split_words(F.coalesce(text, F.lit("")))).cast("long")


def ends_sentence(word: Column) -> Column:
    bare = F.regexp_replace(strip(word), f"[{''.join(chr(92) + c if c in ']' else c for c in CLOSING)}]+$", "")
    return F.coalesce(bare.rlike(f"[{TERMINAL}]$"), F.lit(False))


def fold(text: Column) -> Column:
    """Lower case, Latin letters without their mark where they have one, and without the marks that follow letters."""
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), f"[{MARKS}]+", "")


def tokens(text: Column) -> Column:
    """Runs of letters, digits and private-use characters of the folded text; other marks part tokens."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


_FOLD = str.maketrans(ACCENTED, PLAIN, MARKS)
_TOKEN = re.compile("(?:[^\\W_]|[\ue000-\uf8ff\U000f0000-\U000ffffd\U00100000-\U0010fffd])+")


def tokens_of(text: str) -> list[str]:
    """The tokens of one query on the driver."""
    return _TOKEN.findall(text.lower().translate(_FOLD))


def escape_query(query: Column) -> Column:
    """White-space separated terms, each in double quotes, joined by OR; '' for a blank query."""
    terms = split_words(F.translate(query, '"', " "))
    return F.array_join(F.transform(terms, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " OR ")


def normalize_word(word: Column) -> Column:
    """Lower-case a-z and apostrophes, the characters of an acoustic model."""
    return F.regexp_replace(F.lower(strip(word)), "[^a-z']", "")


def encode_word(word: Column, dictionary: Column) -> Column:
    """Ids of the word's characters that the dictionary (a map) holds."""
    letters = F.filter(F.split(normalize_word(word), ""), lambda c: c != "")
    return F.filter(F.transform(letters, lambda c: F.try_element_at(dictionary, c)), lambda x: x.isNotNull())
