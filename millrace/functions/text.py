"""Text expressions: normalisation, tokens, n-grams and shingles, all JVM-side where the semantics allow."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\w+)"), F.lit(0))


def normalise(text: Column) -> Column:
    """Without square brackets, back ticks and punctuation; ``_`` and the slash of I/O stay; outer blanks go."""
    bare = F.regexp_replace(F.regexp_replace(text, r"[\[\]]", ""), "`s|`", "")
    kept = F.regexp_replace(bare, r"(?<![Ii])/|/(?![Oo])|[\p{P}+=<>&&[^_/]]", " ")
    return F.regexp_replace(kept, r"^[ \n]+|[ \n]+\z", "")


def split_names(text: Column) -> Column:
    """Lower-case words with snake and camel case taken apart: ``getFileName_raw`` gives get, file, name, raw."""
    apart = F.regexp_replace(F.regexp_replace(text, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2"), "_", " ")
    return F.regexp_extract_all(F.lower(apart), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` tokens as texts; empty if there are fewer. ``n`` below 1 is an error."""
    if n < 1:
        raise ValueError("n must be at least 1")
    # shifted copies side by side: linear in the tokens, where a slice per position would copy the rest each time
    count = F.greatest(F.size(tokens) - n + 1, F.lit(0))
    shifted = F.arrays_zip(*[F.slice(tokens, F.lit(i + 1), count).alias(f"t{i}") for i in range(n)])
    return F.when(F.size(tokens) >= n, F.transform(shifted, lambda g: F.concat_ws(" ", *[g[f"t{i}"] for i in range(n)]))).otherwise(F.array().cast("array<string>"))


def shingles(text: Column, size: int = 5, keep_underscores: bool = False) -> Column:
    """Windows of ``size`` letters of the lower-case text; underscores are taken out first unless kept."""
    low = F.lower(text) if keep_underscores else F.replace(F.lower(text), F.lit("_"), F.lit(""))
    return F.regexp_extract_all(low, F.lit(f"(?=(\\p{{L}}{{{size}}}))"), F.lit(1))


def letter_runs(text: Column, size: int = 5) -> Column:
    """Whole runs of at least ``size`` letters, whose windows are the :func:`shingles` of the text."""
    low = F.replace(F.lower(text), F.lit("_"), F.lit(""))
    return F.regexp_extract_all(low, F.lit(f"(\\p{{L}}{{{size},}})"), F.lit(1))


def without(tokens: Column, stop: list[str]) -> Column:
    """Tokens that aren't stop words."""
    return F.filter(tokens, lambda t: ~t.isin(stop))


#: The most common English function words.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "how", "i", "if", "in", "is", "it", "its", "not", "of", "on", "or", "so", "that", "the", "their", "then", "there", "they", "this", "to", "was", "we", "were", "what", "when", "which", "who", "will", "with", "you", "your"]


def top_level_imports(source: Column) -> Column:
    """Distinct top-level modules that Python text imports, by its import lines."""
    plain = F.regexp_extract_all(source, F.lit(r"(?m)^[ \t]*import[ \t]+([A-Za-z_]\w*)"), F.lit(1))
    given = F.regexp_extract_all(source, F.lit(r"(?m)^[ \t]*from[ \t]+([A-Za-z_]\w*)[\w.]*[ \t]+import\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(plain, given)))


#: Fixed value: what a code token is, in this order: comments, strings, numbers, names, single signs.
CODE_TOKEN = r"""//[^\n]*|#[^\n]*|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[0-9]+(?:\.[0-9]+)?|[A-Za-z_][A-Za-z0-9_]*|[^\sA-Za-z0-9_]"""


def code_tokens(source: Column) -> Column:
    """Tokens of program text of most languages: comments, strings, numbers, names and signs."""
    return F.regexp_extract_all(source, F.lit(CODE_TOKEN), F.lit(0))


def code_kind(token: Column) -> Column:
    """The kind of a code token by its first characters."""
    return F.when(token.rlike("^(//|#)"), "comment").when(token.rlike("^[\"'].+[\"']$"), "string").when(token.rlike("^[0-9]"), "number").when(token.rlike("^[A-Za-z_]"), "name").otherwise("sign")


def html_words(page: Column) -> Column:
    """Words of a page's text: scripts, styles and tags go, five entities are read."""
    bare = F.regexp_replace(F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return words(bare)


_STEPS = [  # Fixed values: the suffix rules of Porter's algorithm, steps 2 to 4, with the measure each needs
    (0, {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}),
    (0, {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}),
    (1, {s: "" for s in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")}),
]


def _vowels(w: str) -> list[bool]:
    out: list[bool] = []
    for i, c in enumerate(w):
        out.append(c in "aeiou" or c == "y" and i > 0 and not out[-1])
    return out


def _measure(stem: str) -> int:
    v = _vowels(stem)
    return sum(a and not b for a, b in zip(v, v[1:]))


def _short_end(w: str) -> bool:
    v = _vowels(w)
    return len(w) >= 3 and not v[-3] and v[-2] and not v[-1] and w[-1] not in "wxy"


def porter_stem(word: str) -> str:
    """Porter's stem of a lower-case word; a word of other letters than a to z stays as it is."""
    w = word
    if not w.isascii() or not w.isalpha():
        return w
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and any(_vowels(w[: -len(end)])):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and not _vowels(w)[-1] and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and any(_vowels(w[:-1])):
        w = w[:-1] + "i"
    for least, rules in _STEPS:
        for end in sorted(rules, key=len, reverse=True):
            if w.endswith(end):
                stem = w[: -len(end)]
                if _measure(stem) > least and (end != "ion" or stem[-1:] in ("s", "t")):
                    w = stem + rules[end]
                break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(tokens: pd.Series) -> pd.Series:
    """Porter stems of arrays of lower-case tokens; a batch stems each distinct token once."""
    known: dict[str, str] = {}
    return tokens.map(lambda ts: None if ts is None else [known[t] if t in known else known.setdefault(t, porter_stem(t)) for t in ts])
