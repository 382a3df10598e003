"""Text expressions: all run inside the JVM, none is a Python function on rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from quizspark import fixed_values as fv

# One set of character classes for every engine: letters, digits and white space as Unicode
# defines them.
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
NOT_WS = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]"
#: What lies between words: white space and all punctuation but ' and -.
GAP = r"[^\p{L}\p{N}_'-]+"
FORM_START = r"(?:(?:what|who|where|when)\s+(?:is|are|was|were)|(?:why|how)\s+is)\s+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; none is left at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def words_in(flat: Column) -> Column:
    """Number of words of a text whose words are separated by single blanks."""
    return F.when(flat == "", F.lit(0)).otherwise(
        F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1)


def word_count(c: Column) -> Column:
    return words_in(collapse(c))


def normalize_text(c: Column) -> Column:
    """Lower case, no punctuation except ' and -, single blanks, no leading article."""
    words = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), GAP, " ")
    return F.regexp_replace(words, r"^ ?(?:(?:the|a|an) (?=[^ ]))?| $", "")


def question_content(norm: Column) -> Column:
    """What follows "what is", "who was" and so on; NULL when the text is not in question form."""
    return F.nullif(F.trim(F.regexp_extract(norm, f"(?i)^{FORM_START}(.+?)(\\?|$)", 1)), F.lit(""))


def starts_as_question(c: Column) -> Column:
    return F.lower(c).rlike(f"^{WS}*{FORM_START}(?s:.*){NOT_WS}")


def is_empty(c: Column) -> Column:
    """Whether a text has nothing but white space; NULL for NULL."""
    return ~c.rlike(NOT_WS)


def extract_numbers(c: Column) -> Column:
    """Distinct numbers in the text, without commas and dollar signs."""
    found = [F.regexp_extract_all(c, F.lit("(?U)" + p), F.lit(0)) for p in fv.NUMBER_PATTERNS]
    bare = F.split(F.regexp_replace(F.array_join(F.concat(*found), "\n"), "[,$]", ""), "\n")  # a number has no line end
    return F.array_remove(F.array_distinct(bare), "")


def extract_years(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(?U)" + fv.YEAR_PATTERN), F.lit(1))


def replace_words(c: Column, mapping: dict[str, str]) -> Column:
    """Replace whole words, ignoring case, in one pass; texts without any such word are untouched."""
    lookup = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    pieces = F.transform(F.split(c, r"(?U)\b"),
                         lambda w: F.coalesce(F.try_element_at(lookup, F.lower(w)), w))
    present = c.rlike(r"(?Ui)\b(" + "|".join(mapping) + r")\b")
    return F.when(present, F.array_join(pieces, "")).otherwise(c)


def words_to_digits(c: Column) -> Column:
    return replace_words(c, fv.NUMBER_WORDS)


def _final_expansion(key: str, expansions: list[str]) -> str:
    """A key's expansions apply one after another, each to the text the last one left."""
    text = key
    for expansion in expansions:
        text = re.sub(rf"\b{key}\b", expansion, text)
    return text


EXPANDED = {k: _final_expansion(k, v) for k, v in fv.ABBREVIATIONS.items()}


def expand_abbreviations(c: Column) -> Column:
    return replace_words(c, EXPANDED)


def meaningful_tokens(norm: Column) -> Column:
    """Words of three or more letters or digits that are not stop words.

    Contractions are cut at the apostrophe before the test.
    """
    bare = F.regexp_replace(norm, r"(n't|'s|'m|'d|'ll|'re|'ve|')(?= |$)", "")
    return F.regexp_extract_all(bare, F.lit(rf"(?<![^ ])(?!{_any_of(fv.STOPWORDS)}(?![^ ]))[\p{{L}}\p{{N}}]{{3,}}(?![^ ])"), F.lit(0))


def _any_of(words: list[str]) -> str:
    """A pattern for any of the words, by first letter, so that few are tried at a place."""
    firsts = sorted({w[0] for w in words})
    return "(?:" + "|".join(re.escape(a) + "(?:" + "|".join(re.escape(w[1:]) for w in words if w[0] == a) + ")" for a in firsts) + ")"


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token lists; 0 when either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / union)


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def first_piece(c: Column, delimiter: str) -> Column:
    """Text before the first delimiter, or all of it."""
    return F.substring_index(c, delimiter, 1)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; a cheap score for comparing short answers."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def sorted_tokens(norm: Column) -> Column:
    return F.array_join(F.sort_array(F.split(norm, " ")), " ")
