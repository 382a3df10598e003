"""Comparing an answer with one or several acceptable answers.

Strategies run in a fixed order and the first hit wins; without a hit the most confident strategy
is reported. A row's answers are compared in the row, so nothing is exploded, shuffled or tagged.

The strategies work on a batch of rows at once, in a worker of Python: each strategy sees all answers of the rows that the strategies before it left open, and a hit closes its row.
Texts come in lower case from Spark, whose ``lower`` also mends broken encodings.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from quizspark import fixed_values as fv
from quizspark.functions import text as tx
from quizspark.functions.similarity import best_scores
from quizspark.plans.stages import small_methods
from quizspark.plans.storage import written

_ORDER = ["exact", fv.QUESTION_TYPE, "number_date", "abbreviation", "fuzzy", "semantic"]
_FIELDS = [("is_match", "boolean"), ("confidence", "double"), ("match_type", "string"), ("normalized_answer", "string"), ("normalized_expected", "string")]
_SQL_TYPE = "struct<" + ", ".join(f"{n}: {t}" for n, t in [*_FIELDS, ("at", "int")]) + ">"
_FORM = re.compile(r"(?:(?:what|who|where|when) (?:is|are|was|were)|(?:why|how) is) (.+)")
_CONTRACTION = re.compile(r"(?:n't|'s|'m|'d|'ll|'re|'ve|')$")
_STOP = frozenset(fv.STOPWORDS)
# Letters, digits, letter-like numbers and _ make words; of what is left in a normalised text, blank, ', - and other numbers (as in "5\u00b2") end them.
_IN_WORD = r"\p{L}\p{Nd}\p{Nl}_"


def _list(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


def normalized(low: pa.Array) -> pa.Array:
    """``text.normalize_text`` of texts in lower case."""
    words = _ascii_words(low)
    if words is None:
        words = pc.utf8_trim(pc.replace_substring_regex(low, pattern=tx.GAP, replacement=" "), " ")
    return pc.replace_substring_regex(words, pattern="^(?:the|a|an) ", replacement="")


_IN_ASCII_WORD = np.array([chr(i).isascii() and (chr(i).isalnum() or chr(i) in "_'-") for i in range(256)])


def _ascii_words(low: pa.Array) -> pa.Array | None:
    """The words of ASCII texts with single blanks between them; None if any text has other characters."""
    _, ends, letters = low.buffers()
    if letters is None:
        return low
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_string(low.type) else np.int32)[low.offset:low.offset + len(low) + 1].astype(np.int64)
    letters = np.frombuffer(letters, np.uint8)[ends[0]:ends[-1]]
    if len(letters) and letters.max() > 127:
        return None
    ends = ends - ends[0]
    inside = _IN_ASCII_WORD[letters]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = ends[:-1][ends[:-1] < ends[1:]]
    begins[cuts] = inside[cuts]  # a text begins a word though the one before ends with a letter
    first = np.flatnonzero(begins)
    owner = np.searchsorted(ends, first, side="right")
    begins[first[np.diff(owner, prepend=-1) != 0]] = False  # no blank before the first word of a text
    size = np.concatenate([[0], np.cumsum(inside.astype(np.int64) + begins)])
    out = np.full(size[-1], ord(" "), np.uint8)
    out[size[1:][inside] - 1] = letters[inside]
    return pa.LargeStringArray.from_buffers(len(low), pa.py_buffer(size[ends]), pa.py_buffer(out)).cast(low.type)


def _content(norm: str) -> str | None:
    found = _FORM.match(norm) if norm[:1] in ("w", "h") else None
    return found[1] if found else None


def _listed(words) -> str:
    return "(?:" + "|".join(words) + ")"


def _bounded(pattern: str) -> str:
    """A pattern, for Arrow, of a whole word."""
    return f"(?:^|[^{_IN_WORD}]){pattern}(?:$|[^{_IN_WORD}])"


@cache
def _whole(pattern: str, plain: bool) -> re.Pattern:
    """A pattern of a whole word, for ASCII or for any text."""
    if plain:
        return re.compile(rf"\b{pattern}\b", re.ASCII)
    other = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "No")
    return re.compile(rf"(?<![^\W{other}]){pattern}(?![^\W{other}])")


def _replaced(norm: str, mapping: dict[str, str]) -> str:
    return _whole(_listed(mapping), norm.isascii()).sub(lambda m: mapping[m[0]], norm)


def _numbers(norm: str) -> tuple[set[str], int, set[str]]:
    """Numbers of the text and of the text with number words as digits; how many both have, each counted by itself; the text's years.

    A normalised text has no commas, points and dollar signs, so its numbers are whole words of digits.
    """
    number = _whole(r"\d+", norm.isascii())
    own = set(number.findall(norm))
    also = set(number.findall(_replaced(norm, fv.NUMBER_WORDS)))
    return own | also, len(own) + len(also), {x for x in own if re.fullmatch(r"1\d{3}|20\d{2}", x)}


def number_confidence(a: str, e: str, count_distinct: bool = False) -> float:
    """Share of expected numbers found, or 1 for a shared year.

    The denominator is the length of the double list of expected numbers unless ``count_distinct``.
    """
    have, _, years = _numbers(a)
    wanted, listed, wanted_years = _numbers(e)
    total = len(wanted) if count_distinct else listed
    return 1.0 if years & wanted_years else len(have & wanted) / total if total else 0.0


def _tokens(norm: str) -> set[str]:
    """The distinct ``text.meaningful_tokens``."""
    words = norm.split(" ")
    if "'" in norm:
        words = [_CONTRACTION.sub("", w) for w in words]
    found = {w for w in words if len(w) > 2} - _STOP
    return {w for w in found if not ("-" in w or "'" in w or "_" in w)} if "-" in norm or "'" in norm or "_" in norm else found


def _overlap(x: set[str], y: set[str]) -> float:
    shared = len(x & y)
    return shared / (len(x) + len(y) - shared) if shared else 0.0


class _Batch:
    """The answers of a batch of rows, each against those expected; ``pairs`` are the comparisons still open."""

    def __init__(self, low: pa.Array, expected: pa.ListArray, blank: np.ndarray) -> None:
        counts = pc.list_value_length(expected).to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.cumsum(counts) - counts
        self.row = np.repeat(np.arange(len(counts)), counts)
        self.answers, self.wanted = normalized(low), normalized(expected.flatten())
        self.na, self.ne = _list(self.answers), _list(self.wanted)
        self.blank = blank
        self.won, self.kind = self.first.copy(), np.zeros(len(counts), np.int64)
        self.found, self.confidence = np.zeros(len(counts), bool), np.zeros(len(counts))
        self.pairs = np.flatnonzero(~blank[self.row])

    def texts(self) -> list[tuple[str, str]]:
        na, ne = self.na, self.ne
        return [(na[r], ne[p]) for r, p in zip(self.row[self.pairs].tolist(), self.pairs.tolist())]

    def settle(self, hits: np.ndarray, kind: int, confidence: np.ndarray | float) -> None:
        """Rows with a hit take the first one and leave; ``hits`` and ``confidence`` go with ``pairs``."""
        at = np.flatnonzero(hits)
        rows, firsts = np.unique(self.row[self.pairs[at]], return_index=True)
        self.won[rows], self.kind[rows], self.found[rows] = self.pairs[at[firsts]], kind, True
        self.confidence[rows] = np.broadcast_to(confidence, len(self.pairs))[at[firsts]]
        self.pairs = self.pairs[~self.found[self.row[self.pairs]]]

    def have(self, pattern: str) -> tuple[np.ndarray, np.ndarray]:
        """Which of the open pairs have the pattern in the answer, and which in the expected answer."""
        rows = np.unique(self.row[self.pairs])
        answers = np.zeros(len(self.na), bool)
        answers[rows] = pc.match_substring_regex(self.answers.take(pa.array(rows)), pattern=pattern).to_numpy(zero_copy_only=False)
        return answers[self.row[self.pairs]], pc.match_substring_regex(self.wanted.take(pa.array(self.pairs)), pattern=pattern).to_numpy(zero_copy_only=False)


def matched(low: pa.Array, expected: pa.ListArray, blank: pa.Array, lacks_form: pa.Array, fuzzy_least: pa.Array, semantic_least: pa.Array, synonym: pa.Array,
            fuzzy: bool, count_distinct: bool) -> pa.Array:
    """``match`` of each row with the place of the answer it was matched against; answers and lists of expected answers come in lower case."""
    b = _Batch(low, expected, blank.to_numpy(zero_copy_only=False))
    lacks, near, same, related = (x.to_numpy(zero_copy_only=False) for x in (lacks_form, fuzzy_least, semantic_least, synonym))
    c1, c2, c4, c5 = (np.zeros(len(b.ne)) for _ in range(4))

    b.settle(np.fromiter((a == e for a, e in b.texts()), bool, len(b.pairs)), 0, 1.0)

    rows = np.unique(b.row[b.pairs]).tolist()
    forms = dict(zip(rows, (_content(b.na[r]) for r in rows)))
    asked = [(forms[r], _content(b.ne[p]), b.na[r], b.ne[p]) for r, p in zip(b.row[b.pairs].tolist(), b.pairs.tolist())]
    same_content = [(fa or fe) is not None and (fa or a) == (fe or e) for fa, fe, a, e in asked]
    c1[b.pairs] = [question_form_confidence(fa, fe, hit) for (fa, fe, _, _), hit in zip(asked, same_content)]
    c1[b.pairs] *= np.where(lacks[b.row[b.pairs]], 0.5, 1.0)
    b.settle(np.array(same_content, bool), 1, c1[b.pairs])

    # Without a number in both there is nothing to list.
    in_answer, in_expected = b.have(r"\p{Nd}|" + _bounded(_listed(fv.NUMBER_WORDS)))
    some = np.flatnonzero(in_answer & in_expected)
    c2[b.pairs[some]] = [number_confidence(b.na[b.row[p]], b.ne[p], count_distinct) for p in b.pairs[some].tolist()]
    b.settle(c2[b.pairs] >= fv.NUMBER_THRESHOLD, 2, c2[b.pairs])

    in_answer, in_expected = b.have(_bounded(_listed(tx.EXPANDED)))
    expands = in_answer | in_expected
    some = np.flatnonzero(expands)

    def alike(p: int) -> bool:
        a, e = b.na[b.row[p]], b.ne[p]
        xa, xe = _replaced(a, tx.EXPANDED), _replaced(e, tx.EXPANDED)
        return xa == e or a == xe or xa == xe
    expands[some] = [alike(p) for p in b.pairs[some].tolist()]
    b.settle(expands, 3, 1.0)

    # A row's later answers, one, then two, four and so on, are scored only if none before has a hit.
    waiting, missed, most = b.pairs, [b.pairs[:0]], 1
    while fuzzy and len(waiting):
        begins = np.flatnonzero(np.diff(b.row[waiting], prepend=-1))
        now = np.arange(len(waiting)) - np.repeat(begins, np.diff(begins, append=len(waiting))) < most
        b.pairs, waiting, most = waiting[now], waiting[~now], 2 * most
        c4[b.pairs] = best_scores(*zip(*b.texts())) / 100.0
        b.settle(c4[b.pairs] >= near[b.row[b.pairs]], 4, c4[b.pairs])
        missed.append(b.pairs)
        waiting = waiting[~b.found[b.row[waiting]]]
    b.pairs = np.sort(np.concatenate([*missed, waiting]))
    b.pairs = b.pairs[~b.found[b.row[b.pairs]]]

    said = {r: _tokens(b.na[r]) for r in np.unique(b.row[b.pairs]).tolist()}
    c5[b.pairs] = [_overlap(said[r], _tokens(b.ne[p])) for r, p in zip(b.row[b.pairs].tolist(), b.pairs.tolist())]
    c5[b.pairs] = np.maximum(c5[b.pairs], related[b.row[b.pairs]] * 0.8)
    b.settle(c5[b.pairs] >= same[b.row[b.pairs]], 5, c5[b.pairs])

    # Nothing matched: the highest confidence, then the earliest strategy with it, then the earliest answer.
    p, each = b.pairs, np.stack([c1, c2, c4, c5])[:, b.pairs]
    top = each.max(axis=0)
    kind = np.where(top == 0, 0, np.array([1, 2, 4, 5])[(each == top).argmax(axis=0)])
    order = np.lexsort((p, kind, -top, b.row[p]))
    rows, firsts = np.unique(b.row[p[order]], return_index=True)
    firsts = order[firsts]
    b.won[rows], b.kind[rows], b.confidence[rows] = p[firsts], kind[firsts], top[firsts]

    kinds = pa.array(_ORDER).take(pa.array(b.kind))
    answers = pc.if_else(pa.array(b.blank), "", b.answers)
    columns = [pa.array(b.found), pa.array(b.confidence), kinds, answers, b.wanted.take(pa.array(b.won)), pa.array((b.won - b.first).astype(np.int32))]
    return pa.StructArray.from_arrays(columns, names=[*[n for n, _ in _FIELDS], "at"])


def question_form_confidence(form_a: str | None, form_e: str | None, hit: bool) -> float:
    if form_a is not None and form_e is not None:
        return 1.0 if hit else 0.7
    if form_a is not None:
        return 0.9 if hit else 0.0
    return 0.8 if form_e is not None and hit else 0.0


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _low(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def _match(df: DataFrame, answer: str, expected: Column, form_required, fuzzy: bool, fuzzy_threshold, semantic_threshold, synonym_score: str | None, count_distinct: bool) -> DataFrame:
    """Add ``_m_match``: the match and the place in the list ``expected`` (lower case) of what it was matched against."""
    @F.arrow_udf(_SQL_TYPE)
    def of(low: pa.Array, expected: pa.Array, blank: pa.Array, lacks: pa.Array, near: pa.Array, same: pa.Array, synonym: pa.Array) -> pa.Array:
        return matched(low, expected, blank, lacks, near, same, synonym, fuzzy, count_distinct)

    said = F.col(answer)
    # An answer in question form is looked for only where one is required.
    lacks = F.when(_col(form_required), F.coalesce(~tx.starts_as_question(said), F.lit(False))).otherwise(F.lit(False))
    synonym = F.coalesce(F.col(synonym_score), F.lit(0.0)) if synonym_score else F.lit(0.0)
    least = [F.coalesce(_col(x).cast("double"), F.lit(float("inf"))) for x in (fuzzy_threshold, semantic_threshold)]
    small_methods(df.sparkSession)
    return df.withColumn("_m_match", of(_low(said), expected, F.coalesce(tx.is_empty(said), F.lit(True)), lacks, *least, synonym.cast("double")))


def match_answers(df: DataFrame, answer: str, expected: str, form_required: Column | bool = False,
                  fuzzy: bool = True, fuzzy_threshold: Column | float = fv.FUZZY_THRESHOLD,
                  semantic_threshold: Column | float = fv.SEMANTIC_THRESHOLD,
                  synonym_score: str | None = None, count_distinct: bool = False) -> DataFrame:
    """Add a ``match`` struct: is_match, confidence, match_type and both normalised texts.

    Rows settled by an earlier strategy skip the work of the later ones.
    """
    out = _match(df, answer, F.array(_low(F.col(expected))), form_required, fuzzy, fuzzy_threshold, semantic_threshold, synonym_score, count_distinct)
    return out.withColumn("match", _taken()).drop("_m_match")


def _taken() -> Column:
    return F.struct(*[F.col(f"_m_match.{n}").alias(n) for n, _ in _FIELDS])


def match_any(df: DataFrame, answer: str, expected: str, alternatives: str, form_required: Column | bool = False,
              fuzzy: bool = True, fuzzy_threshold: Column | float = fv.FUZZY_THRESHOLD,
              semantic_threshold: Column | float = fv.SEMANTIC_THRESHOLD,
              synonym_score: str | None = None, count_distinct: bool = False) -> DataFrame:
    """Match against the expected answer and a list of alternatives; adds ``match`` and ``matched_against``.

    The first hit in (strategy, position) order wins, else the highest confidence, earliest first.
    """
    also = F.coalesce(F.col(alternatives), F.array().cast("array<string>"))
    listed = F.concat(F.array(_low(F.col(expected))), F.transform(also, _low))
    out = _match(df, answer, listed, form_required, fuzzy, fuzzy_threshold, semantic_threshold, synonym_score, count_distinct)
    at = F.col("_m_match.at")
    against = F.when(at == 0, F.col(expected)).otherwise(F.get(also, at - 1))
    return out.withColumns({"match": _taken(), "matched_against": against}).drop("_m_match")


def synonym_similarity(df: DataFrame, row_id: str, tokens: str, expected_tokens: str,
                       synonyms: DataFrame) -> DataFrame:
    """Mean over answer tokens of the best similarity to any expected token.

    ``synonyms`` has ``token_a, token_b, sim``; of several values for a pair the greatest counts. Equal tokens count as 1. A row without tokens, or with a NULL list, scores 0.

    The distinct pairs of an answer token and another expected token are resolved first, so a token of many rows meets the synonyms once. Rows carry a written tag of their own;
    ids may repeat or be NULL (``row_id`` is kept for its callers and not read). Only pairs that are synonyms come back to the rows, as a
    map from token to its best value.
    """
    rows = written(df.withColumn("_row", F.monotonically_increasing_id()), "synonym-rows")
    pairs = (rows.select("_row", F.explode(F.array_distinct(tokens)).alias("_t"), F.col(expected_tokens).alias("_e"))
             .where(~F.array_contains("_e", F.col("_t"))).select("_row", "_t", F.explode(F.array_distinct("_e")).alias("_x")))
    known = synonyms.where("sim is not null").groupBy("token_a", "token_b").agg(F.max("sim").alias("sim"))
    seen = pairs.select("_t", "_x").distinct()
    resolved = written(seen.join(known, (F.col("_t") == F.col("token_a")) & (F.col("_x") == F.col("token_b")))
                       .select("token_a", "token_b", "sim"), "synonym-pairs")
    met = pairs.join(resolved, (F.col("_t") == F.col("token_a")) & (F.col("_x") == F.col("token_b")))
    best = (met.groupBy(F.col("_row").alias("_of"), "_t").agg(F.max("sim").alias("_sim"))
            .groupBy("_of").agg(F.map_from_entries(F.collect_list(F.struct("_t", "_sim"))).alias("_known")))  # at most the row's own tokens
    sums = F.aggregate(F.transform(tokens, lambda t: F.when(F.array_contains(expected_tokens, t), 1.0).otherwise(
        F.coalesce(F.greatest(F.try_element_at("_known", t), F.lit(0.0)), F.lit(0.0)))), F.lit(0.0), lambda s, x: s + x)
    return (rows.join(best, F.col("_row") == F.col("_of"), "left")
            .withColumn("synonym_score", F.coalesce(sums / F.nullif(F.size(tokens), F.lit(0)), F.lit(0.0)))
            .select(*df.columns, "synonym_score"))
