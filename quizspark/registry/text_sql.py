"""SQL counterparts of the text, parsing, matching and grading expressions, for the comparison engine."""

from __future__ import annotations

from quizspark import fixed_values as fv

# The SQL side states its patterns itself; only the lists in ``fixed_values`` are shared.
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
NOT_WORD = r"[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x85\p{Z}'-]"
FORM_START = r"(?:(?:what|who|where|when)\s+(?:is|are|was|were)|(?:why|how)\s+is)\s+"
FORM_ANYWHERE = r"(?i)(?:what|who|where|when|why|how)\s+(?:is|are|was|were|would)\s+"


def _starters() -> list[str]:
    """Every question word with the first verb, then every word with the second, and so on."""
    out = []
    for verb in fv.QUESTION_VERBS:
        for word in fv.QUESTION_WORDS:
            out.append(word + r"\s+" + verb + r"\s+")
    return out


def _expansions() -> dict[str, str]:
    """What is left of an abbreviation when its expansions replace it as a word, one after the other."""
    out = {}
    for short, longs in fv.ABBREVIATIONS.items():
        words = [short]
        for long in longs:
            words = [x for w in words for x in (long.split(" ") if w == short else [w])]
        out[short] = " ".join(words)
    return out


EXPANSIONS = _expansions()


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {lit(WS + '+')}, ' ', 'g'))"


def norm(x: str) -> str:
    plain = collapse(f"regexp_replace(lower(coalesce({x}, '')), {lit(NOT_WORD)}, ' ', 'g')")
    return rf"regexp_replace({plain}, '^(the|a|an)\s+', '')"


def content(n: str) -> str:
    return f"nullif(trim(regexp_extract({n}, {lit('^' + FORM_START + r'(.+?)(\?|$)')}, 1)), '')"


def words(x: str, mapping: dict[str, str]) -> str:
    """Whole-word replacement by splitting into words and what lies between them."""
    cases = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return (rf"array_to_string([CASE lower(w) {cases} ELSE w END FOR w IN "
            rf"regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+')], '')")


def numbers(x: str) -> str:
    found = ", ".join(f"regexp_extract_all({x}, {lit(p)})" for p in fv.NUMBER_PATTERNS)
    return f"list_distinct([regexp_replace(v, '[,$]', '', 'g') FOR v IN flatten([{found}])])"


def years(x: str) -> str:
    return f"regexp_extract_all({x}, {lit(fv.YEAR_PATTERN)}, 1)"


def tokens(n: str) -> str:
    stop = ", ".join(lit(w) for w in fv.STOPWORDS)
    cut = lit("(n't|'s|'m|'d|'ll|'re|'ve|')$")
    return (rf"[w FOR w IN [regexp_replace(x, {cut}, '') FOR x IN string_split({n}, ' ')] "
            rf"IF regexp_full_match(w, '[\p{{L}}\p{{N}}]{{3,}}') AND w NOT IN ({stop})]")


def jaccard(a: str, b: str) -> str:
    return (f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE "
            f"len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END")


def word_count(x: str) -> str:
    return f"CASE WHEN {collapse(x)} = '' THEN 0 ELSE len(string_split({collapse(x)}, ' ')) END"


def clean_response(x: str) -> str:
    out = collapse(x)
    for p in fv.ANSWER_PREFIXES:
        out = f"regexp_replace({out}, {lit('(?i)' + p)}, '')"
    return f"trim({out})"


def response_type(raw: str, clean: str) -> str:
    def phrases(ps_: list[str]) -> str:
        return "(" + " OR ".join(f"contains(lower({clean}), {lit(p)})" for p in ps_) + ")"
    why = "(?i)" + "|".join(f"(?:{p})" for p in fv.REASONING_PATTERNS)
    return (f"CASE WHEN {raw} IS NULL OR {collapse(raw)} = '' THEN 'error' WHEN {phrases(fv.REFUSAL_PHRASES)} THEN 'refusal' "
            f"WHEN regexp_matches({clean}, {lit(FORM_ANYWHERE)}) THEN '{fv.QUESTION_TYPE}' "
            f"WHEN regexp_matches({clean}, {lit(why)}) THEN 'explanation' "
            f"WHEN {phrases(fv.UNCERTAINTY_PHRASES)} THEN 'uncertain' ELSE 'direct_answer' END")


def indicators(clean: str) -> str:
    listed = ", ".join(lit(p) for p in fv.UNCERTAINTY_PHRASES)
    return f"[p FOR p IN [{listed}] IF contains(lower({clean}), p)]"


def question_answer(clean: str) -> str:
    hits = ", ".join(f"nullif(regexp_extract({clean}, {lit(f'(?i)({s}[^?.!]*[?.!]?)')}, 1), '')" for s in _starters())
    hit = f"trim(coalesce({hits}))"
    asked = f"CASE WHEN suffix({hit}, '?') THEN {hit} ELSE {hit} || '?' END"
    return f"coalesce(upper(substr({asked}, 1, 1)) || lower(substr({asked}, 2)), trim({clean}))"


def direct_answer(clean: str) -> str:
    heads = []
    for d in [".", "\n", "!", "?"]:
        first = f"trim(split_part({clean}, {lit(d)}, 1))"
        bare = f"trim(regexp_replace({first}, {lit('(?i)' + fv.DIRECT_PREFIX)}, ''))"
        heads.append(f"CASE WHEN length({first}) > 2 THEN nullif({bare}, '') END")
    return f"coalesce({', '.join(heads)}, trim({clean}))"


def reasoning(clean: str) -> str:
    """Sentence tails after every reasoning word, found by adding up the lengths of the pieces."""
    lists = []
    for p in fv.REASONING_PATTERNS:
        pat = lit("(?i)" + p)
        start = (f"1 + coalesce(list_sum([length(x) FOR x IN string_split_regex({clean}, {pat})[1:k]]), 0)"
                 f" + coalesce(list_sum([length(x) FOR x IN regexp_extract_all({clean}, {pat})[1:k]]), 0)")
        lists.append(f"[trim(regexp_extract(substr({clean}, CAST({start} AS BIGINT)), '^[^.?!\\n]*[.?!\\n]?')) "
                     f"FOR k IN range(1, len(regexp_extract_all({clean}, {pat})) + 1)]")
    kept = f"[s FOR s IN flatten([{', '.join(lists)}]) IF length(s) > 10]"
    return (f"CASE WHEN len({kept}) > 0 THEN array_to_string({kept}, '. ') "
            f"WHEN {word_count(clean)} > 20 THEN {clean} END")


def parsed(source: str, text: str, name: str = "parsed") -> str:
    """CTEs that add clean, rtype, hints, extracted and quality to the rows of ``source``."""
    return f"""{name}_1 AS MATERIALIZED (SELECT *, CASE WHEN {text} IS NULL OR {collapse(text)} = '' THEN '' ELSE {clean_response(text)} END AS clean FROM {source}),
{name}_2 AS MATERIALIZED (SELECT *, {response_type(text, 'clean')} AS rtype FROM {name}_1),
{name}_3 AS MATERIALIZED (SELECT *, CASE WHEN rtype = 'error' THEN [] ELSE {indicators('clean')} END AS hints,
  CASE WHEN rtype IN ('error', 'refusal') THEN '' WHEN rtype = '{fv.QUESTION_TYPE}' THEN {question_answer('clean')}
    ELSE {direct_answer('clean')} END AS extracted FROM {name}_2),
{name} AS MATERIALIZED (SELECT *, CASE WHEN rtype IN ('refusal', 'error') THEN 0 ELSE greatest(0, least(1, CAST(1.0 AS DOUBLE)
  + CASE WHEN rtype = '{fv.QUESTION_TYPE}' THEN CAST(0.2 AS DOUBLE) ELSE 0 END - len(hints) * CAST(0.1 AS DOUBLE)
  - CASE WHEN length(extracted) < 5 THEN CAST(0.3 AS DOUBLE) ELSE 0 END
  - CASE WHEN {word_count('extracted')} > 50 THEN CAST(0.2 AS DOUBLE) ELSE 0 END)) END AS quality FROM {name}_3)"""


def edit_ratio(a: str, b: str) -> str:
    longest = f"greatest(length({a}), length({b}))"
    return f"(CASE WHEN {longest} = 0 THEN 100 ELSE (200 * ({longest} - levenshtein({a}, {b})) + {longest}) // (2 * {longest}) END)"


def fuzzy_ctes(source: str, name: str) -> str:
    """CTEs that add the four fuzzy scores s1 to s4 and their best to rows with na and ne."""
    shared, left, right = ("array_to_string(list_sort(list_intersect(wa, wb)), ' ')",
                           "trim(sh || ' ' || array_to_string(list_sort(list_distinct([w FOR w IN wa IF NOT list_contains(wb, w)])), ' '))",
                           "trim(sh || ' ' || array_to_string(list_sort(list_distinct([w FOR w IN wb IF NOT list_contains(wa, w)])), ' '))")
    run = edit_ratio("array_to_string(more[i:i + len(fewer) - 1], ' ')", "array_to_string(fewer, ' ')")
    return f"""{name}_w AS MATERIALIZED (SELECT *, [w FOR w IN string_split(na, ' ') IF w <> ''] AS wa, [w FOR w IN string_split(ne, ' ') IF w <> ''] AS wb FROM {source}),
{name}_s AS MATERIALIZED (SELECT *, {shared} AS sh, CASE WHEN len(wa) <= len(wb) THEN wa ELSE wb END AS fewer, CASE WHEN len(wa) <= len(wb) THEN wb ELSE wa END AS more FROM {name}_w),
{name}_t AS MATERIALIZED (SELECT *, {left} AS lf, {right} AS rg FROM {name}_s),
{name}_u AS MATERIALIZED (SELECT *, {edit_ratio('na', 'ne')} AS s1,
  CASE WHEN len(fewer) = 0 THEN 0 ELSE list_max([{run} FOR i IN range(1, len(more) - len(fewer) + 2)]) END AS s2,
  {edit_ratio("array_to_string(list_sort(wa), ' ')", "array_to_string(list_sort(wb), ' ')")} AS s3,
  CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0 ELSE greatest({edit_ratio('sh', 'lf')}, {edit_ratio('sh', 'rg')}, {edit_ratio('lf', 'rg')}) END AS s4 FROM {name}_t),
{name} AS MATERIALIZED (SELECT *, greatest(s1, s2, s3, s4) AS best FROM {name}_u)"""


def matched(source: str, answer: str, expected: str, required: str = "FALSE", name: str = "matched",
            limit: str = "0.8", synonyms: str = "0") -> str:
    """CTEs that add is_match, conf and mtype by all six strategies."""
    form = lit("^" + FORM_START)
    return f"""{name}_1 AS MATERIALIZED (SELECT *, {norm(answer)} AS na, {norm(expected)} AS ne,
  coalesce({collapse(answer)} = '', TRUE) AS blank FROM {source}),
{fuzzy_ctes(name + '_1', name + '_f')},
{name}_2 AS MATERIALIZED (SELECT *, {content('na')} AS ca, {content('ne')} AS ce,
  list_concat({numbers('na')}, {numbers(words('na', fv.NUMBER_WORDS))}) AS numa,
  list_concat({numbers('ne')}, {numbers(words('ne', fv.NUMBER_WORDS))}) AS nume,
  {words('na', EXPANSIONS)} AS xa, {words('ne', EXPANSIONS)} AS xe, {tokens('na')} AS ta, {tokens('ne')} AS te, best / 100 AS c4 FROM {name}_f),
{name}_3 AS MATERIALIZED (SELECT *, na = ne AS h0,
  coalesce(CASE WHEN ca IS NOT NULL AND ce IS NOT NULL THEN ca = ce WHEN ca IS NOT NULL THEN ca = ne
    WHEN ce IS NOT NULL THEN na = ce ELSE FALSE END, FALSE) AS h1,
  greatest(CASE WHEN len(nume) = 0 THEN 0 ELSE len(list_intersect(numa, nume)) / len(nume) END,
    CASE WHEN len(list_intersect({years('na')}, {years('ne')})) > 0 THEN 1 ELSE 0 END) AS c2,
  na = ne OR xa = ne OR na = xe OR xa = xe AS h3, greatest({jaccard('ta', 'te')}, 0.8 * {synonyms}) AS c5 FROM {name}_2),
{name}_4 AS MATERIALIZED (SELECT *, CASE WHEN h0 THEN 1.0 ELSE 0.0 END AS c0,
  CASE WHEN ca IS NOT NULL AND ce IS NOT NULL THEN CASE WHEN h1 THEN 1.0 ELSE 0.7 END
    WHEN ca IS NOT NULL THEN CASE WHEN h1 THEN 0.9 ELSE 0 END WHEN ce IS NOT NULL THEN CASE WHEN h1 THEN 0.8 ELSE 0 END ELSE 0 END
    * CASE WHEN {required} AND NOT regexp_matches(trim(lower({answer})), {form}) THEN 0.5 ELSE 1 END AS c1,
  CASE WHEN h3 THEN 1.0 ELSE 0.0 END AS c3 FROM {name}_3),
{name} AS MATERIALIZED (SELECT *, NOT blank AND (h0 OR h1 OR c2 >= 0.8 OR h3 OR c4 >= {limit} OR c5 >= 0.7) AS is_match,
  CASE WHEN blank THEN 'exact' WHEN h0 THEN 'exact' WHEN h1 THEN '{fv.QUESTION_TYPE}' WHEN c2 >= 0.8 THEN 'number_date'
    WHEN h3 THEN 'abbreviation' WHEN c4 >= {limit} THEN 'fuzzy' WHEN c5 >= 0.7 THEN 'semantic' WHEN greatest(c1, c2, c4, c5) = 0 THEN 'exact'
    WHEN c1 = greatest(c1, c2, c4, c5) THEN '{fv.QUESTION_TYPE}' WHEN c2 = greatest(c1, c2, c4, c5) THEN 'number_date'
    WHEN c4 = greatest(c1, c2, c4, c5) THEN 'fuzzy' ELSE 'semantic' END AS mtype,
  CAST(CASE WHEN blank THEN 0 WHEN h0 THEN 1 WHEN h1 THEN c1 WHEN c2 >= 0.8 THEN c2 WHEN h3 THEN 1 WHEN c4 >= {limit} THEN c4 WHEN c5 >= 0.7 THEN c5
    ELSE greatest(c1, c2, c4, c5) END AS DOUBLE) AS conf FROM {name}_4)"""
