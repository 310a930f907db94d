"""SQL of the English stemmer (Porter2), for the queries whose SQL needs stems: one step a common table."""

from __future__ import annotations

from skein.functions import terms

_V = "[aeiouy]"
_C = "[^aeiouy]"


def _cut(n: int, more: str = "") -> str:
    kept = f"left(w, length(w) - {n})" if n else "w"
    return f"{kept} || '{more}'" if more else kept


def _ends(suffix: str) -> str:
    return f"ends_with(w, '{suffix}')"


def _reaches(suffix: str, region: str = "r1") -> str:
    return f"length(w) - {len(suffix)} >= {region}"


def _region(word: str) -> str:
    return f"CASE WHEN regexp_matches({word}, '{_V}{_C}') THEN length(regexp_extract({word}, '^(?s:.*?){_V}{_C}')) ELSE length({word}) END"


def _short(word: str) -> str:
    return f"(regexp_matches({word}, '{_C}{_V}[^aeiouywxY]$') OR regexp_full_match({word}, '{_V}{_C}'))"


def _first(rules: list[tuple[str, str]], otherwise: str) -> str:
    """The first suffix of the rules that the word has counts, whether or not it lies in the region."""
    return "CASE " + " ".join(f"WHEN {c} THEN {r}" for c, r in rules) + f" ELSE {otherwise} END"


def stems_of(words: str) -> str:
    """Common tables that end in ``stems(word, stem)`` for the distinct words of the table ``words`` (column word)."""
    fixed = ", ".join(f"('{a}', '{b}')" for a, b in terms._EXCEPTIONS.items())
    kept = ", ".join(f"'{w}'" for w in sorted(terms._KEPT))
    doubles = " OR ".join(_ends(d) for d in terms._DOUBLE)
    s_cut = f"CASE WHEN {_ends('sses')} THEN {_cut(2)} WHEN {_ends('ied')} OR {_ends('ies')} THEN CASE WHEN length(w) > 4 THEN {_cut(2)} ELSE {_cut(1)} END WHEN {_ends('s')} AND NOT {_ends('us')} AND NOT {_ends('ss')} AND regexp_matches(left(w, length(w) - 2), '{_V}') THEN {_cut(1)} ELSE w END"
    eed = [(_ends(s), f"CASE WHEN {_reaches(s)} THEN {_cut(len(s), 'ee')} ELSE w END") for s in ("eedly", "eed")]
    ed = [(_ends(s), f"CASE WHEN regexp_matches({_cut(len(s))}, '{_V}') THEN '+' || {_cut(len(s))} ELSE w END") for s in ("ingly", "edly", "ing", "ed")]
    repair = f"CASE WHEN {_ends('at')} OR {_ends('bl')} OR {_ends('iz')} THEN w || 'e' WHEN {doubles} THEN {_cut(1)} WHEN {_short('w')} AND r1 >= length(w) THEN w || 'e' ELSE w END"
    step2 = [(_ends(a), f"CASE WHEN {_reaches(a)} THEN {_cut(len(a), b)} ELSE w END") for a, b in terms._STEP2]
    step2 += [(f"({_ends('ogi')} AND {_reaches('ogi')} AND left(right(w, 4), 1) = 'l' AND length(w) >= 4)", _cut(1)), (f"({_ends('li')} AND {_reaches('li')} AND length(w) >= 3 AND regexp_matches(left(right(w, 3), 1), '[cdeghkmnrt]'))", _cut(2))]
    step3 = [(_ends(a), f"CASE WHEN {_reaches(a)} THEN {_cut(len(a), b)} ELSE w END") for a, b in terms._STEP3]
    step3 += [(f"({_ends('ative')} AND {_reaches('ative', 'r2')})", _cut(5))]
    step4 = [(_ends(a), f"CASE WHEN {_reaches(a, 'r2')} THEN {_cut(len(a))} ELSE w END") for a in terms._STEP4]
    step4 += [(f"({_ends('ion')} AND {_reaches('ion', 'r2')} AND length(w) >= 4 AND left(right(w, 4), 1) IN ('s', 't'))", _cut(3))]
    last = f"CASE WHEN {_ends('e')} AND (length(w) - 1 >= r2 OR length(w) - 1 >= r1 AND NOT {_short(_cut(1))}) THEN {_cut(1)} WHEN {_ends('l')} AND NOT {_ends('e')} AND length(w) - 1 >= r2 AND {_ends('ll')} THEN {_cut(1)} ELSE w END"
    rest = "word, r1, r2, done"
    steps = [
        f"st0 AS (SELECT DISTINCT word FROM {words})",
        f"st1 AS (SELECT word, stem FROM st0 JOIN (VALUES {fixed}) f(word, stem) USING (word) UNION ALL SELECT word, word FROM st0 WHERE length(word) <= 2)",
        "st2 AS (SELECT word, array_to_string(list_transform(range(1, length(word) + 1), lambda i: CASE WHEN word[i] = 'y' AND (i = 1 OR contains('aeiouy', word[i - 1])) THEN 'Y' ELSE word[i] END), '') AS w FROM st0 ANTI JOIN st1 USING (word))",
        f"st3 AS (SELECT word, w, CASE WHEN starts_with(w, 'gener') THEN 5 WHEN starts_with(w, 'commun') THEN 6 WHEN starts_with(w, 'arsen') THEN 5 ELSE {_region('w')} END AS r1 FROM st2)",
        f"st4 AS (SELECT word, w, r1, r1 + {_region('substring(w, r1 + 1)')} AS r2 FROM st3)",
        f"st5 AS (SELECT word, r1, r2, {s_cut} AS w FROM st4)",
        f"st6 AS (SELECT word, r1, r2, w, w IN ({kept}) AS done FROM st5)",
        f"st7 AS (SELECT {rest}, CASE WHEN done THEN w ELSE {_first(eed + ed, 'w')} END AS w FROM st6)",
        f"st8 AS (SELECT {rest}, CASE WHEN starts_with(w, '+') THEN (SELECT {repair} FROM (SELECT substring(q.w, 2) AS w)) ELSE w END AS w FROM st7 q)",
        f"st9 AS (SELECT {rest}, CASE WHEN NOT done AND length(w) > 2 AND regexp_matches(w, '{_C}[yY]$') THEN {_cut(1, 'i')} ELSE w END AS w FROM st8)",
        *[f"st{n} AS (SELECT {rest}, CASE WHEN done THEN w ELSE {_first(rules, 'w')} END AS w FROM st{n - 1})" for n, rules in ((10, step2), (11, step3), (12, step4))],
        f"st13 AS (SELECT word, CASE WHEN done THEN w ELSE replace({last}, 'Y', 'y') END AS stem FROM st12)",
        "stems AS (SELECT word, stem FROM st1 UNION ALL SELECT word, stem FROM st13)",
    ]
    return ",\n".join(steps)
